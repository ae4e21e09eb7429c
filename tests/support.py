"""Comparing a query with its SQL, as the driver does."""

import os

import duckdb

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for name in NAMES:
        path = f"{folder}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def check(spark, query, sql, folder=DATA):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(folder).execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, rel.fetchall())
