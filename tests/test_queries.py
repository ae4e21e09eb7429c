import os

import pytest
from support import DATA, NAMES, check

from pagelathe.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def test_job_fold_runs(spark):
    out = QUERIES["job_fold"](spark, DATA)
    assert out.count() == spark.read.parquet(f"{DATA}/events.parquet").count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_are_pruned(spark):
    """Filters and columns reach the scan."""
    from pagelathe.operators import runs
    from pagelathe.sources import readers

    df = readers.lookup(spark.read.parquet(f"{DATA}/orders.parquet"), o_orderkey=7).select("o_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    top = runs.latest(spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey"), ["o_custkey"], [__import__("pyspark").sql.functions.desc("o_orderkey")])
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_text_diffs_by_difflib(spark):
    import difflib
    import hashlib

    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    pairs = {}
    for i, r in rows.items():
        pairs.setdefault((r["source"], i // 2), {})[i % 2] = r
    got = {(r["comparison_id"], r["page_no"]): r for r in QUERIES["page_text_diffs"](spark, DATA).collect()}
    assert got.keys() == pairs.keys()
    for key, sides in pairs.items():
        lines = lambda r: "\n".join(x.rstrip() for x in r["text"].replace("\r\n", "\n").split("\n")).strip().splitlines()
        want = list(difflib.unified_diff(lines(sides[0]), lines(sides[1]), lineterm="")) if len(sides) == 2 else []
        assert got[key]["hash"] == hashlib.sha256("\n".join(want).encode()).hexdigest()
        assert (got[key]["added"], got[key]["taken"]) == tuple(sum(x[0] == c for x in want) for c in "+-")


def test_scorecard_averages_have_three_decimals(spark):
    assert any(round(r["average"], 1) != r["average"] for r in QUERIES["scorecard"](spark, DATA.replace("0.001", "0.01")).collect())


def test_snapshot_paths_beyond_four_digits(spark, tmp_path):
    """The query is its SQL's for ids of any length; the operator's places stay whole, so that its paths are unique."""
    from pyspark.sql import functions as F

    from pagelathe.operators import manifest

    for name in NAMES:
        os.symlink(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    os.unlink(tmp_path / "documents.parquet")
    t = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 9_900)
    t.write.parquet(str(tmp_path / "documents.parquet"))
    check(spark, QUERIES["snapshot_paths"], ORACLES["snapshot_paths"], str(tmp_path))
    own = manifest.unique_paths(t.selectExpr("doc_id AS pos", "'s' AS snapshot_id", "'x/a.md' AS path")).collect()
    assert sorted(r["snapshot_path"] for r in own) == sorted(["a.md", *(f"{n:04d}-a.md" for n in range(9_901, 9_900 + len(own)))])


def test_text_diffs_hold_few_texts_at_once(spark):
    """What comes to a Python worker at once is bounded in bytes, not by ten thousand pairs of texts of any length."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from pagelathe.operators import evaluate

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    QUERIES["page_text_diffs"](spark, DATA)

    @F.arrow_udf("long")
    def held(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([x.nbytes + y.nbytes] * len(x), pa.int64())

    text = F.repeat(F.lit("0123456789"), F.lit(2_000))
    most = spark.range(0, 2_000, 1, 1).select(held(F.concat(text, F.col("id").cast("string")), text).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * evaluate.DIFF_BYTES
