"""Placement of rows on shards by a permutation-filled lookup table. DataFrame functions only on the main path.

Every shard has its own permutation of the table's slots (offset and step from its name's hash; the table's size is
prime, so each step visits every slot). The shards take turns, each claiming the first slot of its permutation that is
still free, until the table is full. So shares differ by one slot at most, and when a shard goes, few other slots move.

The table has a fixed size (65,537 slots of two bytes by default) whatever the data's size; it travels in the plan as a
binary literal, and a row's place is one hash and one constant-time slice of it: no join, no shuffle.

Defined results: a null key counts as the empty string; equal keys share a shard, repeated rows too; very long keys are
hashed whole; an empty table gives no rows; the row's columns are in a struct, so their names can't clash.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def build_table(shards: list[str], size: int = 65537) -> list[int]:
    """The index of the shard that holds each slot. Shards: distinct names, fewer than slots."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > min(size, 65535):
        raise ValueError("shards must be distinct names, at least one and no more than slots or 65535")
    if not _prime(size):
        raise ValueError("the table's size must be prime")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    place = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while table[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % size
            table[place[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot_column(key: Column, size: int) -> Column:
    """md5-based, so that other engines can place the same row; a null key is placed as the empty string."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size)).cast("int")


def shard_column(slot: Column, table: list[int]) -> Column:
    packed = F.lit(b"".join(i.to_bytes(2, "big") for i in table))
    return F.conv(F.hex(F.substring(packed, slot * 2 + 1, F.lit(2))), 16, 10).cast("int")


def place(df: DataFrame, key: str, shards: list[str], size: int = 65537) -> DataFrame:
    """The rows of df, whole and unshuffled, in a struct ``row``, with ``slot`` and ``shard`` (the index in shards).

    Rows with equal keys share a shard; a null key counts as the empty string. Columns of df can't clash: they are in row.
    """
    table = build_table(shards, size)
    return df.select(F.struct("*").alias("row"), slot_column(F.col(key), size).alias("slot")).withColumn("shard", shard_column(F.col("slot"), table))


def write_sharded(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """Write placed rows by shard; a shard's rows are dealt over files_per_shard tasks by their content, so a hot shard is no single task, and a task that runs again deals its rows alike."""
    salt = F.pmod(F.xxhash64("slot", F.to_json("row")), F.lit(files_per_shard))
    placed.withColumn("__salt", salt).repartition("shard", "__salt").drop("__salt").write.partitionBy("shard").parquet(path)
