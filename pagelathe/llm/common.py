"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regex class of the white space that separates words.
SPACE = r"[\x20\x09-\x0D]"

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode (tests); on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="pagelathe-"))
    return _own[0]


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's process ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            delete_path(spark, path)


#: Rows of a few narrow columns that a file of an intermediate table holds where their number is known.
FILE_ROWS = 100_000


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many narrow rows, in no more partitions than give each core two and each partition FILE_ROWS.

    Only for what a shuffle has dealt by distinct pairs, where no key is hot: it would join again what a skewed join was split into.
    """
    spark = df.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    return df.coalesce(parts) if parts < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def cut(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    rows: about how many rows it has at most, if known; small tables are then written as few files.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df = df if rows is None else few_files(df, rows)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def content_key(*columns: str):
    """64-bit hash of a row's identifying columns; equal rows share it."""
    return F.xxhash64(*[F.col(c) for c in columns])


def batches(spark: SparkSession, rows: int = 20_000, size: int = 4 << 20) -> None:
    """Bound Arrow batches by rows and bytes, so that very long texts don't gather in one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def parts_of(df: DataFrame, size: int = 128 << 20) -> int:
    """Partitions of about so many bytes by the optimizer's figure of df's size, at least the session's shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Plans of unknown size are put at some exabytes.
    return least if known > 1 << 60 else max(least, -(-known // size))


#: Rows of a few narrow columns, some MB, that may be broadcast.
SMALL = 200_000


def small_side(df: DataFrame, most: int | None = None) -> DataFrame:
    """df (a table of a few narrow columns) marked for broadcast if it has at most so many rows, else as it is."""
    return F.broadcast(df) if df.count() <= (SMALL if most is None else most) else df


#: A key is hot that more than a HOTth of all rows have; so there are fewer than HOT of them for each key that a row has.
HOT = 1000


def join_hot(rows: DataFrame, told: DataFrame, same, weight: str, total: int) -> DataFrame:
    """rows joined with told (a table; a row a key, weight: rows that have it, of total), so that no key is one task's work.

    Hot keys go to the rows, in a broadcast whose size is bounded (and checked); all others meet in a shuffle, where none
    has more than a HOTth. same: the condition on both sides.
    """
    hot, cold = told.filter(F.col(weight) * HOT > total), told.filter(F.col(weight) * HOT <= total)
    return rows.join(small_side(hot, HOT * HOT), same).unionByName(rows.join(cold, same))


#: What operators keep in a Python worker between tasks.
CACHES: list[dict] = []


def release(keep: dict | None = None) -> None:
    """Drop what other operators have left in this worker, and give the memory back: workers outlive an operator's tasks."""
    full = [c for c in CACHES if c and c is not keep]
    for c in full:
        c.clear()
    if full:
        with contextlib.suppress(Exception):
            ctypes.CDLL(None).malloc_trim(0)
