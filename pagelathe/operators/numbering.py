"""Consecutive numbers for rows in an order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.sources.storage import shared_path


def number_rows(df: DataFrame, order: list, name: str = "seq", after: int = 0) -> DataFrame:
    """df with ``name``: after + 1, after + 2, ... in the given order; equal rows in any order among themselves.

    Rows are dealt by ranges and numbered within each, and a range's numbers begin behind the rows of those before it: one
    row a range is all that meets in one place. The ranges are written before they are counted, so numbers don't change
    where a task runs again.
    """
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    part = F.spark_partition_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges.withColumn("_part", part).withColumn("_place", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).write.parquet(path)
    rows = spark.read.parquet(path)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_before"))
    return rows.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_place") + 1 + F.lit(after)).drop("_part", "_place", "_before")
