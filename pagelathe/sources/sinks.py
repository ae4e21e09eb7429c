"""Sinks: page facts and their children, snapshots that can't be overwritten, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.operators.pages import child_rows


def write_pages(pages: DataFrame, root: str) -> None:
    """A run's pages and their child tables, partitioned by run; the pages themselves last, as the sign that all is there."""
    pages = pages.persist()
    try:
        for name, df in child_rows(pages).items():
            df.write.mode("append").parquet(f"{root}/{name}")
        pages.write.mode("append").partitionBy("run_id").parquet(f"{root}/pages")
    finally:
        pages.unpersist()


def write_failures(answers: DataFrame, path: str) -> None:
    """Answers that were no pages, for a look later."""
    answers.filter("outcome IN ('retry', 'failed')").write.mode("append").partitionBy("run_id").json(path)


def write_snapshot(df: DataFrame, root: str, snapshot_id: str) -> None:
    """A frozen snapshot: refuses to overwrite."""
    df.write.mode("errorifexists").parquet(f"{root}/snapshot_id={snapshot_id}")


def append_events(events: DataFrame, path: str) -> None:
    """Append to a log of JSON lines; events bring their seq."""
    events.filter(F.col("seq").isNotNull()).write.mode("append").json(path)


def append_rows(df: DataFrame, path: str, **stamp) -> None:
    """Append rows with constant columns, such as the run that made them."""
    for k, v in stamp.items():
        df = df.withColumn(k, F.lit(v))
    df.write.mode("append").parquet(path)


def write_report(reports: DataFrame, path: str) -> None:
    """Reports with their JSON and Markdown forms."""
    reports.withColumn("json", F.to_json(F.struct("*"))).write.mode("overwrite").parquet(path)
