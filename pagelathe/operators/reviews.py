"""Reviews are events that are only appended; a target's state is its last one, by place and not by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.text import strip
from pagelathe.operators.numbering import number_rows


def fold(events: DataFrame, *keys: str) -> DataFrame:
    """The last appended event of each key (seq is the order of appending)."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).filter("_n = 1").drop("_n")


def current_state(targets: DataFrame, events: DataFrame, target_type: str) -> DataFrame:
    """targets (id, review_status, maybe review_reason) with the state their last review gave; an edge keeps no reason."""
    last = fold(events.filter(F.col("target_type") == target_type), "target_id").select(F.col("target_id").alias("id"), F.col("status").alias("_s"), F.col("reason").alias("_r"))
    out = targets.join(last, "id", "left").withColumn("review_status", F.coalesce("_s", "review_status"))
    if "review_reason" in targets.columns and target_type != "knowledge_edge":
        out = out.withColumn("review_reason", F.coalesce("_r", "review_reason"))
    return out.drop("_s", "_r")


def append_review(events: DataFrame, new: DataFrame) -> DataFrame:
    """new (target_type, target_id, status, reason, created_at and place) behind events, with the next numbers."""
    last = events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("_last")).first()["_last"]
    return events.unionByName(number_rows(new, ["place"], "seq", after=last).drop("place"), allowMissingColumns=True)


def accepted_pages(pages: DataFrame) -> DataFrame:
    """Accepted pages that carry knowledge; blank ones stay."""
    return pages.filter((F.col("review_status") == "accepted") & ~F.col("page_kind").isin("reference", "visualization"))


def pending(wanted: DataFrame, reviews: DataFrame, key: str = "page_no") -> DataFrame:
    """Wanted pages without any review."""
    return wanted.join(reviews.select(key).distinct(), key, "left_anti")


def check_reviews(reviews: DataFrame, contracts: DataFrame, profile: str) -> DataFrame:
    """reviews: page_no, verdict, scores (map), critical_errors; contracts: page_no, dimensions. Adds error, null where a review is in order."""
    df = reviews.join(contracts.select("page_no", F.col("dimensions").alias("_dims")), "page_no", "left").withColumn("_in", F.col("_dims").isNotNull())
    few = F.coalesce(F.size("scores"), F.lit(0)) == 0
    if profile == "engineering_chain":
        flaw = F.when(~F.col("verdict").isin("pass", "failed", "needs_review"), "verdict").when(~few, "scores")
    else:
        keys = F.array_sort(F.map_keys("scores"))
        wrong = few | (keys != F.array_sort(F.array_distinct("_dims"))) | F.exists(F.map_values("scores"), lambda v: ~F.coalesce(v.isin(0, 1, 2), F.lit(False)))
        blank = F.exists(F.coalesce("critical_errors", F.array().cast("array<string>")), lambda e: strip(F.coalesce(e, F.lit(""))) == "")
        flaw = F.when(~F.col("verdict").isin("pass", "failed", "needs_review"), "verdict").when(F.coalesce(wrong, F.lit(True)), "scores").when(blank, "critical_errors")
    return df.withColumn("error", F.when(~F.col("_in"), "page").otherwise(flaw)).drop("_dims", "_in")
