"""Runs and their summaries: statistics, history, the current run, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.ids import digest
from pagelathe.functions.text import strip


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order; give the order a last tie-break."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def page_stats(pages: DataFrame, key: str = "run_id") -> DataFrame:
    """pages: key, page_no, review_status."""
    state = lambda s: F.count_if(F.col("review_status") == s).alias(f"{s}_count")
    return pages.groupBy(key).agg(F.count(F.lit(1)).alias("page_count"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), state("accepted"), state("rejected"), state("needs_review"))


def artifact_totals(artifacts: DataFrame, key: str = "run_id") -> DataFrame:
    manifest = F.max(F.when(F.col("kind") == "parse_manifest", F.col("content_hash")))
    return artifacts.groupBy(key).agg(F.count(F.lit(1)).alias("artifact_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("artifact_bytes"), manifest.alias("manifest_hash"))


def artifacts_by_kind(artifacts: DataFrame, *keys: str) -> DataFrame:
    return artifacts.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes"))


STATS = {"page_count": "bigint", "first_page": "int", "last_page": "int", "accepted_count": "bigint", "rejected_count": "bigint", "needs_review_count": "bigint", "artifact_count": "bigint", "artifact_bytes": "bigint", "manifest_hash": "string"}


def run_summaries(runs: DataFrame, documents: DataFrame, pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every run with its statistics, unsorted (``newest_first`` sorts for display). A pruned run's come from what pruning noted (prune_summary, JSON)."""
    current = documents.select(F.col("id").alias("document_id"), F.col("current_parse_run_id"))
    df = runs.join(current, "document_id", "left").withColumn("is_current", F.coalesce(F.col("current_parse_run_id") == F.col("id"), F.lit(False)))
    df = df.join(page_stats(pages).withColumnRenamed("run_id", "id"), "id", "left").join(artifact_totals(artifacts).withColumnRenamed("run_id", "id"), "id", "left")
    tomb = F.from_json("prune_summary", ", ".join(f"{k} {t}" for k, t in STATS.items()))
    df = df.withColumn("_tomb", tomb).withColumn("_pruned", F.coalesce("artifact_state", F.lit("available")) == "pruned")
    zero = {k: F.lit(0) for k in STATS if k.endswith(("_count", "_bytes"))}
    kept = {k: F.coalesce(F.col(k), zero[k]) if k in zero else F.col(k) for k in STATS}
    df = df.withColumns({k: F.when(F.col("_pruned"), F.col(f"_tomb.{k}")).otherwise(kept[k]).cast(t) for k, t in STATS.items()})
    return df.drop("_tomb", "_pruned", "current_parse_run_id")


def require_available(runs: DataFrame) -> DataFrame:
    """Runs whose artifacts are still there (a missing state counts as available)."""
    return runs.filter(F.coalesce("artifact_state", F.lit("available")) == "available")


def current_pages(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages of each document's current run; a document without one has none."""
    run = documents.select(F.col("id").alias("document_id"), F.col("current_parse_run_id").alias("run_id")).filter("run_id IS NOT NULL")
    return pages.join(run, ["document_id", "run_id"], "left_semi")


def page_index(pages: DataFrame) -> DataFrame:
    """Of a page's facts only what a list shows."""
    issues = F.coalesce(F.size("quality.issues"), F.lit(0))
    return pages.select("run_id", "page_no", "page_kind", "review_status", F.coalesce("quality.status", F.lit("needs_review")).alias("quality_status"), issues.cast("int").alias("issue_count"))


def search_index(index: DataFrame, query: str = "", only_issues: bool = False) -> DataFrame:
    """Case-blind search over number, kind and states."""
    text = F.lower(F.concat_ws(" ", F.col("page_no").cast("string"), "page_kind", "review_status", "quality_status"))
    out = index.filter(text.contains(query.strip().lower())) if query.strip() else index
    return out.filter("issue_count > 0") if only_issues else out


def select_current(requests: DataFrame, runs: DataFrame, documents: DataFrame) -> DataFrame:
    """requests: document_id, run_id, reason, manifest_ok. Each with previous_run_id, changed, and error where the run can't become current."""
    r = runs.select(F.col("id").alias("run_id"), F.col("document_id").alias("_doc"), F.col("status").alias("_status"), F.coalesce("artifact_state", F.lit("available")).alias("_state"))
    df = requests.join(r, "run_id", "left").join(documents.select(F.col("id").alias("document_id"), F.col("current_parse_run_id").alias("previous_run_id")), "document_id", "left")
    error = (
        F.when(strip(F.coalesce("reason", F.lit(""))) == "", "reason").when(F.col("_doc").isNull() | (F.col("_doc") != F.col("document_id")), "document")
        .when(F.col("_status") != "parsed", "status").when(F.col("_state") != "available", "artifacts").when(~F.coalesce("manifest_ok", F.lit(False)), "manifest")
    )
    return df.withColumn("error", error).withColumn("changed", F.col("error").isNull() & ~F.col("previous_run_id").eqNullSafe(F.col("run_id"))).drop("_doc", "_status", "_state")


def selection_history(selections: DataFrame, key: str = "document_id", value: str = "selected_run_id") -> DataFrame:
    """Selections, each with what was selected before."""
    w = Window.partitionBy(key).orderBy("created_at", "id")
    return selections.withColumn("previous_run_id", F.lag(value).over(w))


def latest_scoped(items: DataFrame, extractions: DataFrame) -> DataFrame:
    """Candidates or edges of a document's newest successful extraction; where there is none, all of the document's."""
    newest = latest(extractions.filter("status = 'succeeded'"), ["document_id"], [F.desc("created_at"), F.desc("id")]).select("document_id", F.col("id").alias("_latest"))
    return items.join(newest, "document_id", "left").filter(F.col("_latest").isNull() | (F.col("extraction_run_id") == F.col("_latest"))).drop("_latest")


def open_runs(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: document_id, job_id, provider_summary, created_at. The run of each: that of the same job, opened again, or a new one (ids derive from document, job and time)."""
    old = existing.filter("job_id IS NOT NULL").select("job_id", F.col("id").alias("_id"), F.col("model_calls").alias("_calls"), F.col("created_at").alias("_at"), F.col("document_id").alias("_doc"), F.col("provider_summary").alias("_by"))
    df = requests.join(old, "job_id", "left")
    fresh = digest(F.col("document_id").cast("string"), F.coalesce(F.col("job_id").cast("string"), F.lit("")), F.col("created_at").cast("string"), digits=32)
    kept = lambda old, new: F.when(F.col("_id").isNotNull(), F.col(old)).otherwise(F.col(new))
    return df.select(
        F.coalesce(F.col("_id").cast("string"), fresh).alias("id"), kept("_doc", "document_id").alias("document_id"), "job_id", F.lit("parsing").alias("status"), kept("_by", "provider_summary").alias("provider_summary"),
        F.coalesce("_calls", F.lit(0)).alias("model_calls"), kept("_at", "created_at").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error_json"), F.col("_id").isNotNull().alias("reopened"),
    )


def finished_status(run_outcome: Column) -> tuple[Column, Column]:
    """A run's and its document's status from how the run ended: finished, failed, cancelled or interrupted."""
    run = F.when(run_outcome == "finished", "parsed").when(run_outcome == "cancelled", "cancelled").when(run_outcome == "interrupted", "interrupted").otherwise("failed")
    return run, F.when(run_outcome == "finished", "needs_review").otherwise("failed")


def recover_interrupted(runs: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """After a crash: runs still parsing are interrupted, their documents failed."""
    hit = runs.filter("status = 'parsing'").select(F.col("document_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    docs = documents.join(hit, "id", "left").withColumn("status", F.when(F.col("_hit"), "failed").otherwise(F.col("status"))).drop("_hit")
    return runs.withColumn("status", F.when(F.col("status") == "parsing", "interrupted").otherwise(F.col("status"))), docs


def newest_first(df: DataFrame, limit: int | None = None) -> DataFrame:
    out = df.orderBy(F.desc("created_at"), "id")
    return out.limit(limit) if limit else out


def by_title(df: DataFrame) -> DataFrame:
    """Titles in an order that ignores case and accents, then by id."""
    return df.orderBy(F.collate("title", "UNICODE_CI_AI"), "id")


def share_page_images(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """pages: id, document_id, page_no, image_path, image_hash; assets: document_id, page_no, path, content_hash. Pages moved to the shared image; error where contents differ."""
    shared = assets.groupBy("document_id", "page_no").agg(F.min("path").alias("_path"), F.min("content_hash").alias("_hash"), F.countDistinct("content_hash").alias("_n"))
    df = pages.join(shared, ["document_id", "page_no"], "left")
    bad = (F.col("_n") > 1) | (F.col("_hash") != F.col("image_hash"))
    return df.withColumn("error", F.when(bad, "image conflict")).withColumn("image_path", F.when(~F.coalesce(bad, F.lit(True)), F.col("_path")).otherwise(F.col("image_path"))).drop("_path", "_hash", "_n")
