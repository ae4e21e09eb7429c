"""Pruning old runs: what may go, what it frees, putting it back; and filling in the current run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.operators.runs import artifact_totals, latest, page_stats


def protection_flags(runs: DataFrame, documents: DataFrame, pages: DataFrame, events: DataFrame, extractions: DataFrame, revisions: DataFrame, releases: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Per run (id, document_id): is it current, was one of its pages reviewed, was it extracted from, do a document's workbooks or releases hold its id."""
    flag = lambda ids, name: ids.distinct().withColumn(name, F.lit(True))
    r = runs.select("id", "document_id")
    flags = {
        "is_current": documents.select(F.col("current_parse_run_id").alias("id")).filter("id IS NOT NULL"),
        "has_reviews": events.filter("target_type = 'page'").join(pages.select(F.col("id").alias("target_id"), "run_id"), "target_id").select(F.col("run_id").alias("id")),
        "has_extractions": extractions.select(F.col("parse_run_id").alias("id")),
        # The text of a document's own revisions and releases is searched for its own runs only: an equi-join first.
        "in_workbooks": revisions.select("document_id", "snapshot_json").join(r, "document_id").filter(F.col("snapshot_json").contains(F.col("id"))).select("id"),
        "in_releases": releases.join(revisions.select(F.col("id").alias("revision_id")), "revision_id", "left_semi").select("document_id", "snapshot_json").join(r, "document_id").filter(F.col("snapshot_json").contains(F.col("id"))).select("id"),
    }
    if snapshots is not None:
        flags["in_snapshots"] = snapshots.select(F.col("parse_run_id").alias("id"))
    for name, ids in flags.items():
        r = r.join(flag(ids, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return r


def prune_plan(targets: DataFrame, runs: DataFrame, flags: DataFrame, artifacts: DataFrame, document_id, keep) -> DataFrame:
    """targets: pos, id. Of each distinct target, with its first place: why it is refused (null: it may go), and the bytes it frees."""
    first = targets.groupBy("id").agg(F.min("pos").alias("pos"))
    df = first.join(runs.select("id", F.col("document_id").alias("_doc"), "status", F.coalesce("artifact_state", F.lit("available")).alias("_state")), "id", "left")
    named = [c for c in flags.columns if c not in ("id", "document_id")]
    df = df.join(flags.select("id", *named), "id", "left").join(artifact_totals(artifacts).select(F.col("run_id").alias("id"), F.col("artifact_bytes").alias("reclaimable_bytes")), "id", "left")
    held = F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in named])
    refusal = (
        F.when(F.col("_doc").isNull(), "unknown").when(F.col("_doc") != document_id, "document").when(F.col("id") == keep, "kept").when(F.col("status") == "parsing", "parsing")
        .when(F.col("_state") != "available", "artifacts").when(held != "", F.concat(F.lit("protected: "), held))
    )
    return df.select("pos", "id", refusal.alias("refusal"), F.coalesce("reclaimable_bytes", F.lit(0)).cast("long").alias("reclaimable_bytes"))


def reclaimable(plan: DataFrame) -> DataFrame:
    return plan.filter("refusal IS NULL").agg(F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).cast("long").alias("reclaimable_bytes"))


def stage_prune(ids: DataFrame, runs: DataFrame, pages: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs with tombstones (their statistics as JSON), and the pages and artifacts that go: write these to the backup first."""
    gone_pages = pages.join(ids.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    gone_artifacts = artifacts.join(ids.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    stats = page_stats(gone_pages).join(artifact_totals(gone_artifacts), "run_id", "full")
    tomb = stats.select(F.col("run_id").alias("id"), F.to_json(F.struct(*[c for c in stats.columns if c != "run_id"])).alias("_tomb"))
    df = runs.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left").join(tomb, "id", "left")
    df = df.withColumn("prune_summary", F.when(F.col("_hit"), F.coalesce("_tomb", F.lit("{}"))).otherwise(F.col("prune_summary")))
    df = df.withColumn("artifact_state", F.when(F.col("_hit"), "pruned").otherwise(F.col("artifact_state")))
    return df.select(*runs.columns), gone_pages, gone_artifacts


def prune_operation(plan: DataFrame, document_hash: str, keep: str, operation_id: str) -> DataFrame:
    """One row: the record of an operation (its document, the run that stays, what goes in order, the bytes it frees), as it is written beside the backup."""
    may = plan.filter("refusal IS NULL")
    each = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"].cast("string"))
    out = may.agg(each.alias("run_ids"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).cast("long").alias("reclaimable_bytes"))
    return out.select(F.lit(operation_id).alias("operation_id"), F.lit(document_hash).alias("document_hash"), F.lit(keep).alias("keep_run_id"), "run_ids", "reclaimable_bytes", F.lit("planned").alias("status"))


def match_operation(operations: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: operation_id, document_hash, keep_run_id. Whether each may go on with the operation that it names: flaw id, missing or mismatch, else null."""
    named = F.coalesce((F.col("operation_id") != "") & ~F.col("operation_id").rlike("[/\\\\]") & ~F.col("operation_id").isin(".", ".."), F.lit(False))
    known = operations.select("operation_id", F.col("document_hash").alias("_hash"), F.col("keep_run_id").alias("_keep"), F.lit(True).alias("_there"))
    df = requests.join(known, "operation_id", "left")
    same = F.col("document_hash").eqNullSafe(F.col("_hash")) & F.col("keep_run_id").eqNullSafe(F.col("_keep"))
    return df.withColumn("flaw", F.when(~named, "id").when(F.col("_there").isNull(), "missing").when(~same, "mismatch")).drop("_hash", "_keep", "_there")


def drop_rows(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def roll_back(runs: DataFrame, ids: DataFrame, kept: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs available again, and a table of theirs with what was backed up and isn't there."""
    df = runs.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    df = df.withColumn("artifact_state", F.when(F.col("_hit"), "available").otherwise(F.col("artifact_state")))
    df = df.withColumn("prune_summary", F.when(F.col("_hit").isNull(), F.col("prune_summary")))
    return df.select(*runs.columns), kept.unionByName(backup.join(kept.select("id"), "id", "left_anti"))


def backfill_current(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with their newest parsed run as the current one (null without any)."""
    newest = latest(runs.filter("status = 'parsed'"), ["document_id"], [F.desc("created_at"), F.desc("id")]).select(F.col("document_id").alias("id"), F.col("id").alias("_run"))
    return documents.join(newest, "id", "left").withColumn("current_parse_run_id", F.col("_run")).drop("_run")
