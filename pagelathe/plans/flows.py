"""The composite questions a user asks, put together from operators. Each takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.repair import json_object
from pagelathe.operators import evaluate, knowledge, manifest, pages, provider, reviews, runs
from pagelathe.operators.pages import MODEL_BLOCK
from pagelathe.sources import storage


def read_answers(answers: DataFrame) -> DataFrame:
    """The last answer of each page (run_id, page_no, response, outcome) as a model page: struct model, schema_tag, parser_error.

    Answers of Markdown alone get blocks; those that are no page leave model null and say why.
    """
    df = provider.final_answers(answers).withColumn("j", json_object(F.col("response")))
    fields = f"page_kind string, markdown string, blocks array<{MODEL_BLOCK}>"
    df = df.withColumn("o", F.from_json("j.json", fields)).withColumn("keys", F.coalesce(F.json_object_keys("j.json"), F.array().cast("array<string>")))
    df = df.select("run_id", "page_no", "outcome", F.col("error").alias("failure"), F.col("j.repaired").alias("repaired"), "o.page_kind", "o.markdown", "o.blocks", F.array_contains("keys", "blocks").alias("has_blocks"), F.array_contains("keys", "page_kind").alias("has_kind"))
    df = pages.normalize_schema(df)
    flaw = pages.page_flaw(F.col("page_kind"), F.col("markdown"), F.col("blocks"))
    error = F.when(F.col("outcome") != "ok", F.coalesce("failure", "outcome")).otherwise(flaw)
    model = F.when(error.isNull(), F.struct("page_kind", "markdown", "blocks"))
    return df.select("run_id", "page_no", model.alias("model"), "schema_tag", "repaired", error.alias("parser_error"))


def parse_run(raster: DataFrame, finished: DataFrame, made: DataFrame, parser: provider.PageParser, limits: provider.Limits, path: str | None = None) -> DataFrame:
    """Answers for the pages of runs that aren't stored yet, written at path (by default a new one in the shared folder) round by round.

    raster has run_id, page_no, image, raw_text; made are the answers of earlier requests, whose calls count.
    """
    todo = pages.pending_pages(raster, finished)
    return provider.call_in_rounds(todo, made, parser, limits, path or storage.shared_path(raster.sparkSession, "answers"))


def page_facts(raster: DataFrame, answers: DataFrame) -> DataFrame:
    """Page facts from rendered pages (run_id, document_id, page_no, width, height, ink_ratio, raw_text, native) and their answers."""
    return pages.page_facts(raster.join(read_answers(answers), ["run_id", "page_no"], "left"))


def replay(frozen: DataFrame) -> DataFrame:
    """Frozen pages (run_id, page_no, response) as answers: a run without a parser, the same each time."""
    return frozen.select("run_id", F.col("page_no").cast("int").alias("page_no"), F.lit(1).alias("attempt"), "response", F.lit(None).cast("string").alias("error"), F.lit("ok").alias("outcome"))


def replay_flaws(frozen: DataFrame, wanted: DataFrame) -> DataFrame:
    """frozen: run_id, page_no; wanted: run_id, source_hash, page_count, actual_hash (of the source as it is now). Why a run can't be replayed; no row where it can."""
    n = frozen.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
    df = wanted.join(manifest.pages_are_contiguous(frozen), "run_id", "left").join(n, "run_id", "left")
    flaws = F.array_compact(
        F.array(
            F.when(~F.coalesce("contiguous", F.lit(False)), "page numbers"), F.when(F.coalesce("_n", F.lit(0)) != F.col("page_count"), "page count"),
            F.when(~F.col("source_hash").eqNullSafe(F.col("actual_hash")), "source hash"),
        )
    )
    return df.select("run_id", F.explode(flaws).alias("flaw"))


def extract_candidates(documents: DataFrame, all_pages: DataFrame, extractor: provider.Extractor, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Candidates and edges from the accepted pages of documents' current runs."""
    accepted = reviews.accepted_pages(runs.current_pages(documents, all_pages))
    found = provider.extract(pages.document_text(accepted, "document_id", gap="\n"), extractor)
    return knowledge.candidates_of(found.filter("error IS NULL"), accepted, run_id)


def knowledge_snapshot(candidates: DataFrame, edges: DataFrame, extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The accepted graph of documents' newest extractions."""
    return knowledge.accepted_snapshot(runs.latest_scoped(candidates, extractions), runs.latest_scoped(edges, extractions))


def publish(candidates: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Releases of the documents whose graph is in order, and the flaws of the others."""
    flaws = knowledge.publish_flaws(candidates, edges)
    bad = flaws.select("document_id").distinct()
    fine = lambda df: df.join(bad, "document_id", "left_anti")
    return knowledge.release(fine(candidates), fine(edges)), flaws


def freeze(run_facts: DataFrame, all_pages: DataFrame, artifacts: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Snapshots of the runs that can be frozen, and the flaws of the others. run_facts: as evaluate.snapshot_rows and capture_flaws need them."""
    flaws = evaluate.capture_flaws(run_facts, all_pages, artifacts, cases)
    fine = run_facts.join(flaws.select("id").distinct(), "id", "left_anti")
    return evaluate.snapshot_rows(fine, all_pages), flaws


def assess(entries: DataFrame, files: DataFrame, snapshot_pages: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Integrity of a snapshot's files, each page's checks, and whether execution is complete."""
    inspected = pages.inspect_pages(snapshot_pages, images)
    return manifest.verify(entries, files), inspected, evaluate.execution_status(inspected)


def compare(snapshots: DataFrame, wanted: DataFrame, snapshot_pages: DataFrame, diff: bool = True) -> tuple[DataFrame, DataFrame]:
    """wanted: comparison_id, baseline_id, candidate_id; snapshot_pages: snapshot_id, page_no, page. Compared pages, and the comparisons that can't be made."""
    whole = lambda side: snapshots.select(F.col("snapshot_id").alias(f"{side}_id"), F.struct(*snapshots.columns).alias(side[0]))
    both = wanted.join(whole("baseline"), "baseline_id").join(whole("candidate"), "candidate_id").withColumn("flaw", evaluate.compare_flaw())
    fine = both.filter("flaw IS NULL")
    listed = fine.select("comparison_id", F.explode("b.page_numbers").alias("page_no"))
    side = lambda s: fine.select("comparison_id", F.col(f"{s}_id").alias("snapshot_id")).join(snapshot_pages, "snapshot_id").select("comparison_id", "page_no", "page")
    return evaluate.compare_pages(listed, side("baseline"), side("candidate"), diff=diff), both.filter("flaw IS NOT NULL").select("comparison_id", "flaw")
