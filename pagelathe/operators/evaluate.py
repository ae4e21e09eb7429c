"""Frozen snapshots, their assessment, their comparison and the reports."""

from __future__ import annotations

import decimal
import difflib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.text import composed, normalize_latex, normalize_text, table_matrix
from pagelathe.operators.reviews import fold

DIMENSIONS = ("text", "structure", "formulas", "tables", "figures", "evidence")
#: Fixed values.
PROFILES = ("engineering_chain", "formal_scorecard")
SCORED = ("text", "structure", "formula", "table_figure", "source_evidence")
FORMAL_PAGES, FORMAL_CALLS, FORMAL_AVERAGE = 12, 36, 1.5
FIGURES = ("figure", "image", "caption")


def capture_flaws(runs: DataFrame, pages: DataFrame, artifacts: DataFrame, cases: DataFrame) -> DataFrame:
    """runs: id, document_hash, status, artifact_state; cases: case hash. Why a run can't be frozen; no row where it can."""
    n = pages.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("_pages"))
    manifest = artifacts.filter("kind = 'parse_manifest'").select(F.col("run_id").alias("id")).distinct().withColumn("_manifest", F.lit(True))
    json = artifacts.filter("kind = 'page_json'").select("run_id", "page_no")
    bare = pages.join(json, ["run_id", "page_no"], "left_anti").select(F.col("run_id").alias("id")).distinct().withColumn("_bare", F.lit(True))
    df = runs.join(n, "id", "left").join(manifest, "id", "left").join(bare, "id", "left").join(cases.select(F.col("content_hash").alias("document_hash"), F.lit(True).alias("_case")).distinct(), "document_hash", "left")
    flaws = F.array_compact(
        F.array(
            F.when(F.col("status") != "parsed", "status"), F.when(F.coalesce("artifact_state", F.lit("available")) != "available", "artifacts"), F.when(F.coalesce("_pages", F.lit(0)) == 0, "no pages"),
            F.when(F.col("_manifest").isNull(), "no manifest"), F.when(F.col("_bare"), "page without json"), F.when(F.col("_case").isNull(), "source hash"),
        )
    )
    return df.select("id", F.explode(flaws).alias("flaw"))


def snapshot_rows(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """runs: id, snapshot_id, case_id, label, document_hash, model_calls, branch, dirty. Snapshot facts with their page list."""
    p = pages.groupBy(F.col("run_id").alias("id")).agg(F.array_sort(F.collect_list("page_no")).alias("page_numbers"))
    eligible = (F.coalesce("branch", F.lit("detached")) == "main") & ~F.coalesce("dirty", F.lit(False))
    return runs.join(p, "id").select(
        F.lit(2).alias("schema_version"), "snapshot_id", "case_id", "label", F.col("id").alias("parse_run_id"), "document_hash", "page_numbers", F.array_min("page_numbers").alias("page_start"), F.array_max("page_numbers").alias("page_end"), "model_calls", eligible.alias("baseline_eligible")
    )


def compare_flaw(b: str = "b", c: str = "c") -> Column:
    """Why two snapshots (structs) can't be compared, or null."""
    col = lambda s, f: F.col(f"{s}.{f}")
    return (
        F.when(col(b, "snapshot_id") == col(c, "snapshot_id"), "same snapshot").when(~F.coalesce(col(b, "baseline_eligible"), F.lit(False)), "baseline")
        .when(col(b, "document_hash") != col(c, "document_hash"), "document").when(col(b, "page_numbers") != col(c, "page_numbers"), "pages")
    )


@dataclass(frozen=True)
class Assessment:
    profile: str
    experiment_id: str
    pages: list[int]
    dimensions: dict[int, list[str]]
    max_model_calls: int
    decision_scope: str
    minimum_average: float | None = None


def read_assessment(manifest: dict, page_numbers: list[int], model_calls: int) -> Assessment:
    """Validate one assessment manifest against its snapshot; ValueError says what is wrong."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    profile, experiment = manifest.get("profile"), str(manifest.get("experiment_id") or "").strip()
    need(profile in PROFILES, "profile")
    need(bool(experiment), "experiment_id")
    need(bool(page_numbers), "snapshot without pages")
    calls = (manifest.get("budget") or {}).get("max_model_calls") if isinstance(manifest.get("budget") or {}, dict) else None
    need(isinstance(calls, int) and calls >= 1, "max_model_calls")
    need(model_calls <= calls, "budget exceeded")
    known = set(page_numbers)
    if profile == "engineering_chain":
        review = manifest.get("manual_review")
        need(isinstance(review, dict), "manual_review")
        pages, criteria = review.get("pages"), review.get("criteria")
        need(isinstance(pages, list) and bool(pages), "review pages")
        need(isinstance(criteria, list) and bool(criteria) and all(isinstance(c, str) and c.strip() for c in criteria), "criteria")
        pages = [int(p) for p in pages]
        need(len(pages) == len(set(pages)) and known.issuperset(pages), "review pages")
        return Assessment(profile, experiment, pages, {p: [] for p in pages}, calls, "engineering_chain_only")
    need(calls <= FORMAL_CALLS, "budget")
    entries = manifest.get("pages")
    need(isinstance(entries, list) and len(entries) == FORMAL_PAGES, "page count")
    dims: dict[int, list[str]] = {}
    for entry in entries:
        page, own = (entry.get("page_no"), entry.get("dimensions")) if isinstance(entry, dict) else (None, None)
        need(isinstance(page, int) and page in known and page not in dims, "page")
        need(isinstance(own, list) and "source_evidence" in own and set(own) <= set(SCORED), "dimensions")
        dims[page] = list(own)
    return Assessment(profile, experiment, sorted(dims), dims, calls, "model_quality_scorecard", FORMAL_AVERAGE)


def python_round(x: Column, digits: int) -> Column:
    """Half to even on the exact binary value, as Python rounds; Spark's own round works on the decimal digits shown."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        unit = decimal.Decimal(1).scaleb(-digits)
        return pa.array([None if v is None else float(decimal.Decimal(v).quantize(unit, decimal.ROUND_HALF_EVEN)) for v in values.to_pylist()], pa.float64())

    return run(x.cast("double"))


def scorecard(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """assessments: assessment_id, profile, pages (array), minimum_average; reviews: assessment_id, page_no, verdict, scores, critical_errors, seq. One row each: status, pending pages, average, criticals."""
    last = fold(reviews, "assessment_id", "page_no")
    a = assessments.select("assessment_id", "profile", "pages", "minimum_average")
    pending = a.select("assessment_id", F.posexplode("pages").alias("pos", "page_no")).join(last.select("assessment_id", "page_no"), ["assessment_id", "page_no"], "left_anti")
    pending = pending.groupBy("assessment_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "page_no"))), lambda x: x["page_no"]).alias("pending"))
    scores = F.map_entries(F.coalesce("scores", F.create_map().cast("map<string,int>")))
    zero = F.filter(scores, lambda e: e["key"].isin("formula", "source_evidence") & (e["value"] == 0))
    zero = F.transform(F.array_sort(zero), lambda e: F.concat(F.lit("page-"), F.col("page_no").cast("string"), F.lit(": "), e["key"], F.lit("=0")))
    own = last.select("assessment_id", "page_no", "verdict", F.aggregate(scores, F.lit(0), lambda s, e: s + e["value"]).alias("total"), F.size(scores).alias("n"), F.coalesce("critical_errors", F.array().cast("array<string>")).alias("said"), zero.alias("zero"))
    by_page = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_no", c))), lambda x: x[c]))
    sums = own.groupBy("assessment_id").agg(F.bool_or(F.col("verdict") == "needs_review").alias("open"), F.bool_and(F.col("verdict") == "pass").alias("passed"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.concat(by_page("said"), by_page("zero")).alias("critical"))
    df = a.join(sums, "assessment_id", "left").join(pending, "assessment_id", "left")
    none = F.array().cast("array<string>")
    average = F.coalesce(python_round(F.try_divide("total", "n"), 3), F.lit(0.0))
    df = df.withColumn("average_score", F.when(F.col("profile") == "formal_scorecard", average)).withColumn("critical_failures", F.coalesce("critical", none))
    formal = (F.col("average_score") >= F.col("minimum_average")) & (F.size("critical_failures") == 0)
    good = F.when(F.col("profile") == "engineering_chain", F.coalesce("passed", F.lit(True))).otherwise(formal)
    status = F.when((F.coalesce(F.size("pending"), F.lit(0)) > 0) | F.coalesce("open", F.lit(False)), "review_required").when(good, "passed").otherwise("failed")
    return df.select("assessment_id", status.alias("quality_status"), F.coalesce("pending", F.array().cast("array<int>")).alias("pending_review_pages"), "average_score", "critical_failures")


def execution_status(inspected: DataFrame, key: str = "run_id") -> DataFrame:
    """complete where every page passed its checks (also where there is none), else incomplete."""
    return inspected.groupBy(key).agg(F.when(F.coalesce(F.bool_and(F.col("automatic_status") == "passed"), F.lit(True)), "complete").otherwise("incomplete").alias("execution_status"))


def signatures(page: Column) -> dict[str, Column]:
    """What of a page counts in each dimension, its texts being composed."""
    text = lambda c: normalize_text(c, nfc_form=False)
    blocks = F.filter(F.coalesce(page["blocks"], F.array().cast("array<struct<kind:string,content:string,latex:string,quote:string,order_no:int,bbox:array<double>,confidence:double,source:string>>")), lambda b: b.isNotNull())
    evidence = F.filter(page["evidence"], lambda e: e.isNotNull())
    of = lambda *kinds: F.filter(blocks, lambda b: F.coalesce(b["kind"].isin(*kinds), F.lit(False)))
    formula = lambda b: normalize_latex(F.coalesce(F.nullif(b["latex"], F.lit("")), b["content"]), nfc_form=False)
    return {
        "text": text(page["markdown"]),
        "structure": F.transform(blocks, lambda b, i: F.struct(F.coalesce(b["order_no"], i.cast("int")), b["kind"], text(b["content"]))),
        "formulas": F.transform(of("formula"), formula),
        "tables": F.transform(of("table"), lambda b: table_matrix(b["content"])),
        "figures": F.struct(F.transform(of(*FIGURES), lambda b: F.struct(b["kind"], text(b["content"]), b["bbox"])), F.coalesce(page["content_images"], F.array().cast("array<string>"))),
        "evidence": F.transform(F.coalesce(evidence, F.array().cast("array<struct<kind:string,page_no:int,quote:string,bbox:array<double>>>")), lambda e: F.struct(e["kind"], e["page_no"], text(e["quote"]), e["bbox"])),
    }


#: Bytes of both texts that a Python worker gets at once (a longer pair comes alone): what it holds is some times that, whatever the tables' size.
DIFF_BYTES = 2 << 20


def unified_diff(left: Column, right: Column) -> Column:
    @F.arrow_udf("array<string>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        lines = lambda t: (t.as_py() or "").splitlines()
        # One pair's lines at a time.
        return pa.array((list(difflib.unified_diff(lines(x), lines(y), lineterm="")) for x, y in zip(a, b, strict=True)), pa.list_(pa.string()))

    return run(left, right)


def compare_pages(wanted: DataFrame, baseline: DataFrame, candidate: DataFrame, nfc_form: bool = False, diff: bool = True) -> DataFrame:
    """wanted: comparison_id, page_no; sides: comparison_id, page_no, page. Per page: changed, changed_dimensions, review_status, text_diff.

    A page that a side lacks has changed in availability only, even where both lack it. nfc_form: for texts that may not be
    composed.
    """
    keys = ["comparison_id", "page_no"]
    if nfc_form:
        baseline, candidate = composed(baseline, "page"), composed(candidate, "page")
    df = wanted.join(baseline.select(*keys, F.col("page").alias("b")), keys, "left").join(candidate.select(*keys, F.col("page").alias("c")), keys, "left")
    lost = F.col("b").isNull() | F.col("c").isNull()
    left, right = signatures(F.col("b")), signatures(F.col("c"))
    differ = F.array_compact(F.array(*[F.when(~left[d].eqNullSafe(right[d]), F.lit(d)) for d in DIMENSIONS]))
    df = df.withColumn("changed_dimensions", F.when(lost, F.array(F.lit("availability"))).otherwise(differ)).withColumn("changed", F.size("changed_dimensions") > 0)
    df = df.withColumn("review_status", F.when(F.col("changed"), "pending").otherwise("not_required"))
    if diff:
        wanted.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(DIFF_BYTES))
        df = df.withColumn("text_diff", F.when(lost, F.array().cast("array<string>")).otherwise(unified_diff(left["text"], right["text"])))
    return df.drop("b", "c")


def comparison_conclusion(compared: DataFrame, reviews: DataFrame) -> DataFrame:
    """compared: comparison_id, page_no, changed; reviews: comparison_id, page_no, verdict, seq. Conclusion and pending pages; never a claim of improvement."""
    last = fold(reviews, "comparison_id", "page_no").select("comparison_id", "page_no", F.col("verdict").alias("_v"))
    df = compared.join(last, ["comparison_id", "page_no"], "left")
    wait = F.col("changed") & F.col("_v").isNull()
    sums = df.groupBy("comparison_id").agg(F.count_if("changed").alias("changed_count"), F.array_sort(F.collect_list(F.when(F.col("changed"), F.col("page_no")))).alias("changed_pages"), F.array_sort(F.collect_list(F.when(wait, F.col("page_no")))).alias("pending_review_pages"))
    open_ = last.groupBy("comparison_id").agg(F.bool_or(F.col("_v") == "needs_review").alias("_open"))
    df = sums.join(open_, "comparison_id", "left")
    conclusion = F.when(F.col("changed_count") == 0, "no_regression_detected").when((F.size("pending_review_pages") > 0) | F.coalesce("_open", F.lit(False)), "review_required").otherwise("changed")
    return df.withColumn("conclusion", conclusion).drop("_open")


def document_views(cases: DataFrame, snapshots: DataFrame, assessments: DataFrame, comparisons: DataFrame) -> DataFrame:
    """One row a case (case_id): its own columns, and the ids of its snapshots, assessments and comparisons in order."""
    df = cases
    for name, rows, key in (("snapshots", snapshots, "snapshot_id"), ("assessments", assessments, "assessment_id"), ("comparisons", comparisons, "comparison_id")):
        df = df.join(rows.groupBy("case_id").agg(F.array_sort(F.collect_list(key)).alias(name)), "case_id", "left")
        df = df.withColumn(name, F.coalesce(name, F.array().cast(rows.select(F.array(key)).schema[0].dataType)))
    return df


def assessment_views(assessments: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored assessments with how many reviews each has, and their quality computed anew from the last of them."""
    said = reviews.groupBy("assessment_id").agg(F.count(F.lit(1)).alias("reviews"))
    return assessments.join(scorecard(assessments, reviews), "assessment_id").join(said, "assessment_id", "left").withColumn("reviews", F.coalesce("reviews", F.lit(0)))


def comparison_views(comparisons: DataFrame, compared: DataFrame, reviews: DataFrame) -> DataFrame:
    """Stored comparisons with the changed pages that no review has met yet, and how many reviews there are."""
    said = reviews.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("reviews"))
    told = comparison_conclusion(compared, reviews).select("comparison_id", "pending_review_pages")
    df = comparisons.join(told, "comparison_id", "left").join(said, "comparison_id", "left")
    return df.withColumn("reviews", F.coalesce("reviews", F.lit(0))).withColumn("pending_review_pages", F.coalesce("pending_review_pages", F.array().cast(told.schema["pending_review_pages"].dataType)))


def asset_url(kind: str, key: Column, page_no: Column, pane: str) -> Column:
    """The relative address of a page's image: of an assessment's source, or of a comparison's source, baseline or candidate."""
    if (kind, pane) not in {("assessments", "source"), *(("comparisons", p) for p in ("source", "baseline", "candidate"))}:
        raise ValueError("kind and pane")
    return F.concat(F.lit(f"/api/v1/evaluations/{kind}/"), key, F.lit("/pages/"), page_no.cast("string"), F.lit(f"/assets/{pane}"))


def pane_snapshot(pane: Column) -> Column:
    """Which of a comparison's snapshots a pane shows; null for what is no pane."""
    return F.when(pane.isin("source", "baseline"), F.col("baseline_snapshot_id")).when(pane == "candidate", F.col("candidate_snapshot_id"))


def append_idempotent(existing: DataFrame, new: DataFrame, key: str, stable: list[str]) -> DataFrame:
    """new with outcome: created, existing (same stable columns) or conflict."""
    old = existing.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in stable], F.lit(True).alias("_there"))
    same = F.lit(True)
    for c in stable:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    df = new.join(old, key, "left")
    return df.withColumn("outcome", F.when(F.col("_there").isNull(), "created").when(same, "existing").otherwise("conflict")).drop("_there", *[f"_{c}" for c in stable])


def report_markdown(reports: DataFrame, reviews: DataFrame, title: str, facts: dict[str, str], key: str) -> DataFrame:
    """A report as Markdown: facts (label to column), then the reviews (key, page_no, verdict, reason) in page order."""
    line = F.concat(F.lit("- "), F.lit("Page "), F.col("page_no").cast("string"), F.lit(": `"), F.col("verdict"), F.lit("` - "), F.coalesce("reason", F.lit("")))
    said = reviews.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", line.alias("line")))), lambda x: x["line"]).alias("_lines"))
    df = reports.join(said, key, "left")
    head = [F.concat(F.lit(f"- {label}: `"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit("`")) for label, c in facts.items()]
    body = F.when(F.coalesce(F.size("_lines"), F.lit(0)) == 0, F.lit("No reviews yet.")).otherwise(F.array_join("_lines", "\n"))
    return df.withColumn("markdown", F.concat(F.concat_ws("\n", F.lit(f"# {title}"), F.lit(""), *head, F.lit(""), F.lit("## Reviews"), F.lit(""), body), F.lit("\n"))).drop("_lines")


def report_json(reports: DataFrame) -> DataFrame:
    return reports.withColumn("json", F.to_json(F.struct("*")))


def hide(df: DataFrame, *more: str) -> DataFrame:
    """Without columns that tell where things lie."""
    hidden = {"path", "source_path", "definition_path", "files", *more}
    return df.drop(*[c for c in df.columns if c in hidden or c.endswith("_backup")])


def run_contract_flaws(manifest: dict, run: dict, call_limit: int, attempts: int) -> list[str]:
    """What of a run (document_hash, page_start, page_end, model, params, budget) isn't as its manifest wants it."""
    pages = int(manifest["page_end"]) - int(manifest["page_start"]) + 1
    wanted = {k: manifest.get(k) for k in ("document_hash", "page_start", "page_end", "model", "params")} | {"budget": min(call_limit, pages * attempts)}
    return [k for k, v in wanted.items() if run.get(k) != v]


