"""Golden-output regression: a run's pages against the expected ones, as rows of named checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.geometry import MIN_OVERLAP, is_page_box, overlap
from pagelathe.functions.text import normalize_latex, normalize_text, table_matrix
from pagelathe.operators.manifest import verify

CHECK = "array<struct<name:string,passed:boolean,detail:string>>"


def _check(name: Column, passed: Column, detail: str | Column) -> Column:
    return F.struct(name.alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _box_checks(name: Column, want: Column, have: Column, w: Column, h: Column, threshold: float) -> list[Column]:
    fine = is_page_box(have, w, h)
    iou = F.when(fine & is_page_box(want, w, h), overlap(want, have))
    text = F.when(iou.isNull(), "box missing or not on the page").otherwise(F.format_string("overlap %.3f, least %.3f", iou, F.lit(threshold)))
    return [_check(F.concat(name, F.lit(".bounds")), fine, "box lies on the page"), _check(F.concat(name, F.lit(".iou")), iou >= threshold, text)]


def _rows(df: DataFrame, keys: list[str], checks: Column) -> DataFrame:
    return df.select(*keys, F.explode(checks).alias("c")).select(*keys, "c.*")


def compare_pages(expected: DataFrame, actual: DataFrame, threshold: float = MIN_OVERLAP, nfc_form: bool = False) -> DataFrame:
    """expected: page_no, width, height, page; actual: page_no, page. Checks of fields, text, blocks and evidence by place.

    More blocks than expected only fail the count; missing ones are left out beside it.
    """
    text = lambda c: normalize_text(c, nfc_form)
    df = expected.select("page_no", "width", "height", F.col("page").alias("e")).join(actual.select("page_no", F.col("page").alias("a")), "page_no", "left")
    name = F.format_string("page-%04d", "page_no")
    lost = df.filter("a IS NULL").select(F.array(_check(F.concat(name, F.lit(".json")), F.lit(False), "page can't be read")).alias("checks"))
    df = df.filter("a IS NOT NULL").withColumn("name", name)
    same = lambda f: F.col(f"a.{f}").eqNullSafe(F.col(f"e.{f}"))
    dot = lambda s: F.concat("name", F.lit(f".{s}"))
    top = [_check(dot(f), same(f), "as expected") for f in ("schema_version", "page_no", "page_kind")]
    top.append(_check(dot("markdown"), text(F.col("a.markdown")) == text(F.col("e.markdown")), "text as expected"))
    lists = {"blocks": "blocks", "evidence": "evidence"}
    for part in lists:
        both = F.col(f"a.{part}").isNotNull() & F.col(f"e.{part}").isNotNull()
        count = _check(dot(f"{part}.count"), F.size(f"a.{part}") == F.size(f"e.{part}"), F.format_string("expected %d, found %d", F.size(f"e.{part}"), F.size(f"a.{part}")))
        top.append(F.when(both, count).otherwise(_check(dot(part), F.lit(False), "must be a list")))
    out = df.select(F.array(*top).alias("checks"))
    # One row a block (or piece of evidence) of either side, met by page and place.
    for part, label in (("blocks", "block"), ("evidence", "evidence")):
        e = df.select("page_no", "name", "width", "height", F.posexplode(f"e.{part}").alias("pos", "x"))
        a = df.select("page_no", F.posexplode(f"a.{part}").alias("pos", "y"))
        j = e.join(a, ["page_no", "pos"]).filter("y IS NOT NULL").withColumn("p", F.concat("name", F.format_string(f".{label}-%02d", F.col("pos") + 1)))
        own = lambda s: F.concat("p", F.lit(f".{s}"))
        field = lambda f: _check(own(f), F.col(f"y.{f}").eqNullSafe(F.col(f"x.{f}")), "as expected")
        box = _box_checks(own("bbox"), F.col("x.bbox"), F.col("y.bbox"), F.col("width"), F.col("height"), threshold)
        if part == "blocks":
            checks = [
                field("order_no"), field("kind"), _check(own("content"), text(F.col("y.content")) == text(F.col("x.content")), "content as expected"),
                F.when(F.col("x.kind") == "formula", _check(own("latex"), normalize_latex(F.col("y.latex"), nfc_form) == normalize_latex(F.col("x.latex"), nfc_form), "formula as expected")),
                F.when(F.col("x.kind") == "table", _check(own("table"), table_matrix(F.col("y.content"), nfc_form).eqNullSafe(table_matrix(F.col("x.content"), nfc_form)), "table as expected")), *box,
            ]
        else:
            checks = [field("kind"), field("page_no"), _check(own("quote"), text(F.col("y.quote")) == text(F.col("x.quote")), "quote as expected"), *box]
        out = out.unionByName(j.select(F.array_compact(F.array(*checks)).alias("checks")))
    return _rows(out.unionByName(lost), [], F.col("checks").cast(CHECK))


def compare_images(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Content images of pages by place: page_no, pos, sha256 (null: file is missing) on both sides; every page of either side."""
    count = lambda df, n: df.groupBy("page_no").agg(F.count(F.lit(1)).alias(n))
    sums = count(expected, "ne").join(count(actual, "na"), "page_no", "full").na.fill(0, ["ne", "na"])
    name = F.format_string("page-%04d.content-images", "page_no")
    counts = sums.select(_check(F.concat(name, F.lit(".count")), F.col("ne") == F.col("na"), F.format_string("expected %d, found %d", "ne", "na")).alias("c"))
    both = expected.join(actual.select("page_no", "pos", F.col("sha256").alias("_h")), ["page_no", "pos"])
    each = both.select(_check(F.concat(name, F.format_string(".%d", F.col("pos") + 1)), F.col("sha256") == F.col("_h"), "same content").alias("c"))
    return counts.unionByName(each).select("c.*")


def compare_manifest(entries: DataFrame, files: DataFrame, expected_pages: list[int], actual_pages: list[int]) -> DataFrame:
    """Integrity of the run's manifest against its files, and its page numbers against the expected ones."""
    bad = verify(entries, files).agg(F.count_if(F.col("state") != "ok").alias("n"), F.min(F.when(F.col("state") != "ok", F.concat_ws(" ", "state", "path"))).alias("first"))
    own = bad.select(_check(F.lit("actual.manifest.integrity"), F.col("n") == 0, F.coalesce("first", F.lit("all files match"))).alias("c"))
    pages = bad.select(_check(F.lit("actual.manifest.page_numbers"), F.lit(list(expected_pages) == list(actual_pages)), "pages as expected").alias("c"))
    return own.unionByName(pages).select("c.*")


def report(checks: DataFrame) -> DataFrame:
    """One row: passed (also without any check), how many failed, and their names in order."""
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.count_if(~F.col("passed")).alias("n_failed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("name")))).alias("failed"))
