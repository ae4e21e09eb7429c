"""From a parser's answer to page facts, and from page facts to their child tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.functions.geometry import can_crop, is_span_box, scaled_box
from pagelathe.functions.ids import digest
from pagelathe.functions.text import EVIDENCE_CHARS, QUOTE_CHARS, SPAN_CHARS, markdown_blocks, normalize_text, or_default, strip
from pagelathe.sources.schemas import BLOCK, BOX, EVIDENCE, PAGE_KINDS

BLANK_INK = 0.002
INK_LIMIT = 245
#: What a model's blocks look like before they are normalised.
MODEL_BLOCK = f"struct<kind:string,content:string,latex:string,quote:string,bbox_1000:{BOX},confidence:double,source:string>"
#: Quality issues.
NO_TEXT_LAYER, DEGRADED, NO_BLOCKS = "扫描页无文字层，正文来自视觉解析", "视觉解析降级：", "未识别到内容块"


def page_range(requests: DataFrame) -> DataFrame:
    """requests: page_count, page_start, page_end (null: to the last). One row a page; error where the range isn't within the document."""
    end = F.coalesce("page_end", "page_count")
    ok = (F.col("page_start") >= 1) & (end >= F.col("page_start")) & (end <= F.col("page_count"))
    pages = F.when(ok, F.sequence("page_start", end))
    return requests.withColumn("error", F.when(~F.coalesce(ok, F.lit(False)), F.lit("page range"))).withColumn("page_no", F.explode_outer(pages))


def pending_pages(wanted: DataFrame, finished: DataFrame) -> DataFrame:
    """Pages of a resumed run that aren't stored yet: wanted and finished by run_id, page_no."""
    return wanted.join(finished.select("run_id", "page_no"), ["run_id", "page_no"], "left_anti")


def ink_ratio(pixels: DataFrame, *keys: str) -> DataFrame:
    """pixels: keys, r, g, b. Share of pixels whose darkest channel is below the limit."""
    dark = F.count_if(F.least("r", "g", "b") < INK_LIMIT)
    return pixels.groupBy(*keys).agg((dark / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("ink_ratio"))


def render_pages(files: DataFrame, renderer: Callable[[bytes], list[dict]], columns: str) -> DataFrame:
    """files: document_id, content. Pages as a pluggable renderer (PDF to image, ink ratio, text layer) gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, content in zip(b["document_id"], b["content"], strict=True):
                rows = renderer(content)
                if rows:
                    yield pd.DataFrame(rows).assign(document_id=doc)

    return files.select("document_id", "content").mapInPandas(run, columns)


def native_blocks(raw: Column) -> Column:
    """raw: array of (text, bbox) of the text layer. Blank ones go; order_no is the place before that."""
    made = F.transform(
        raw,
        lambda b, i: F.struct(
            F.lit("paragraph").alias("kind"), strip(b["text"]).alias("content"), F.lit(None).cast("string").alias("latex"), F.left(strip(b["text"]), F.lit(QUOTE_CHARS)).alias("quote"),
            i.cast("int").alias("order_no"), b["bbox"].alias("bbox"), F.lit(1.0).alias("confidence"), F.lit("pymupdf").alias("source"),
        ),
    )
    return F.filter(made, lambda b: b["content"] != "")


def normalize_schema(page: DataFrame) -> DataFrame:
    """page: markdown, blocks, page_kind, has_blocks, has_kind. An answer of Markdown alone gets blocks; adds schema_tag."""
    bare = ~F.col("has_blocks") & ~F.col("has_kind")
    blank = strip(F.coalesce("markdown", F.lit(""))) == ""
    made = F.transform(markdown_blocks(F.col("markdown")), lambda b: F.struct(b["kind"], b["content"], b["latex"], b["quote"], F.lit(None).cast(BOX).alias("bbox_1000"), b["confidence"], b["source"]).cast(MODEL_BLOCK))
    tag = F.when(~bare, "native_page").when(blank, "invalid").otherwise("markdown_only")
    page = page.withColumn("schema_tag", tag)
    return page.withColumn("blocks", F.when(tag == "markdown_only", made).otherwise(F.col("blocks"))).withColumn("page_kind", F.when(tag == "markdown_only", "content").otherwise(F.col("page_kind")))


def page_flaw(kind: Column, markdown: Column, blocks: Column) -> Column:
    """Why an answer is no valid page, or null."""
    empty = (strip(F.coalesce(markdown, F.lit(""))) == "") | F.coalesce(F.size(blocks) == 0, F.lit(True))
    return (
        F.when(~F.coalesce(kind.isin(*PAGE_KINDS), F.lit(False)), "page_kind").when(markdown.isNull() | blocks.isNull(), "types")
        .when((kind != "blank") & empty, "empty").when(F.exists(blocks, lambda b: b.isNull()), "block")
    )


def normalize_blocks(blocks: Column, native: Column, width: Column, height: Column) -> Column:
    """Model blocks in full; boxes from the first native block that holds the quote's beginning, else scaled. order_no keeps the model's places. Without any: the native ones."""

    def block(b: Column, i: Column) -> Column:
        quote = F.left(F.coalesce(F.nullif(b["quote"], F.lit("")), b["content"], F.lit("")), F.lit(QUOTE_CHARS))
        home = F.get(F.filter(native, lambda n: (quote != "") & n["content"].contains(F.left(quote, F.lit(30)))), F.lit(0))
        box = F.when(home.isNotNull(), home["bbox"]).otherwise(scaled_box(b["bbox_1000"], width, height))
        sure = F.when(F.coalesce(b["confidence"], F.lit(0.0)) == 0, F.lit(0.5)).otherwise(b["confidence"])
        return F.struct(
            or_default(b["kind"], "paragraph").alias("kind"), b["content"].alias("content"), F.nullif(b["latex"], F.lit("")).alias("latex"), quote.alias("quote"),
            i.cast("int").alias("order_no"), box.alias("bbox"), sure.alias("confidence"), or_default(b["source"], "vision").alias("source"),
        ).cast(BLOCK)

    made = F.filter(F.transform(blocks, block), lambda b: strip(F.coalesce(b["content"], F.lit(""))) != "")
    return F.when(F.coalesce(F.size(made) > 0, F.lit(False)), made).otherwise(native)


def page_evidence(raw_text: Column, native: Column, page_no: Column, width: Column, height: Column) -> Column:
    quote = F.left(F.coalesce(raw_text, F.lit("")), F.lit(EVIDENCE_CHARS))
    whole = F.array(F.lit(0.0), F.lit(0.0), width.cast("double"), height.cast("double"))
    own = F.struct(F.when(quote != "", "text_quote").otherwise("page_image"), page_no.cast("int"), quote, F.when(quote != "", F.get(native, F.lit(0))["bbox"]).otherwise(whole))
    return F.array(own.cast(EVIDENCE))


def page_quality(raw_text: Column, blocks: Column, parser_error: Column, kind: Column, ink: Column, provider: Column | None = None) -> Column:
    """provider: what the parser told of itself (model, attempts), as text."""
    none = F.coalesce(raw_text, F.lit("")) == ""
    issues = F.array_compact(F.array(F.when(none & (kind != "blank"), NO_TEXT_LAYER), F.when(parser_error.isNotNull() & (parser_error != ""), F.concat(F.lit(DEGRADED), parser_error)), F.when(F.coalesce(F.size(blocks), F.lit(0)) == 0, NO_BLOCKS)))
    return F.struct(
        F.lit("needs_review").alias("status"), issues.alias("issues"), kind.alias("page_kind"), F.length(F.coalesce(raw_text, F.lit(""))).cast("int").alias("native_text_chars"), F.round(ink, 6).alias("ink_ratio"), (F.lit(None) if provider is None else provider).cast("string").alias("provider")
    )


def page_facts(parsed: DataFrame) -> DataFrame:
    """parsed: run_id, document_id, page_no, width, height, ink_ratio, raw_text, native (as native_blocks gives), model (struct page_kind, markdown, blocks; or null), parser_error, and maybe provider. Page facts, and an error where a page can't be one."""
    raw = F.coalesce("raw_text", F.lit(""))
    # A failed parser is replaced by the text layer, where there is one.
    fallback = F.struct(F.lit("content").alias("page_kind"), raw.alias("markdown"), F.lit(None).cast(f"array<{MODEL_BLOCK}>").alias("blocks"))
    lost = F.col("model").isNull() & (raw == "")
    df = parsed.withColumn("m", F.when(F.col("model").isNull(), fallback).otherwise(F.col("model").cast(f"struct<page_kind:string,markdown:string,blocks:array<{MODEL_BLOCK}>>")))
    kind = F.when(F.coalesce(F.col("m.page_kind").isin(*PAGE_KINDS), F.lit(False)), F.col("m.page_kind")).otherwise("content")
    df = df.withColumn("markdown", strip(F.coalesce(F.nullif(F.col("m.markdown"), F.lit("")), raw)))
    empty = (F.col("markdown") == "") & (kind != "blank")
    df = df.withColumn("page_kind", F.when(empty & (F.col("ink_ratio") < BLANK_INK), "blank").otherwise(kind))
    df = df.withColumn("blocks", normalize_blocks(F.col("m.blocks"), F.col("native"), F.col("width"), F.col("height")))
    bare = F.coalesce(F.size("blocks") == 0, F.lit(True)) & (F.col("page_kind") != "blank")
    df = df.withColumn("error", F.when(lost, F.coalesce("parser_error", F.lit("parser"))).when((F.col("markdown") == "") & (F.col("page_kind") != "blank"), "empty text").when(bare, "no blocks"))
    w, h = F.col("width"), F.col("height")
    return df.select(
        "run_id", "document_id", F.lit(1).alias("schema_version"), "page_no", "page_kind", "markdown", "blocks",
        page_evidence(raw, F.col("native"), F.col("page_no"), w, h).alias("evidence"),
        page_quality(raw, F.col("blocks"), F.left("parser_error", F.lit(SPAN_CHARS)), F.col("page_kind"), F.col("ink_ratio"), F.col("provider") if "provider" in parsed.columns else None).alias("quality"),
        F.format_string("pages/page-%04d.png", "page_no").alias("page_image"),
        F.transform(F.filter("blocks", lambda b: can_crop(b["kind"], b["bbox"], w, h)), lambda b: F.format_string("images/page-%04d-%s-%03d.png", "page_no", b["kind"], b["order_no"])).alias("content_images"),
        "error",
    )


def child_rows(pages: DataFrame) -> dict[str, DataFrame]:
    """pages: id, page_no, blocks, quality. Their blocks, source spans and quality reports; ids derive from the page and place."""
    each = pages.select("id", "page_no", F.posexplode("blocks").alias("pos", "b"))
    block_id = digest(F.col("id"), F.lit("block"), F.col("pos").cast("string"), digits=32)
    blocks = each.select(
        block_id.alias("id"), F.col("id").alias("page_id"), or_default(F.col("b.kind"), "paragraph").alias("kind"), F.coalesce("b.content", F.lit("")).alias("content"), F.col("b.latex").alias("latex"),
        F.coalesce("b.order_no", "pos").alias("order_no"), F.coalesce("b.confidence", F.lit(0.0)).cast("float").alias("confidence"), or_default(F.col("b.source"), "unknown").alias("source"),
    )
    quoted = F.left(F.coalesce(F.nullif(F.col("b.quote"), F.lit("")), "b.content", F.lit("")), F.lit(SPAN_CHARS))
    spans = each.select(digest(F.col("id"), F.lit("span"), F.col("pos").cast("string"), digits=32).alias("id"), block_id.alias("block_id"), "page_no", F.col("b.bbox").alias("bbox"), quoted.alias("quoted_text"))
    metrics = F.to_json(F.struct("quality.page_kind", "quality.native_text_chars", "quality.ink_ratio", "quality.provider"))
    quality = pages.select(digest(F.col("id"), F.lit("quality"), digits=32).alias("id"), F.col("id").alias("page_id"), F.coalesce("quality.status", F.lit("needs_review")).alias("status"), F.coalesce("quality.issues", F.array().cast("array<string>")).alias("issues"), metrics.alias("metrics"))
    return {"content_blocks": blocks, "source_spans": spans, "quality_reports": quality}


def document_text(pages: DataFrame, *keys: str, gap: str = "\n\n") -> DataFrame:
    """One text a document: its pages in order under headings. gap: what follows a heading (one line end for prompts)."""
    part = F.concat(F.lit("## 第 "), F.col("page_no").cast("string"), F.lit(f" 页{gap}"), F.coalesce("markdown", F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col("page_no"), part.alias("part"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"))


def inspect_pages(pages: DataFrame, images: DataFrame) -> DataFrame:
    """pages: page_no, page (struct or null) per key run_id; images: run_id, page_no that have a page image. Six checks, those that failed, passed or failed."""
    # A run's pages are few and its key is whole: one row a page either side.
    df = pages.join(images.select("run_id", "page_no").distinct().withColumn("_img", F.lit(True)), ["run_id", "page_no"], "left")
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False)) & ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
    bounds = F.forall("page.evidence", lambda e: F.coalesce((e["page_no"] == F.col("page_no")) & is_span_box(e["bbox"]), F.lit(False)))
    checks = {
        "page_json": F.col("page").isNotNull(), "page_image": F.coalesce("_img", F.lit(False)), "markdown": F.coalesce(normalize_text(F.col("page.markdown"), nfc_form=False) != "", F.lit(False)) & F.col("page").isNotNull(),
        "blocks": some("page.blocks"), "evidence": some("page.evidence"), "evidence_bounds": F.coalesce(F.size("page.evidence") > 0, F.lit(False)) & F.coalesce(bounds, F.lit(False)),
    }
    df = df.select("run_id", "page_no", F.struct(*[c.alias(n) for n, c in checks.items()]).alias("checks"))
    failed = F.array_compact(F.array(*[F.when(~F.col(f"checks.{n}"), F.lit(n)) for n in checks]))
    return df.select("run_id", "page_no", "checks", failed.alias("failed_checks")).withColumn("automatic_status", F.when(F.size("failed_checks") == 0, "passed").otherwise("failed"))
