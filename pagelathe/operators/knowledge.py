"""From extracted nodes and edges to a reviewed, published graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions.ids import digest
from pagelathe.functions.text import CONTEXT_CHARS, or_default, strip
from pagelathe.operators import search
from pagelathe.operators.runs import latest
from pagelathe.sources.schemas import BOX, EVIDENCE, RELATIONS


def first_match(quotes: DataFrame, texts: DataFrame, by: list[str], text: str, order: str) -> DataFrame:
    """For each quote (by, quote_id, quote) the first text of its group that holds it, in the order given; hit is null without one.

    A text is read once for all quotes of its group, never joined with each of them; an empty quote matches nothing.
    """
    found = search.first_holders(quotes, texts, by, text, order)
    return quotes.join(found, [*by, "quote"], "left").select(*quotes.columns, "hit")


def with_evidence(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items: document_id, pos, evidence_quote. Adds evidence: the first page that holds the quote, else the document's first page as context."""
    quotes = items.select("document_id", F.col("pos").alias("quote_id"), F.coalesce("evidence_quote", F.lit("")).alias("quote"))
    found = first_match(quotes, pages, ["document_id"], "markdown", "page_no")
    first = latest(pages.select("document_id", F.col("page_no").alias("_p"), F.col("markdown").alias("_m")), ["document_id"], [F.asc("_p")])
    df = found.join(first, "document_id", "left")
    # A quote that is nowhere keeps its words; without a quote the page's beginning stands in.
    words = F.when(F.col("hit").isNotNull() | (F.col("quote") != ""), F.col("quote")).otherwise(F.left("_m", F.lit(CONTEXT_CHARS)))
    own = F.struct(F.when(F.col("hit").isNotNull(), "text_quote").otherwise("page_context"), F.coalesce("hit", "_p").cast("int"), words, F.lit(None).cast(BOX))
    return items.join(df.select("document_id", F.col("quote_id").alias("pos"), F.array(own.cast(EVIDENCE)).alias("evidence")), ["document_id", "pos"])


def candidates_of(extracted: DataFrame, pages: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """extracted: document_id, nodes, edges (arrays, in the extractor's order). Candidates and edges of an extraction run.

    Of equal titles the first counts; an edge whose ends aren't both titles goes; an unknown relation is RELATED_TO.
    """
    nodes = extracted.select("document_id", F.posexplode("nodes").alias("pos", "n")).select("document_id", "pos", strip(F.coalesce("n.title", F.lit(""))).alias("title"), "n.kind", "n.content", "n.evidence_quote")
    nodes = latest(nodes.filter("title <> ''"), ["document_id", "title"], [F.asc("pos")])
    nodes = nodes.withColumn("id", digest(F.lit(run_id), F.col("document_id"), F.col("title"), digits=32))
    made = with_evidence(nodes, pages).select(
        "id", "document_id", or_default(F.col("kind"), "concept").alias("kind"), "title", F.coalesce("content", F.lit("")).alias("content"), "evidence",
        F.lit("needs_review").alias("review_status"), F.lit("").alias("review_reason"), F.lit(run_id).alias("extraction_run_id"),
    )
    titles = nodes.select("document_id", "title", "id")
    ends = extracted.select("document_id", F.posexplode("edges").alias("pos", "e")).select("document_id", "pos", "e.*")
    for end in ("source", "target"):
        ends = ends.join(titles.select("document_id", F.col("title").alias(f"{end}_title"), F.col("id").alias(f"{end}_id")), ["document_id", f"{end}_title"])
    relation = F.when(F.col("relation").isin(*RELATIONS), F.col("relation")).otherwise("RELATED_TO")
    edges = with_evidence(ends, pages).select(
        digest(F.lit(run_id), F.col("document_id"), F.lit("edge"), F.col("pos").cast("string"), digits=32).alias("id"), "document_id", "source_id", "target_id", relation.alias("relation"), "evidence",
        F.lit("needs_review").alias("review_status"), F.lit(run_id).alias("extraction_run_id"),
    )
    return made, edges


def accepted_snapshot(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted nodes, and accepted edges between them."""
    nodes = nodes.filter("review_status = 'accepted'")
    edges = edges.filter("review_status = 'accepted'")
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("node_id"))
    known = nodes.select(F.col("id").alias("node_id"))
    lost = ends.filter("node_id IS NOT NULL").join(known, "node_id", "left_anti").union(ends.filter("node_id IS NULL").select("node_id", "id"))
    return edges.join(lost.select("id").distinct(), "id", "left_semi")


def publish_flaws(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Why a document's graph can't be published: one row a document and flaw, none where it can. nodes and edges carry document_id."""
    n = nodes.groupBy("document_id").agg(F.bool_and(F.col("review_status") == "accepted").alias("ok")).withColumn("flaw", F.when(~F.col("ok"), "nodes not accepted"))
    e = edges.groupBy("document_id").agg(F.bool_and(F.col("review_status") == "accepted").alias("ok")).withColumn("flaw", F.when(~F.col("ok"), "edges not accepted"))
    loose = dangling_edges(nodes, edges).select("document_id").distinct().withColumn("flaw", F.lit("dangling edges"))
    empty = edges.select("document_id").distinct().join(n, "document_id", "left_anti").withColumn("flaw", F.lit("no nodes"))
    return n.select("document_id", "flaw").unionByName(e.select("document_id", "flaw")).filter("flaw IS NOT NULL").unionByName(loose).unionByName(empty)


def release(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a document: its graph as JSON, for an append-only release table."""
    pack = lambda df, name: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", *[c for c in df.columns if c not in ("id", "document_id")]))).alias(name))
    both = pack(nodes, "nodes").join(pack(edges, "edges"), "document_id", "left")
    return both.select("document_id", F.to_json(F.struct("nodes", "edges")).alias("snapshot_json"), F.lit("published").alias("status"))


def revise(snapshots: DataFrame, status: str = "draft") -> DataFrame:
    """snapshots: document_id, path, snapshot_json, created_at. Rows for the append-only table of workbook revisions; ids derive from document, content and time."""
    row = digest(F.col("document_id").cast("string"), F.col("snapshot_json"), F.col("created_at").cast("string"), digits=32)
    return snapshots.select(row.alias("id"), "document_id", "path", "snapshot_json", F.lit(status).alias("status"), "created_at")


def release_revisions(revisions: DataFrame, created_at: Column) -> DataFrame:
    """Releases of each document's newest revision, for the append-only table of releases; they name their revision."""
    newest = latest(revisions, ["document_id"], [F.desc("created_at"), F.desc("id")])
    return newest.select(digest(F.col("id"), F.lit("release"), digits=32).alias("id"), "document_id", F.col("id").alias("revision_id"), "snapshot_json", F.lit("published").alias("status"), created_at.alias("created_at"))


def newest_release(releases: DataFrame) -> DataFrame:
    return latest(releases.filter("status = 'published'"), ["document_id"], [F.desc("created_at"), F.desc("id")])


def graph_view(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the titles of their ends."""
    for end in ("source", "target"):
        edges = edges.join(nodes.select(F.col("id").alias(f"{end}_id"), F.col("title").alias(f"{end}_title")), f"{end}_id", "left")
    return edges.select("id", "relation", "source_title", "target_title")


def numbered(df: DataFrame, keys: list[str], order: str, name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
