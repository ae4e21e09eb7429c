"""Mixing sources to target weights: hierarchical token budgets and seeded epochs. DataFrame functions only.

A leaf is a (domain, language, source); each level has integer weights. A node's budget is shared among its children by
weight, no child getting more than its subtree can supply (its tokens times max_epochs); what a child can't supply goes
to its siblings, and only when a whole subtree is short does the rest reach the ancestor's other children. All shares
are integers that add up exactly. A leaf then takes whole epochs and, of one more seeded epoch, the prefix of tokens
that fills its quota: the documents in order of md5(seed, epoch, doc_id), the last one in part.

Defined results: null domain, language or source count as the empty string; a null text has no tokens; repeated rows
are documents of their own (equal ones are interchangeable); very long texts are counted whole, and cut only where a
quota ends within one; an empty table gives no rows; other columns are in a struct, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import cut, small_side

#: Slices of a seeded epoch: token sums are taken by slice, and only the slice that holds the quota's end is sorted.
SLICES = 4096
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """weights: by level and name, 1 where not named. budget_pct: of all tokens; budget: tokens, instead of it."""

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_pct: int = 60
    budget: int | None = None
    max_epochs: int = 2
    seed: int = 17


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    out = F.lit(1)
    for name, w in sorted(mix.weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(df: DataFrame, parents: list[str], child: str, mix: Mix) -> DataFrame:
    """df: parents, child, cap, budget (the parent's). Adds quota by water filling: children in order of cap / weight."""
    df = df.withColumn("w", _weight(child, mix))
    by = Window.partitionBy(*parents, F.lit(0))
    order = by.orderBy(F.expr("cap * 1000 div w"), child)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("full", (F.col("budget") - before) * F.col("w") >= F.col("cap") * after)
    df = df.withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)))
    df = df.withColumn("wall", F.sum(F.when(~F.col("full"), F.col("w"))).over(by))
    df = df.withColumn("wcum", F.sum(F.when(~F.col("full"), F.col("w")).otherwise(F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    part = F.expr("(left * wcum) div wall - (left * (wcum - w)) div wall")
    return df.withColumn("quota", F.when(F.col("full"), F.col("cap")).otherwise(F.least(part, F.col("cap")))).drop("w", "full", "left", "wall", "wcum", "budget")


def plan(slim: DataFrame, mix: Mix) -> DataFrame:
    """One row a leaf: supply, quota, epochs (whole ones), rest (tokens of one more), edge (its last slice), edge_at (tokens before that slice)."""
    leaves = cut(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")).withColumn("cap", F.col("supply") * mix.max_epochs), "leaves")
    # The root's children are the domains: a handful of rows.
    root = Window.partitionBy(F.lit(0))
    wanted = F.lit(mix.budget).cast("long") if mix.budget is not None else F.expr(f"allsupply * {int(mix.budget_pct)} div 100")
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("supply").alias("supply"))
    domains = domains.withColumn("allsupply", F.sum("supply").over(root)).withColumn("budget", F.least(wanted, F.sum("cap").over(root)))
    domains = _share(domains, [], "domain", mix).select("domain", F.col("quota").alias("budget"))
    langs = _share(leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap")).join(domains, "domain"), ["domain"], "lang", mix)
    langs = langs.select("domain", "lang", F.col("quota").alias("budget"))
    leaves = _share(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", mix)
    leaves = leaves.withColumn("epochs", F.coalesce(F.expr("quota div nullif(supply, 0)"), F.lit(0)))
    leaves = cut(leaves.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("supply")).select(*LEVELS, "supply", "quota", "epochs", "rest"), "quotas")
    sums = slim.join(small_side(leaves.filter("rest > 0")), list(LEVELS)).withColumn("slice", _slice(mix)).groupBy(*LEVELS, "rest", "slice").agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = sums.withColumn("upto", upto).filter("upto >= rest").groupBy(*LEVELS).agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("t")).alias("at")), F.col("slice")).alias("e"))
    return cut(leaves.join(edge, list(LEVELS), "left").select(*leaves.columns, F.col("e.slice").alias("edge"), F.col("e.at").alias("edge_at")), "mix")


def _order_hash(mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def _slice(mix: Mix) -> Column:
    return F.conv(F.substring(_order_hash(mix), 1, 3), 16, 10).cast("int")


def slim_of(docs: DataFrame, domain: Column) -> DataFrame:
    """docs (doc_id, text, lang, source) to a struct row of all columns, the leaf's three names and tokens."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("row"), "doc_id", text(domain).alias("domain"), text(F.col("lang")).alias("lang"), text(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens"))


def take(base: DataFrame, leaves: DataFrame, mix: Mix) -> DataFrame:
    """base: as slim_of gives it. Adds epochs (whole copies) and part (tokens of the last, partial epoch) to each row.

    Only the edge slices are sorted, each a few thousandths of its leaf, so a hot leaf is no single task.
    """
    df = base.join(small_side(leaves.drop("quota", "supply")), list(LEVELS)).withColumn("h", _order_hash(mix)).withColumn("slice", _slice(mix))
    inner = df.filter(F.col("edge").isNull() | (F.col("slice") != F.col("edge"))).withColumn("part", F.when(F.col("slice") < F.col("edge"), F.col("tokens")).otherwise(F.lit(0)))
    w = Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("edge_at") + F.coalesce(F.sum("tokens").over(w), F.lit(0))
    outer = df.filter(F.col("slice") == F.col("edge")).withColumn("part", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - before)))
    return inner.unionByName(outer).select(*base.columns, "epochs", F.col("part").cast("long").alias("part"))


def mix_documents(docs: DataFrame, domain: Column, mix: Mix) -> DataFrame:
    """One row a document: row (struct of its columns), leaf, tokens, epochs, part."""
    slim = cut(slim_of(docs, domain).drop("row"), "slim")
    return take(slim_of(docs, domain), plan(slim, mix), mix)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mixed corpus in docs' columns: each document as often as its epochs say, and whole once more if the partial epoch reaches it."""
    copies = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    return mixed.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).select("row.*")
