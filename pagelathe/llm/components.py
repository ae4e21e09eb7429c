"""Connected components of a graph of links, by alternating stars; every round is a table in the shared folder.

Defined results: links with a null end, and of a node with itself, take no part; repeated links count once, in either
direction; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import cut


def _stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether each node of distinct edges (u > v) is a root, or else hangs on one root and nothing on it; and how many edges there are."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    more, rows = nodes.agg(F.max(F.expr("up > 1 OR up = 1 AND down = 1")), F.sum("up")).first()
    return not more, rows or 0


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node and root (the component's least node) for every node of a link with two ends.

    Rounds grow with the logarithm of a component's size, none where the links are stars already; a hot node's links are
    joined with its least neighbour only, which the session may split.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not (stars := _stars(edges))[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small, "links", stars[1])
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
