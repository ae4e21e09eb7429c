"""Many quotes in many texts: an automaton of quotes reads each text once, over a grid of groups of quotes and of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of quotes that one automaton holds, and of texts that one cell of the grid reads.
QUOTES, TEXTS = 4 << 20, 64 << 20


def first_holders(quotes: DataFrame, texts: DataFrame, by: list[str], text: str, order: str, quote_chars: int = QUOTES, text_chars: int = TEXTS) -> DataFrame:
    """by, quote and hit: for each distinct quote of a group the least ``order`` of the group's texts that hold it; no row where none does.

    A group's quotes are dealt over as many automata as their length asks for, and its texts over as many readers; every
    automaton meets every reader of its group once. So a text is copied once for each automaton (one, unless a group's
    quotes are many), is read in one pass however many quotes there are, and gives a row for each quote that it is the
    first to hold in its cell. Null and empty quotes and null texts and orders take no part.
    """
    kind = dict(texts.dtypes)[order]
    own = [F.col(c).alias(f"_{i}") for i, c in enumerate(by)]
    key = [f"_{i}" for i in range(len(by))]
    q = quotes.filter("quote <> ''").select(*own, F.col("quote").alias("word")).distinct()
    t = texts.filter(F.col(text).isNotNull() & F.col(order).isNotNull()).select(*own, F.col(order).alias("place"), F.col(text).alias("word"))
    many = lambda df, chars, name: df.groupBy(*key).agg(F.ceil(F.sum(F.length("word")) / chars).cast("int").alias(name))
    # Two numbers a group: how many automata and how many readers.
    grid = many(q, quote_chars, "automata").join(many(t, text_chars, "readers"), key)
    place = F.lit(None).cast(kind)
    deal = lambda df, by_, n: F.pmod(F.xxhash64(*by_), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(grid, key).withColumn("a", deal(q, ["word"], "automata")).withColumn("r", each("readers")).select(*key, "a", "r", F.lit(0).alias("side"), place.alias("place"), "word")
    t = t.join(grid, key).withColumn("r", deal(t, ["place", "word"], "readers")).withColumn("a", each("automata")).select(*key, "a", "r", F.lit(1).alias("side"), "place", "word")
    cells = q.unionByName(t).withColumn("cell", F.xxhash64(*key, "a", "r"))
    cells = cells.repartition("cell").sortWithinPartitions("cell", *key, "a", "r", "side").select(*key, "a", "r", "side", "place", "word")
    found = cells.mapInArrow(_read(len(by)), ", ".join([f"_{i} {dict(quotes.dtypes)[c]}" for i, c in enumerate(by)] + ["quote string", f"hit {kind}"]))
    out = found.groupBy(*key, "quote").agg(F.min("hit").alias("hit"))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(by)], "quote", "hit")


def _read(n: int):
    """Cells in order, the quotes of each ahead of its texts, to the first place of each quote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        cell, automaton, ready, first, kinds = None, None, False, {}, None

        def done() -> pa.RecordBatch:
            rows = [(*cell[:n], quote, place) for quote, place in first.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*[f"_{i}" for i in range(n)], "quote", "hit"])

        for b in batches:
            kinds = [*[b.column(i).type for i in range(n)], pa.string(), b.column(n + 3).type]
            for *at, side, place, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at != cell:
                    if first:
                        yield done()
                    cell, automaton, ready, first = at, ahocorasick.Automaton(), False, {}
                if side == 0:
                    automaton.add_word(word, word)
                    continue
                if not ready:
                    if len(automaton):
                        automaton.make_automaton()
                    ready = True
                if len(automaton):
                    for quote in {x for _, x in automaton.iter(word)}:
                        if quote not in first or place < first[quote]:
                            first[quote] = place
        if first:
            yield done()

    return run
