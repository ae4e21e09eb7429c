"""Exact n-gram Jaccard join as a recursive partition of the metric space of shingle sets.

Jaccard distance is a metric, so a pivot splits a set of documents into a region near it and the rest, and a document
near a region's edge is needed on both sides: if x and y are at most t apart, their distances to any pivot differ by at
most t. Document pivots alone can't split a whole corpus, though: unrelated texts are at distance 1 of each other and of
any document, so every window would hold everything. The pivots of the first level are therefore the smallest sets there
are, those of one shingle. A document is nearest, at 1 - 1/n, to the pivots that it contains; its home is the first of
them in a fixed order (rare shingles first). What windows are by the triangle inequality elsewhere follows here from the
distance itself: two sets within t of each other share one of the first n - ceil((1 - t) n) + 1 pivots of either, so a
document is replicated to that many regions.

Next levels: a region of more than ``small`` documents gets document pivots. A document within t of a pivot is linked to
the nearest one and so to all of its region; documents of different regions are compared only where both lie within 2t
of the other's pivot (a link spans at most t, a region t); documents outside of every region are compared with those
whose distances to every pivot differ by at most t. What is left of a region is a region again, split by new pivots,
until it is small, or the levels are through. What is left then is compared outright: with the square of its size in
comparisons of sizes, distances to pivots and bitmaps, but in blocks of bounded size, so that a region is many tasks'
work, and only pairs that may be linked become rows. Candidates are bounded by shared pivots and places in the order, and
verified against the whole sets, so the result is exact but for 64-bit hashes.

Equal sets are one point of the space: copies are never paired. Names of components reach documents by joins on
components and texts, of narrow rows: where one has a large share of all, that the session splits (adaptive execution).

Defined results: null or empty texts and texts without words have an empty set and no links; a null doc_id never names a
component unless all of the component's ids are null; repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, parts_of, release, small_side
from pagelathe.llm.components import components
from pagelathe.llm.shingles import fingerprint, shingle_sets

#: Threshold as a fraction: similarity of NUM / DEN at least.
NUM, DEN = 80, 100
BUCKETS, BLOCKS = 21, 16
#: Ids up to which the documents to fetch are told to the scan in an array of eight bytes each.
SHIPPED = 4_000_000


#: Pairs up to which they are told to a scan, in 24 bytes each; bits of a bitmap.
SHIPPED_PAIRS, BITS = 1_000_000, 2048
#: The most pivots of a cell on each level; what is left of the last is compared outright. The first few connect most of
#: a group of near copies, the more are for what those leave.
PIVOTS = (3, 12, 64)
#: Members of a cell that are compared with its others as one task's work.
BLOCKED = 2048


def prefix_size(n: np.ndarray | int):
    """Pivots of which a partner must share one: n - ceil(NUM / DEN n) + 1."""
    return n - -(-NUM * n // DEN) + 1


def linked(inter, a, b):
    return DEN * inter >= NUM * (a + b - inter)


def _survey(size: int):
    """doc_id, text, key to doc_id, key, n, fp; and per task how many documents hold a shingle of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(1 << BUCKETS, np.uint32)
        names = ["doc_id", "key", "n", "fp", "block", "counts"]
        for b in batches:
            n, fp = [], []
            for s in shingle_sets(b.column(1).to_pylist(), size):
                n.append(len(s))
                fp.append(fingerprint(s))
                np.add.at(counts, (s >> np.uint64(64 - BUCKETS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        for i, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=names)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the bucket counts per block that a task gets."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            sums[block] = sums[block] + part if block in sums else part
    for block, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(np.minimum(part, 2**32 - 1).astype(np.uint32).tobytes(), 1)])], names=["block", "counts"])


def rarity(survey: DataFrame) -> np.ndarray:
    """A class (0: rare, to 15) for each of the fixed number of buckets of shingles; any order is right, this one keeps common passages last."""
    parts = survey.filter("block IS NOT NULL").select("block", "counts")
    # Tasks' sums are added in two steps, so that no task reads the counts of all.
    some = parts.repartition(BLOCKS * 4, "block", F.pmod(F.monotonically_increasing_id(), F.lit(4))).mapInArrow(_add_up, "block int, counts binary")
    total = np.zeros(1 << BUCKETS, np.float64)
    for row in some.repartition(BLOCKS, "block").mapInArrow(_add_up, "block int, counts binary").collect():
        width = (1 << BUCKETS) // BLOCKS
        total[row["block"] * width : (row["block"] + 1) * width] += np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    # A bucket also counts the many rare shingles that fall into it: only what stands out of their chance spread tells.
    mean = total.mean()
    return np.minimum(15, np.log2(1 + np.maximum(0.0, total - mean - 4 * np.sqrt(mean)) / 4)).astype(np.uint8)


def _first_pivots(size: int, classes):
    """doc_id, text to the document's first pivots: key, fp, at (n and place in the order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rank = classes.value.astype(np.uint64) << np.uint64(60)
        seen: set[int] = set()
        for b in batches:
            keys, fps, at = [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), size):
                n = len(s)
                if n == 0 or (fp := fingerprint(s)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(fp)
                k = np.sort(rank[(s >> np.uint64(64 - BUCKETS)).astype(np.int64)] | (s >> np.uint64(4)))[: prefix_size(n)]
                keys.append(k)
                fps.append(np.full(len(k), fp))
                at.append((n << 32) + np.arange(1, len(k) + 1))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (keys, fps, at)], names=["key", "fp", "at"])

    return run


REGION = "kind int, a long, b long, na long, nb long, pa long, pb long"


def _regions(small: int):
    """Rows sorted by key and fp to candidate pairs of small regions (kind 0) and members of large ones (kind 1: b is the region's first member, its cell)."""
    names = ["kind", "a", "b", "na", "nb", "pa", "pb"]

    def out(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], names=names)

    def pairs(fp: np.ndarray, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for size in np.unique(sizes):
            if size < 2:
                continue
            i, j = np.triu_indices(int(size), 1)
            first = starts[sizes == size]
            a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
            na, nb, pa_, pb = at[a] >> 32, at[b] >> 32, at[a] & 0xFFFFFFFF, at[b] & 0xFFFFFFFF
            most = np.minimum(pa_, pb) + np.minimum(na - pa_, nb - pb)
            ok = (fp[a] != fp[b]) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & linked(most, na, nb)
            if ok.any():
                yield out(0, fp[a][ok], fp[b][ok], na[ok], nb[ok], pa_[ok], pb[ok])

    def members(fp: np.ndarray, at: np.ndarray, cell: int) -> pa.RecordBatch:
        n = at >> 32
        return out(1, fp, np.full(len(fp), cell), n, n, n, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = [np.zeros(0, np.int64)] * 3
        cell: tuple[int, int] | None = None  # the key and first member of a large region that is being read
        for b in batches:
            key, fp, at = (np.r_[h, c.to_numpy(zero_copy_only=False)] for h, c in zip(held, b.columns, strict=True))
            new = np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])]
            key, fp, at = key[new], fp[new], at[new]
            if cell and key[0] == cell[0]:
                n = int(np.searchsorted(key != cell[0], True))
                yield members(fp[:n], at[:n], cell[1])
                key, fp, at = key[n:], fp[n:], at[n:]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            if len(starts) and sizes[-1] <= small:  # may go on in the next batch
                held = [key[starts[-1] :], fp[starts[-1] :], at[starts[-1] :]]
                starts, sizes = starts[:-1], sizes[:-1]
            else:
                held = [np.zeros(0, np.int64)] * 3
                if len(starts):
                    cell = int(key[starts[-1]]), int(fp[starts[-1]])
            yield from pairs(fp, at, starts[sizes <= small], sizes[sizes <= small])
            for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
                yield members(fp[s : s + n], at[s : s + n], int(fp[s]))
        if len(held[0]):
            yield from pairs(held[1], held[2], np.zeros(1, np.int64), np.array([len(held[0])]))

    return run


def _fetch(size: int, whole: bool):
    """Texts to fp and the shingles (whole), or else fp, sketch and bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(0).to_pylist(), size))
            fps = pa.array([fingerprint(s) for s in sets], pa.int64())
            if whole:
                yield pa.RecordBatch.from_arrays([fps, pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "v"])
            else:
                yield pa.RecordBatch.from_arrays([fps, pa.array([sketch(s) for s in sets], pa.binary()), pa.array([bits(s) for s in sets], pa.list_(pa.int64()))], names=["fp", "sketch", "bits"])

    return run


class Points:
    """The documents that stand for the sets in play. Sketches are kept in a table; whole sets, far larger, are made from the texts whenever some are asked for."""

    def __init__(self, rows: DataFrame, wanted: DataFrame, size: int) -> None:
        self.rows, self.wanted, self.size = rows, wanted, size
        self.sketches = cut(self._texts(wanted).mapInArrow(_fetch(size, False), "fp long, sketch binary, bits array<long>"), "sketches")

    def _texts(self, ids: DataFrame) -> DataFrame:
        """Texts of documents by id; up to SHIPPED ids are told to the scan, more meet the texts in a shuffle."""
        ids = small_side(ids.select(F.col("doc_id").alias("wanted")).distinct(), SHIPPED)
        return self.rows.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """fp and v (the set) of both ends of pairs."""
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        ids = cut(self.wanted.join(small_side(ends, SHIPPED), "fp", "left_semi"), "ids")
        return self._texts(ids).mapInArrow(_fetch(self.size, True), "fp long, v binary")


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall into each of about half as many classes, in a byte each, behind their number. Sums of the lesser counts bound an intersection from above."""
    k = min(max(len(shingles).bit_length() - 2, 6), 16)
    counts = np.bincount((shingles & np.uint64((1 << k) - 1)).astype(np.int64), minlength=1 << k)
    return len(shingles).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_shared(x: bytes, y: bytes) -> tuple[int, int, int]:
    """The sets' sizes, and a bound on what they share, from their sketches; the finer one is folded to the coarser."""
    na, nb = int.from_bytes(x[:8], "little"), int.from_bytes(y[:8], "little")
    c, d = sorted((np.frombuffer(v, np.uint8, offset=8) for v in (x, y)), key=len)
    if (c == 255).any() or (d == 255).any():
        return na, nb, min(na, nb)
    d = d.reshape(-1, len(c)).sum(axis=0, dtype=np.int64)
    return na, nb, min(na, nb, int(np.minimum(c, d).sum(dtype=np.int64)))


def bits(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of BITS classes of shingles. Each bit that two bitmaps don't share stands for a shingle that the sets don't share."""
    full = np.zeros(BITS, np.uint8)
    full[((shingles >> np.uint64(11)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(full).view(np.int64)


def _prune(num: int):
    """a, b, x, y (sketches) to the pairs a, b whose similarity may be num / DEN, and whether it may be that of a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, link = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                na, nb, most = most_shared(x, y)
                keep.append(DEN * most >= num * (na + nb - most))
                link.append(bool(linked(most, na, nb)))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(link, pa.bool_())], names=["a", "b", "likely"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, x, y (sets) to a, b, na, nb, inter; which of the sets is a's doesn't matter."""
    for batch in batches:
        na, nb, inter = [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(y, x)
            na.append(len(x))
            nb.append(len(y))
            inter.append(int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (na, nb, inter))], names=["a", "b", "na", "nb", "inter"])


def _side_by_side(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Distinct pairs a, b with both ends' v of own (fp, v) as x, y, in either order.

    Up to SHIPPED_PAIRS pairs are told to the side of own, and only what they ask for moves; more meet by joins.
    """
    if pairs.count() <= SHIPPED_PAIRS:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("fp"))
        met = own.join(F.broadcast(ends), "fp").groupBy("a", "b").agg(F.min("v").alias("x"), F.max("v").alias("y"), (F.min("fp") < F.max("fp")).alias("two"))
        return met.filter("two").select("a", "b", "x", "y")
    own = own.groupBy("fp").agg(F.min("v").alias("v"))
    return pairs.join(own.select(F.col("fp").alias("a"), F.col("v").alias("x")), "a").join(own.select(F.col("fp").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")


def measured(pairs: DataFrame, points: Points) -> DataFrame:
    """Distinct pairs (a, b; a table) with their sets' sizes and intersection."""
    return _side_by_side(pairs, points.sets(pairs)).mapInArrow(_measure, "a long, b long, na long, nb long, inter long")


def pruned(pairs: DataFrame, points: Points, num: int = NUM) -> DataFrame:
    """Of distinct pairs (a table) those whose sketches allow a similarity of num / DEN; likely: also that of a link."""
    own = points.sketches.select("fp", F.col("sketch").alias("v"))
    return _side_by_side(pairs, own).mapInArrow(_prune(num), "a long, b long, likely boolean")


#: The distance that a link spans at most, with room for rounding.
T = 1 - NUM / DEN + 1e-9
LINKED = f"{DEN} * inter >= {NUM} * (na + nb - inter)"


def _thinned(links: DataFrame) -> DataFrame:
    """As connected as links, with one link for each document a and a few between pivots b: a's pivots hang on its least."""
    both = links.join(links.groupBy("a").agg(F.min("b").alias("m")), "a")
    return both.select("a", F.col("m").alias("b")).unionByName(both.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _bits_apart(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda v, w: F.bit_count(v.bitwiseXOR(w))), F.lit(0), lambda s, v: s + v)


def _may_link():
    """Whether a (n, to, bits, root) and b (nb, tb, bitsb, rootb) can be linked and that would tell anything.

    They aren't connected yet; their sizes fit; their distances to each pivot differ by t at most, as the triangle
    inequality needs of a link; and their bitmaps differ in no more bits than linked sets in shingles.
    """
    # A distance that is left out is above 2t: then the other is above t. One of -1 is between t and anything.
    one = lambda v, w: F.when((v < 0) | (w < 0), F.lit(True)).otherwise(F.coalesce(F.abs(v - w) <= T, F.coalesce(v, w) >= T - 3e-9, F.lit(True)))
    near = F.forall(F.map_values(F.map_zip_with("to", "tb", lambda _, v, w: one(v, w))), lambda ok: ok)
    apart = _bits_apart("bits", "bitsb")
    sizes = F.expr(f"{DEN} * least(n, nb) >= {NUM} * greatest(n, nb)")
    return (F.col("root") != F.col("rootb")) & sizes & (apart * (NUM + DEN) <= (DEN - NUM) * (F.col("n") + F.col("nb"))) & near


def _split(cells: DataFrame, points: Points, links: list[DataFrame], small: int, most: int, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells: cell, a, n, bits, shared. One level of document pivots: roots of nodes by all links so far, pairs (a, b) to compare, and the cells of the next level."""
    # Pivots: the square root of the cell's size, of the members that share most of its first pivots, so in its middle.
    sizes = cells.groupBy("cell").agg(F.least(F.lit(most), F.greatest(F.lit(3), F.ceil(F.sqrt(F.count(F.lit(1)))))).alias("few"), F.count(F.lit(1)).alias("members"))
    order = Window.partitionBy("cell").orderBy(F.desc("shared"), F.xxhash64("a"), "a")
    picked = cells.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).join(sizes, "cell").filter("r <= few")
    pivots = cut(picked.select("cell", F.col("a").alias("p"), F.col("n").alias("np"), F.col("bits").alias("pbits"), "members"), "pivots")
    picked = small_side(pivots.drop("members"))
    # Bitmaps, then sketches, tell which distances are surely above 2t (left out), above t (-1), or have to be measured.
    two = cells.join(picked, "cell").filter("a <> p").withColumn("off", _bits_apart("bits", "pbits")).withColumn("both", F.col("n") + F.col("np"))
    two = two.filter(f"off * {2 * NUM} <= {2 * (DEN - NUM)} * both").withColumn("likely", F.expr(f"off * {NUM + DEN} <= {DEN - NUM} * both"))
    two = cut(two.select("a", F.col("p").alias("b"), "likely").distinct(), "asked")
    asked = cut(pruned(two.filter("likely").select("a", "b"), points, 2 * NUM - DEN), "near")
    asked = asked.unionByName(two.filter("NOT likely"))
    found = cut(measured(asked.filter("likely"), points), "distances")
    known = components(reduce(DataFrame.unionByName, [*links, _thinned(found.filter(LINKED).select("a", "b"))]))
    roots = known.select(F.col("node").alias("a"), "root")
    d = (1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("d")
    told = found.select("a", F.col("b").alias("p"), d).unionByName(asked.filter("NOT likely").select("a", F.col("b").alias("p"), F.lit(-1.0).alias("d")))
    near = cells.select("cell", "a").join(picked.select("cell", "p"), "cell").join(told, ["a", "p"], "left")
    near = near.withColumn("d", F.when(F.col("a") == F.col("p"), 0.0).otherwise(F.col("d")))
    told_of = F.when(F.col("d").isNotNull(), F.struct("p", "d"))
    by = near.groupBy("cell", "a").agg(F.min(F.when(F.col("d") >= 0, F.struct("d", "p"))).alias("m"), F.map_from_entries(F.array_sort(F.collect_list(told_of))).alias("to"))
    by = by.select("cell", "a", "to", F.when(F.col("m.d") <= T, F.col("m.p")).alias("home")).join(cells, ["cell", "a"]).join(roots, "a", "left")
    by = cut(by.withColumn("root", F.coalesce("root", "a")), "homes")
    as_b = {"a": "b", "n": "nb", "to": "tb", "bits": "bitsb", "root": "rootb"}
    second = lambda df, *more: df.select("cell", *[F.col(k).alias(v) for k, v in as_b.items()], *more)
    outer = by.filter("home IS NULL")
    # Those outside of all regions go to every block of the cell's members, these to the one that their hash says: no
    # block has more than about BLOCKED members, so a large cell is many tasks' work. Where no cell is that large, each is
    # one block, and nothing has to be told of their sizes.
    if (pivots.agg(F.max("members")).first()[0] or 0) > BLOCKED:
        blocks = pivots.select("cell", F.ceil(F.col("members") / BLOCKED).alias("blocks")).distinct()
        own = lambda df: df.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).drop("blocks")
        others = second(outer).join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    else:
        own = lambda df: df.withColumn("block", F.lit(0))
        others = second(outer).withColumn("block", F.lit(0))
    # Compared with whatever of the regions may be linked.
    far = own(by.filter("home IS NOT NULL")).join(others, ["cell", "block"]).filter(_may_link()).select("a", "b")
    # Among themselves: outright where they are few or on the last level, else as a cell of the next.
    rest = outer.groupBy("cell").agg(F.count(F.lit(1)).alias("c"))
    few = rest if last else rest.filter(F.col("c") <= small)
    apart = own(outer.join(few.select("cell"), "cell", "left_semi")).join(others, ["cell", "block"]).filter((F.col("a") < F.col("b")) & _may_link()).select("a", "b")
    deeper = outer.join(rest.filter(F.lit(not last) & (F.col("c") > small)).select("cell"), "cell", "left_semi").select("cell", "a", "n", "bits", "shared")
    # The windows of two regions: within 2t of the other's pivot, on both sides.
    edge = by.filter("home IS NOT NULL").select("*", F.explode("to").alias("p", "dp")).filter((F.col("p") != F.col("home")) & (F.col("dp") <= 2 * T))
    # Regions whose pivots are connected already have nothing left to say to each other.
    linked_to = by.select(F.col("a").alias("p"), F.col("root").alias("proot")).distinct()
    edge = edge.join(linked_to, "p").filter("proot <> root")
    other = second(edge, F.col("home").alias("p"), F.col("p").alias("home"))
    across = edge.filter("home < p").join(other, ["cell", "home", "p"]).filter(_may_link()).select("a", "b")
    return known, far.unionByName(apart).unionByName(across), deeper


def _as_links(roots: DataFrame) -> DataFrame:
    """What is known of components as links, as connected as those that it was found by."""
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))


def group_documents(docs: DataFrame, size: int = 5, small: int = 24) -> DataFrame:
    """docs (doc_id, text) to doc_id, key (hash of the text), n_shingles, component_id, root (the component's key) and fp (the set's); both are null for an empty set.

    component_id is the least doc_id that links reach, the document's own included.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = rows.withColumn("key", F.xxhash64("text")).mapInArrow(_survey(size), "doc_id long, key long, n long, fp long, block int, counts binary")
    survey = cut(survey, "survey")
    points = survey.filter("block IS NULL").select("doc_id", "key", "n", "fp")
    classes = spark.sparkContext.broadcast(rarity(survey))
    first = rows.mapInArrow(_first_pivots(size, classes), "key long, fp long, at long")
    parts = parts_of(docs)
    found = first.repartition(parts, "key").sortWithinPartitions("key", "fp").mapInArrow(_regions(small), REGION)
    found = cut(found, "regions")
    # Shared pivots of a pair, and their last places, bound the intersection; most chance meetings end here.
    pairs = found.filter("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("o"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    most = "(o + least(na - pa, nb - pb))"
    pairs = pairs.filter(f"{DEN} * {most} >= {NUM} * (na + nb - {most})").select("a", "b")
    cells = found.filter("kind = 1").groupBy("a", F.col("b").alias("cell"), F.col("na").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
    pairs, cells = cut(pairs, "pairs"), cut(cells, "cells")
    # One document for each set that takes part in any of it.
    nodes = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).union(cells.select("a")).distinct()
    one = points.groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    near_points = Points(rows, cut(nodes.join(one, "fp"), "wanted"), size)
    links, left, level = [], [pairs], 0
    cells = cells.join(near_points.sketches.select(F.col("fp").alias("a"), "bits"), "a").dropDuplicates(["cell", "a"])
    while cells.head(1):
        level += 1
        roots, rest, cells = _split(cells, near_points, links, small, PIVOTS[level - 1], level == len(PIVOTS))
        links = [_as_links(roots)]
        left.append(cut(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "left"))
        cells = cut(cells, "cells")
    pairs = cut(reduce(DataFrame.unionByName, left).distinct(), "candidates") if level else pairs
    # In two steps: each document and its least neighbour first, then only pairs that those links leave apart.
    likely = cut(pruned(pairs, near_points).select("a", "b"), "likely")
    ends = likely.unionByName(likely.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    first = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "first", likely.count())
    links.append(measured(first, near_points).filter(LINKED).select("a", "b"))
    roots = components(reduce(DataFrame.unionByName, links))
    rest = likely.join(first, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    second = cut(rest.filter("ra <> rb").select("a", "b"), "second")
    roots = components(_as_links(roots).unionByName(measured(second, near_points).filter(LINKED).select("a", "b")))
    whole = points.filter("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")
    joined = points.filter("n > 0").join(named, "fp").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "root", "fp")
    return joined.unionByName(points.filter("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("fp")))


def join_documents(docs: DataFrame, **options) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id."""
    return group_documents(docs, **options).select("doc_id", "n_shingles", "component_id")


#: Sets of a component that are compared with as many at a time; columns of the matrices that count what they share.
BLOCK, WIDTH = 128, 4096


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share."""
    shingles, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = held[column] > 1
    row, column = row[many], (np.cumsum(held > 1) - 1)[column[many]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        lo, hi = np.searchsorted(column, (start, start + WIDTH))
        m = np.zeros((len(sets), WIDTH), np.float32)  # sums stay below 2 ** 24, so they are exact
        m[row[lo:hi], column[lo:hi] - start] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _count_links(size: int):
    """Rows sorted by root, lo, hi (own: the row's block, one of the two; copies; text) to fp and the documents of other sets that it is linked to, of those two blocks."""

    def links(within: bool, rows: list[tuple]) -> pa.RecordBatch:
        sets = dict.fromkeys(t for _, _, t in rows)
        found = {}
        for (own, copies, _), s in zip({t: (o, c, t) for o, c, t in rows}.values(), shingle_sets(list(sets), size), strict=True):
            found[fingerprint(s)] = (own, copies, s)
        own, copies = (np.array([v[i] for v in found.values()], np.int64) for i in (0, 1))
        n = np.array([len(v[2]) for v in found.values()], np.int64)
        ok = linked(shared_counts([v[2] for v in found.values()]), n[:, None], n[None, :])
        np.fill_diagonal(ok, False)
        if not within:  # each block with itself is a group of its own
            ok &= own[:, None] != own[None, :]
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(ok.astype(np.int64) @ copies, pa.int64())], names=["fp", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        at, rows = None, []
        for b in batches:
            for *group, own, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != at and rows:
                    yield links(at[1] == at[2], rows)
                    rows = []
                at = group
                rows.append((own, copies, text))
        if rows:
            yield links(at[1] == at[2], rows)

    return run


def count_links(docs: DataFrame, size: int = 5, **options) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_shingles, component_id and n_links: how many other documents are linked to it, copies included.

    Links don't leave components, so the distinct sets of each are compared with each other, in blocks: that takes the
    square of their number, but only within a component, and no pair is ever a row.
    """
    groups = cut(group_documents(docs, size=size, **options), "linkgroups")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    sets = groups.filter("root IS NOT NULL").groupBy("root", "fp").agg(F.count(F.lit(1)).alias("copies"), F.min(one).alias("one"))
    sets = cut(sets, "linksets")
    blocks = sets.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    picked = cut(sets.join(blocks, "root").select("root", "copies", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("own"), "blocks", F.col("one.doc_id").alias("pid"), F.col("one.key").alias("pkey")), "linkpicked")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    rows = rows.join(small_side(picked), F.col("doc_id").eqNullSafe(F.col("pid")) & (F.col("key") == F.col("pkey")))
    rows = rows.select("root", "own", "copies", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "copies", "text")
    rows = rows.repartition(parts_of(docs), "root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    found = rows.mapInArrow(_count_links(size), "fp long, links long").groupBy("fp").agg(F.sum("links").alias("links"))
    told = sets.join(found, "fp", "left").select("fp", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).filter("n_links > 0")
    told = small_side(cut(told, "links"), SHIPPED_PAIRS)
    return groups.join(told, "fp", "left").select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, but one document only of each component: that of the least doc_id (null last), then text hash.

    Documents without words stay. Repeated rows of the one that stays are reduced to one.
    """
    groups = cut(group_documents(docs, **options).filter("root IS NOT NULL").select("doc_id", "key", "root"), "groups")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    ids = groups.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("c"))
    best = ids.groupBy("root").agg(F.min(one).alias("best"))
    ids = ids.join(best, "root").select(F.col("doc_id").alias("gid"), F.col("key").alias("gkey"), (one != F.col("best")).alias("out"), "c")
    ids = cut(ids.filter("out OR c > 1"), "leave")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("gid0"), F.xxhash64("text").alias("gkey0"))
    same = F.col("gid0").eqNullSafe(F.col("gid")) & (F.col("gkey0") == F.col("gkey"))
    stay = rows.join(ids.select("gid", "gkey").distinct(), same, "left_anti").select("row")
    again = rows.join(ids.filter("NOT out").select("gid", "gkey").distinct(), same, "left_semi").groupBy("gid0", "gkey0").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return stay.unionByName(again).select("row.*")
