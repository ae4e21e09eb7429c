"""Vector codes: vectors as whole numbers, cut into parts, each part coded by the nearest entry of its position's codebook.

Codebooks are fitted by rounds of assigning and averaging, all in whole numbers. A task screens a batch of vectors by one
float32 matrix product per part: with u = 2^-24 and k products, a float32 product of x and c is off by at most
g(k + 2) |x| |c|, where g(n) = n u / (1 - n u), in whatever order it is summed (the 2 are for rounding x and c to float32).
So each squared distance has an interval; every entry whose interval reaches below the least upper end is computed again
in int64, and ties go to the smaller index. The result is that of exact arithmetic.

A round moves one row for each codebook entry and task: how many parts chose it, and their sum; the codebooks (parts x
entries x components, whatever the data's size) come to the driver and go out with the next round's tasks. Vectors aren't
shuffled.

Defined results: vectors that are null, or hold a null or non-finite component, take no part; nor do empty ones and ones
whose length isn't a multiple of the parts, or differs from that of the smallest vec_id among the others. Rows with a null
vec_id are coded but start no entry. Repeated rows count each; where vec_ids repeat, entries start in the order of vec_id
and components. Fewer vectors than entries start as many entries as there are. Null labels are one label. An empty table
gives no rows. Extra columns are ignored, whatever their names. A component that is so large (2^27 for 64 components)
that a squared distance could leave the longs raises ValueError.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, join_hot

#: Rounding unit of float32.
UNIT = 2.0**-24
#: Rows whose matrix of products is held at a time.
ROWS = 2048


def largest(dim: int) -> int:
    """A bound of components' magnitudes below which squared distances of so many components are longs."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x (int64) the index of the nearest row of book (ties: smaller index), its squared distance, and how many distances were computed in int64."""
    norm_x, norm_c = (np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)) for m in (x, book))
    square = (book * book).sum(axis=1).astype(np.float64)
    n = x.shape[1] + 2
    g = n * UNIT / (1 - n * UNIT)
    product = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    score = square - 2 * product
    # The second term is for what is rounded in float64, here and in the bounds themselves.
    off = np.outer(norm_x, norm_c * (2.0001 * g + 2.0**-48)) + (square * 2.0**-48 + 2.0**-40)
    open_ = score - off <= (score + off).min(axis=1, keepdims=True)
    chosen = open_.argmax(axis=1)
    row, entry = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(row):
        d = ((x[row] - book[entry]) ** 2).sum(axis=1)
        order = np.lexsort((entry, d, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]]
        chosen[row[first]] = entry[first]
    return chosen, ((x - book[chosen]) ** 2).sum(axis=1), len(row)


def _whole(vectors: pa.Array, dim: int, scale: float) -> np.ndarray:
    """A batch of kept vectors as floor(scale * x)."""
    with np.errstate(over="ignore"):
        m = np.floor(vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim) * scale)
    if m.size and np.abs(m).max() >= largest(dim):
        raise ValueError(f"a component is {largest(dim)} or more, once scaled: distances would leave the longs")
    return m.astype(np.int64)


def _parts(vectors: pa.Array, books: list[np.ndarray], scale: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, part, the parts of up to ROWS rows, their entries, their squared distances."""
    width = books[0].shape[1]
    x = _whole(vectors, width * len(books), scale)
    for at in range(0, len(x), ROWS):
        for p, book in enumerate(books):
            own = x[at : at + ROWS, p * width : (p + 1) * width]
            chosen, d, _ = nearest(own, book)
            yield at, p, own, chosen, d


def _sums(books: list[np.ndarray], scale: float):
    """The map side of a round: for each part and entry how many parts chose it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(b.shape, np.int64) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            for _, p, own, chosen, _ in _parts(b.column(0), books, scale):
                order = np.argsort(chosen, kind="stable")
                at = np.flatnonzero(np.r_[True, chosen[order][1:] != chosen[order][:-1]])
                total[p][chosen[order][at]] += np.add.reduceat(own[order], at, axis=0)
                count[p] += np.bincount(chosen, minlength=len(count[p]))
        rows = [(p, int(e), int(count[p][e]), total[p][e].tolist()) for p in range(len(books)) for e in np.flatnonzero(count[p])]
        if rows:
            part, entry, n, sums = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: list[np.ndarray], scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, error = np.zeros((b.num_rows, len(books)), np.uint8), np.zeros(b.num_rows, np.int64)
            for at, p, own, chosen, d in _parts(b.column(2), books, scale):
                codes[at : at + len(own), p] = chosen
                error[at : at + len(own)] += d
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """vec_id, label (null if there is none) and embedding of the vectors that take part, and their length (0: there are none)."""
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0) & whole)
    first = v.select("vec_id", F.size("embedding").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    dim = first[0]["n"] if first else 0
    return v.filter(F.size("embedding") == dim), dim


def fit(vectors: DataFrame, dim: int, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> list[np.ndarray]:
    """The codebooks: for each part an int64 matrix of entries. vectors: kept_vectors' rows, of length dim."""
    seeds = vectors.filter("vec_id IS NOT NULL").orderBy("vec_id", "embedding").limit(entries).select("embedding").collect()
    start = _whole(pa.array([r["embedding"] for r in seeds], pa.list_(pa.float64())), dim, scale)
    width = dim // parts
    books = [np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds if len(start) else 0):
        sums = vectors.select("embedding").mapInArrow(_sums(books, scale), "part int, entry int, n long, sums array<long>")
        # As many rows as the codebooks have entries, whatever the data's size.
        found = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
        for part, entry, n, *total in found:
            books[part][entry] = [s // n for s in total]
    return books


def digest(books: list[np.ndarray]) -> str:
    """Lower-case SHA-256 of all components, as decimals joined by commas, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """vectors (vec_id, embedding, and label if there is one) to vec_id, code, error, label_error, codebooks_sha256.

    code: two hex digits a part (so entries are 256 at most); error: squared distances summed over the parts;
    label_error: error summed over the rows of the same label. A hot label's sum reaches its rows by broadcast.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    bound_batches(spark)
    v, dim = kept_vectors(vectors, parts)
    books = fit(v, dim, parts, entries, rounds, scale) if dim else [np.zeros((0, 1), np.int64)] * parts
    if not len(books[0]):
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = cut(v.mapInArrow(_codes(books, scale), "vec_id long, label string, code string, error long"), "codes")
    told = cut(coded.groupBy(F.col("label").alias("told")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("held")), "labels")
    out = join_hot(coded, told, F.col("label").eqNullSafe(F.col("told")), "held", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
