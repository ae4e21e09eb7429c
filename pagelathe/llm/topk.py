"""Exact top-k inner products: tiles of queries times tiles of vectors, a partial top list per tile, merged in a tree.

Vectors are packed into tiles where they lie. Tiles are dealt over a grid: so many groups of vectors by so many groups of
queries, chosen so that the copies of both sides that move are fewest. A task multiplies the tile pairs of its cell and
keeps a running top list per query; the lists of all tasks are merged level by level, MERGED lists into one each time.
No row is ever paired with another in the plan.

Defined results: vectors that are null or empty, or hold a null or non-finite component (or one that leaves the doubles
when scaled), take no part, and nor do null vec_ids; vectors of different lengths aren't compared; rows with the query's
own vec_id aren't its candidates; a repeated query row gives its own list, repeated candidates count each; ties go to the
smaller vec_id; products are exact, and one beyond a long is ranked by its exact value and shown as the nearest long; an
empty table gives no rows; columns other than vec_id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import parts_of

TILE = "dim int, n int, uids binary, ids binary, level int, mat binary"
FIELDS = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("uids", pa.binary()), ("ids", pa.binary()), ("level", pa.int32()), ("mat", pa.binary())])
#: Tiles hold vectors of one kind: components within two bytes, within LARGE, or beyond.
LARGE, LONG = 2.0**24, 2**63 - 1
LISTS = "uid long, query_id long, score long, vec_id long, beyond binary, lane long"
#: Lists that one step of the tree merges into one.
MERGED = 32


def _pack(rows: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def tile(dim: int, level: int) -> pa.RecordBatch:
            uids, ids, mat = (np.concatenate(x) for x in zip(*held.pop((dim, level)), strict=True))
            values = (dim, len(ids), uids.tobytes(), ids.tobytes(), level, mat.astype("f8" if level else "i2").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, FIELDS.types, strict=True)], schema=FIELDS)

        for batch in batches:
            vec_id, vectors = batch.column(0), batch.column(1)
            lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = vectors.flatten()
            values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(lengths, 0))
            ids = vec_id.fill_null(-1).to_numpy(zero_copy_only=False)
            ids_ok = vec_id.is_valid().to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(lengths[lengths > 0])):
                rows_at = np.flatnonzero((lengths == dim) & ids_ok)
                with np.errstate(over="ignore", invalid="ignore"):
                    mat = np.floor(values[(ends[rows_at] - dim)[:, None] + np.arange(dim)] * scale)
                good = np.isfinite(mat).all(axis=1)
                rows_at, mat = rows_at[good], mat[good]
                most = np.abs(mat).max(axis=1, initial=0)
                levels = (most >= 2**15).astype(int) + (most >= LARGE)
                for level in map(int, np.unique(levels)):
                    own, of = held.setdefault((dim, level), []), levels == level
                    own.append(((part << 33) + seen + rows_at[of], ids[rows_at[of]], mat[of]))
                    if sum(len(x[1]) for x in own) >= rows:
                        yield tile(dim, level)
            seen += batch.num_rows
        for key in list(held):
            yield tile(*key)

    return run


def best(q: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries of each query in q: higher score, then smaller vec."""
    order = np.lexsort((vec, -score, q))
    new = np.flatnonzero(np.r_[True, q[order][1:] != q[order][:-1]])
    rank = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return order[rank < k]


def beyond(score: int) -> bytes | None:
    """A score at or beyond the ends of the longs as bytes that sort like it; null for all others."""
    return (score + (1 << 2200)).to_bytes(280, "big") if not -LONG - 1 < score < LONG else None


def _multiply(k: int, keep: int = 400_000):
    names = [x.split()[0] for x in LISTS.split(", ")]

    def out(lane: int, uid, qid, score, vec, far=None) -> pa.RecordBatch:
        longs = [pa.array(x, pa.int64()) for x in (uid, qid, score, vec)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(far, pa.binary()) if far else pa.nulls(len(uid), pa.binary()), pa.array(np.full(len(uid), lane), pa.int64())], names=names)

    def exact(a: np.ndarray, b: np.ndarray, qid: np.ndarray, vid: np.ndarray) -> list[tuple[int, int, int]]:
        """Row of a, row of b and product of the k best of each row of a, in Python's integers."""
        whole = lambda m: np.array([[int(x) for x in r] for r in m], object)
        a, b, found = whole(a), whole(b), []
        for i, row in enumerate(a):
            s = b @ row
            found += [(i, j, s[j]) for j in sorted(np.flatnonzero(vid != qid[i]), key=lambda j: (-s[j], vid[j]))[:k]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held, lane = 0, TaskContext.get().partitionId()

        def merged() -> tuple[np.ndarray, ...]:
            uid, qid, score, vec = (np.concatenate(x) for x in zip(*parts, strict=True))
            at = best(uid, score, vec, k)
            return uid[at], qid[at], score[at], vec[at]

        for batch in batches:
            for r in batch.to_pylist():
                a, b = (np.frombuffer(r[p + "mat"], "f8" if r[p + "level"] else "i2").reshape(r[p + "n"], r["dim"]).astype("f8") for p in ("q", "v"))
                quid, qid, vid = np.frombuffer(r["quids"], "i8"), np.frombuffer(r["qids"], "i8"), np.frombuffer(r["vids"], "i8")
                most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * r["dim"]
                if most >= LONG:
                    found = exact(a, b, qid, vid)
                    if found:
                        rows, cols, s = zip(*found, strict=True)
                        yield out(lane, quid[list(rows)], qid[list(rows)], [max(-LONG - 1, min(LONG, x)) for x in s], vid[list(cols)], [beyond(x) for x in s])
                    continue
                # Products of whole numbers are exact in doubles below 2**53; beyond, in 64-bit integers.
                s = (a @ b.T).astype("i8") if most < 2**53 else a.astype("i8") @ b.astype("i8").T
                own = qid[:, None] == vid[None, :]
                s[own] = np.iinfo("i8").min
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), np.iinfo("i8").min)
                rows, cols = np.nonzero((s >= least[:, None]) & ~own)
                at = best(rows, s[rows, cols], vid[cols], k)
                rows, cols = rows[at], cols[at]
                parts.append((quid[rows], qid[rows], s[rows, cols], vid[cols]))
                held += len(rows)
                if held > keep:
                    parts = [merged()]
                    held = len(parts[0][0])
        if parts:
            yield out(lane, *merged())

    return run


def grid(tasks: int, vectors: int, queries: int) -> tuple[int, int]:
    """Groups of vectors and of queries, together about so many cells: both sides' copies cost least where their volumes are equal."""
    by_vectors = max(1, min(tasks, round(math.sqrt(tasks * max(1, vectors) / max(1, queries)))))
    return by_vectors, -(-tasks // by_vectors)


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, tile_rows: int = 2048, query_rows: int = 512, tasks: int | None = None) -> DataFrame:
    """vectors: vec_id, embedding; is_query: a condition that picks the queries. Components become floor(scale * x).

    Returns query_id, rank (from 1), vec_id, score. tasks: cells of the grid; by default from the input's size.
    """
    bound_batches(vectors.sparkSession)
    tasks = tasks or parts_of(vectors, 32 << 20)
    over, across = grid(tasks, vectors.count(), vectors.filter(is_query).count())
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = vectors.mapInArrow(_pack(tile_rows, scale), TILE)
    q = vectors.filter(is_query).mapInArrow(_pack(query_rows, scale), TILE)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod(F.xxhash64("uids"), F.lit(n).cast("long"))
    tile = lambda p: [F.col(c).alias(p + c) for c in ("n", "uids", "ids", "level", "mat")]
    v = v.select("dim", own(over).alias("g"), every(across).alias("h"), *tile("v"))
    q = q.select("dim", every(over).alias("g"), own(across).alias("h"), *tile("q"))
    tops = v.join(q, ["g", "h", "dim"]).drop("g", "h", "vuids").mapInArrow(_multiply(k), LISTS)
    lanes = max(tasks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.desc("beyond"), F.asc("vec_id")]
    while lanes > MERGED:
        tops = tops.withColumn("lane", F.expr(f"lane div {MERGED}"))
        tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("uid", "lane").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
        lanes = -(-lanes // MERGED)
    tops = tops.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order)))
    return tops.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
