"""The prefix trie of conversations: one node for each distinct sequence of first turns, by an LCP-aware external mergesort.

A turn becomes 20 bytes: half of the SHA-256 of its role and text, and the text's length in code points; a conversation
becomes the row of its turns' bytes, its path, so that the order of paths is one of turn sequences. Equal paths are
counted before anything else. Distinct paths are dealt by ranges of that order. In a range, each batch is sorted into a
run that carries, with every path, the number of turns it shares with the one before (LCP); runs beyond HELD bytes are
merged and written to a scratch file, without what a path shares with its predecessor. A loser tree merges the runs: of
two paths whose LCPs with the last one put out differ, the longer LCP is the smaller path, so shared turns aren't
compared again. The merged stream keeps the open path on a stack: a node that the next path doesn't begin with is
finished, and adds its sums to its parent.

Nodes on a range's first or last path may have members in the ranges beside it. Their sums so far go up as at most two
records, the two paths with a row of sums for each depth, and are merged in the same way, MERGED ranges into one a level,
until one task holds the last of them (two paths a range). Children that finished below such a node learn its conversation by
a join at the end.

Defined results: rows without conv_id take no part; null roles and texts are empty; turns are ordered by number, null
first, ties by their bytes; repeated rows are turns of their own; an empty table has no node, not even a root; extra columns
are ignored. A text of any length is 20 bytes; a conversation's path must fit a row (some 10^8 turns). The digest of a
node's ends is one pass over their sorted ids, as SHA-256 asks: it streams, in one task for each such node.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, join_hot, parts_of

#: Bytes of a turn in a path.
TURN = 20
#: Bytes of paths that a task holds in runs before it writes them out.
HELD = 64 << 20
#: Ranges whose first and last paths one task of the next level merges.
MERGED = 32
#: What a path carries for some of its depths: members that end there, smallest member, members, children, leaves and saved tokens found below.
SUMS = "<7q"
NONE = 2**63 - 1
NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, node_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_key binary"
FOUND = f"path binary, sums binary, {NODE}"
KINDS = {"long": pa.int64(), "binary": pa.binary()}

#: LCP with the path before, path, its sums by depth.
Record = tuple[int, bytes, list[tuple[int, ...]]]

# ------------------------------------------------------------------ mergesort


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths begin with alike; known: so many are known to be."""
    at, end = known * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(paths: list[tuple[bytes, list]]) -> list[Record]:
    paths.sort(key=lambda x: x[0])
    before, out = b"", []
    for path, sums in paths:
        out.append((shared(before, path), path, sums))
        before = path
    return out


class Merge:
    """Sorted runs as one, by a loser tree; ``compared`` counts the turns that were looked at."""

    def __init__(self, runs: Iterable[Iterable[Record]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.runs += [iter(())] * ((1 << max(0, len(self.runs) - 1).bit_length()) - len(self.runs))
        self.lcp, self.path, self.sums = ([None] * len(self.runs) for _ in range(3))
        self.compared = 0
        for i in range(len(self.runs)):
            self._next(i)

    def _next(self, i: int) -> None:
        """The run's next path, whose LCP is that with the one before in the run: the last one put out."""
        self.lcp[i], self.path[i], self.sums[i] = next(self.runs[i], (0, None, None))

    def _smaller(self, i: int, j: int) -> int:
        """The run with the smaller path, both LCPs being with the last path put out; the other's becomes that with this one."""
        a, b, x, y = self.path[i], self.path[j], self.lcp[i], self.lcp[j]
        if a is None or b is None:
            return i if b is None else j
        if x != y:
            return i if x > y else j
        both = shared(a, b, x)
        self.compared += both - x + 1
        first = i if a[both * TURN : (both + 1) * TURN] <= b[both * TURN : (both + 1) * TURN] else j
        self.lcp[j if first == i else i] = both
        return first

    def __iter__(self) -> Iterator[Record]:
        n = len(self.runs)
        loser, winner = [0] * n, [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            i, j = winner[2 * node], winner[2 * node + 1]
            winner[node] = self._smaller(i, j)
            loser[node] = j if winner[node] == i else i
        top = winner[1]
        while self.path[top] is not None:
            yield self.lcp[top], self.path[top], self.sums[top]
            self._next(top)
            node = (n + top) // 2
            while node:
                if self._smaller(top, loser[node]) != top:
                    top, loser[node] = loser[node], top
                node //= 2


def written(records: Iterable[Record]) -> Iterator[Record]:
    """records by way of a scratch file that goes with the task, each without what it shares with its predecessor."""
    records = iter(records)
    file = tempfile.TemporaryFile()
    while part := [(lcp, path[lcp * TURN :], sums) for lcp, path, sums in islice(records, 1000)]:
        pickle.dump(part, file)
    size = file.tell()

    def read() -> Iterator[Record]:
        with file:
            file.seek(0)
            path = b""
            while file.tell() < size:
                for lcp, rest, sums in pickle.load(file):
                    path = path[: lcp * TURN] + rest
                    yield lcp, path, sums

    return read()


def merged(parts: Iterable[list[tuple[bytes, list]]], held: int | None = None) -> Iterator[Record]:
    """Everything in parts in order: external mergesort."""
    out: list[Iterable[Record]] = []
    runs: list[list[Record]] = []
    size = 0
    for part in parts:
        runs.append(sorted_run(part))
        size += sum(len(path) + 200 for _, path, _ in runs[-1])
        if size > (HELD if held is None else held):
            out.append(written(Merge(runs)))
            runs, size = [], 0
    return iter(Merge([*out, *runs])) if out or runs else iter(())


# ----------------------------------------------------------------------- trie


class _Open:
    """A node of the open path."""

    __slots__ = ("children", "convs", "digest", "ends", "leaves", "length", "low", "saved", "waiting")

    def __init__(self, digest, length: int) -> None:
        self.digest, self.length = digest, length
        self.ends = self.convs = self.children = self.leaves = self.saved = 0
        self.low, self.waiting = NONE, []


def fold(records: Iterable[Record], whole: bool, above: bool) -> Iterator[tuple]:
    """Rows of FOUND: finished nodes, and what is open at the ends of the range.

    whole: the records are those of all ranges, so every node finishes. above: nodes tell their keys, as children that
    finished at a lower level look for them.
    """
    stack: list[_Open] = []
    first = path = b""
    alike = 0  # turns that the open path shares with the first one; what stands on those is never finished here
    first_sums: list[tuple[int, ...]] = []

    def close() -> Iterator[tuple]:
        depth, x = len(stack) - 1, stack.pop()
        if not whole and depth <= alike:
            first_sums.append((depth, x.ends, x.low, x.convs, x.children, x.leaves, x.saved))
            return
        convs, leaves = x.ends + x.convs, x.leaves if x.children else 1
        saved = x.saved + (convs - 1) * x.length
        key = x.digest.digest()
        row = (x.low, depth, None, None, key if above else None, convs, x.children, leaves, saved, key if x.ends else None)
        yield from ((None, None, *r[:2], x.low, *r[3:]) for r in x.waiting)
        if not stack:
            yield (None, None, *row)
            return
        up = stack[-1]
        up.low = min(up.low, x.low)
        up.convs, up.children, up.leaves, up.saved = up.convs + convs, up.children + 1, up.leaves + leaves, up.saved + saved
        if not whole and depth - 1 <= alike:
            yield (None, None, *row[:3], up.digest.digest(), *row[4:])
        else:
            up.waiting.append(row)

    for lcp, path, sums in records:
        if not stack:
            stack.append(_Open(hashlib.md5(usedforsecurity=False), 0))
            first, alike = path, len(path) // TURN
        else:
            while len(stack) - 1 > lcp:
                yield from close()
            alike = min(alike, lcp)
        for d in range(len(stack) - 1, len(path) // TURN):
            turn = path[d * TURN : (d + 1) * TURN]
            digest = stack[-1].digest.copy()
            digest.update(turn)
            stack.append(_Open(digest, int.from_bytes(turn[-4:], "big")))
        for depth, ends, low, convs, children, leaves, saved in sums:
            x = stack[depth]
            x.ends, x.low, x.convs, x.children, x.leaves, x.saved = x.ends + ends, min(x.low, low), x.convs + convs, x.children + children, x.leaves + leaves, x.saved + saved
    nothing = (None,) * 10
    if whole:
        while stack:
            yield from close()
        return
    if first_sums:
        yield (first, b"".join(struct.pack(SUMS, *s) for s in first_sums), *nothing)
    if stack:
        yield (path, b"".join(struct.pack(SUMS, d, x.ends, x.low, x.convs, x.children, x.leaves, x.saved) for d, x in enumerate(stack)), *nothing)
    for x in stack:
        yield from ((None, None, *r[:3], x.digest.digest(), *r[4:]) for r in x.waiting)


def _range(whole: bool, above: bool):
    """The task of one range: path and sums (above), or path, members that end there and the smallest."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list]]]:
        for b in batches:
            if above:
                yield [(path, list(struct.iter_unpack(SUMS, sums))) for path, sums in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            else:
                yield [(path, [(len(path) // TURN, n, low, 0, 0, 0, 0)]) for path, n, low in zip(*(c.to_pylist() for c in b.columns), strict=True)]

    fields = [x.split() for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = fold(merged(parts(batches)), whole, above)
        while part := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(zip(*part, strict=True), fields, strict=True)], names=[name for name, _ in fields])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of key and conv_id to one digest of the ids of each key."""
    key, sha = None, None
    for b in batches:
        done = []
        for k, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k == key:
                sha.update(b",%d" % conv_id)
                continue
            if key is not None:
                done.append((key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(b"%d" % conv_id)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], names=["told", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["told", "ends_sha256"])


def turn_column() -> Column:
    """A turn's bytes as hex digits, from role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(named.cast("binary"), 256), 1, 2 * TURN - 8), F.lpad(F.hex(F.char_length(text)), 8, "0"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to one row a conversation: conv_id, turns (array of hex digits, in order)."""
    each = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull(), "turn", turn_column().alias("bytes")).alias("turn"))
    return each.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x["bytes"]).alias("turns"))


def share_heads(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of c - c % group, h = crc32 of its decimal number % most."""
    turns = cut(turns, "turns")
    heads = turns.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    rows = turns.join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    none = F.array().cast("array<string>")
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def build(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """turns (conv_id, turns: arrays of turn_column) to the nodes of their trie.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. ranges: of paths at the first level; by default from the input's size.
    """
    bound_batches(turns.sparkSession)
    path = F.unhex(F.array_join("turns", ""))
    paths = cut(turns.select("conv_id", path.alias("path"), F.unhex(F.md5(path)).alias("key")), "paths")
    ranges = ranges or parts_of(paths, 32 << 20)
    rows = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    found, above = [], False
    while True:
        rows = rows.repartitionByRange(ranges, "path") if ranges > 1 else rows.coalesce(1)
        found.append(cut(rows.mapInArrow(_range(ranges == 1, above), FOUND), "nodes"))
        if ranges == 1:
            break
        rows, ranges, above = found[-1].filter("path IS NOT NULL").select("path", "sums"), -(-ranges // MERGED), True
    names = [x.split()[0] for x in NODE.split(", ")]
    nodes = [x.filter("path IS NULL").select(names) for x in found]
    out = nodes[0]
    for x in nodes[1:]:
        out = out.unionByName(x)
    if len(nodes) > 1:
        left = out.filter("parent_key IS NOT NULL").drop("parent_conv_id")
        up = out.filter("node_key IS NOT NULL").select(F.col("node_key").alias("told"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
        met = join_hot(left, up, F.col("parent_key") == F.col("told"), "weight", max(1, left.count()))
        out = out.filter("parent_key IS NULL").unionByName(met.select(names))
    ends = paths.select("key", "conv_id").repartition(parts_of(paths, 32 << 20), "key").sortWithinPartitions("key", "conv_id").mapInArrow(_digests, "told binary, ends_sha256 string")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    none = out.filter("ends_key IS NULL").select(*shown, F.lit(hashlib.sha256().hexdigest()).alias("ends_sha256"))
    return none.unionByName(out.filter("ends_key IS NOT NULL").join(ends, F.col("ends_key") == F.col("told")).select(*shown, "ends_sha256"))
