"""Substring dedup: passages of so many words that also start earlier in the corpus, by relative Lempel-Ziv parsing.

Documents are factored against reference blocks of the corpus itself: an earlier place that holds the same words is a
factor's source, and what factors cover is a duplicate. No document meets all of the reference: a window (``width``
words) is routed by its anchor, the run of ``gram`` words in it with the least hash (the leftmost of several), and a
block indexes the passages of some anchors; equal windows have equal anchors, so no other block can hold a source.

1. A task finds the anchors of its texts. Neighbouring windows with the same anchor are one context, some seven windows
   in about 27 words. Contexts that a batch repeats are factors at once; one row of each goes on, so that hot passages
   are few rows.
2. A block reads its contexts in order, as a stream. A context that is indexed already is a factor as a whole: copied
   passages are chains of such factors.
3. Chains end in contexts that only start or end like indexed ones. There the words decide: these contexts alone go back
   for their words, and their block parses them greedily in document order: the longest factor at the first window that
   is indexed, then each window that reaches beyond the factor's end (the factor boundary), then on. Windows that
   aren't found are indexed. An anchor with more than ``hot`` such contexts (the edges of a very common passage) has its
   windows indexed one by one, each in the block of its own words, so that no block gathers them.
4. Each document is cut at its factors.

Hashes of contexts have 128 bits and aren't checked by words; boundaries are. Memory: a batch of texts (one text, if that
is longer), and the words of at most ``hot`` contexts.

Defined results: a null text has no words; null doc_ids come first, as the smallest; of rows that share a doc_id, the
order is that of a hash of their texts; equal rows (doc_id and text) are one document and copies of it; very long texts
are cut whole, as one row; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, parts_of
from pagelathe.llm.shingles import BYTE, IS_SPACE, ODD, PIECE, mix

#: Windows whose anchors are found at a time.
CHUNK = 1 << 20
STEP = np.uint64(0x9FB21C651E98DF25)
#: Inverse of STEP modulo 2^64.
BACK = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
CONTEXT = "anchor long, context long, did long, tie long, start int, n int"
FACTOR = "did long, tie long, start int, n int, anchor long, kind int"
PASSAGE = "block long, did long, tie long, start int, n int, words binary"
#: Kinds of FACTOR: a factor; a context whose words decide, by its anchor or by its windows.
FOUND, OPEN, HOT = range(3)
NULL_ID = -(2**63)


# ------------------------------------------------------- 1: anchors and contexts


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts, and its hash; words are left as they are."""
    codes = np.frombuffer(data, np.uint8)
    space = np.r_[True, IS_SPACE[codes], True]
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    h = sizes.astype(np.uint64)
    live, k = np.arange(len(starts)), 0
    while len(live):
        h[live] = (h[live] ^ BYTE[codes[starts[live] + k]]) * ODD[0]
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        live = live[sizes[live] > k]
    return starts, mix(h)


def _leftmost_least(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of so many elements the place of its least, the leftmost of several."""
    p, done = np.arange(len(g)), 1
    while done < width:
        step = min(done, width - done)
        a, b = p[:-step], p[step:]
        p, done = np.where(g[b] < g[a], b, a), done + step
    return p


def contexts(h: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Word hashes and the document each belongs to (ascending), to contexts: anchor, context (hashes), first word, words."""
    out = []
    for at in range(0, len(h) - width + 1, CHUNK):
        own, of = h[at : at + CHUNK + width - 1], doc[at : at + CHUNK + width - 1]
        n = len(own)
        g = np.zeros(n - gram + 1, np.uint64)
        for i in range(gram):
            g = g * STEP + own[i : i + n - gram + 1]
        g = mix(g)
        place = _leftmost_least(g, width - gram + 1)
        whole = np.flatnonzero(of[: n - width + 1] == of[width - 1 :])
        if not len(whole):
            continue
        p = place[whole]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (whole[1:] != whole[:-1] + 1)])
        first, last = whole[new], whole[np.r_[new[1:], len(whole)] - 1]
        words = last - first + width
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, STEP)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, BACK)])
        upto = np.r_[np.uint64(0), np.add.accumulate(own * power[:n])]
        c = mix((upto[first + words] - upto[first]) * back[first] + words.astype(np.uint64) * ODD[1] + (p[new] - first).astype(np.uint64) * ODD[2])
        out.append((g[p[new]].view(np.int64), c.view(np.int64), first + at, words))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _groups(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, and their words' hashes and rows: rows of bounded size together, a longer text alone, by pieces."""
    at = 0
    while at < len(texts):
        to, size = at + 1, len(texts[at])
        while to < len(texts) and size + len(texts[to]) <= PIECE:
            size, to = size + len(texts[to]), to + 1
        if to == at + 1 and size > PIECE:
            h, data, begin = [], texts[at], 0
            while begin < len(data):
                end = begin + PIECE
                while end < len(data) and not IS_SPACE[data[end]]:
                    end += 1
                h.append(hash_words(data[begin:end])[1])
                begin = end
            h = np.concatenate(h)
            yield at, to, h, np.full(len(h), at)
        else:
            starts, h = hash_words(b" ".join(texts[at:to]))
            begins = np.cumsum([0, *(len(x) + 1 for x in texts[at : to - 1])])
            yield at, to, h, at + np.searchsorted(begins, starts, "right") - 1
        at = to


def _rows(names: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tie = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            # Rows in their order, so that the first of equal contexts is the earliest; one of equal documents.
            order = np.lexsort((tie, did))
            order = order[np.r_[True, (did[order][1:] != did[order][:-1]) | (tie[order][1:] != tie[order][:-1])][: len(order)]]
            texts = b.column(2).take(pa.array(order)).cast(pa.binary()).to_pylist()
            did, tie = did[order], tie[order]
            for _, _, h, doc in _groups(texts):
                anchor, context, first, words = contexts(h, doc, width, gram)
                if not len(anchor):
                    continue
                row = doc[first]
                start = first - np.searchsorted(doc, row)
                known = np.lexsort((first, context, anchor))
                again = np.r_[False, (anchor[known][1:] == anchor[known][:-1]) & (context[known][1:] == context[known][:-1])]
                again[known] = again.copy()
                new = ~again
                yield _rows(CONTEXT, anchor[new], context[new], did[row[new]], tie[row[new]], start[new], words[new])
                if again.any():
                    # What the batch has earlier: one row for each stretch, dealt anywhere, with words as a negative number.
                    row, start, end = row[again], start[again], (start + words)[again]
                    far = np.maximum.accumulate(end + row * (int(end.max()) + 1)) - row * (int(end.max()) + 1)
                    cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (start[1:] > far[:-1])])
                    a, z = start[cuts], far[np.r_[cuts[1:], len(row)] - 1]
                    key = mix(tie[row[cuts]].view(np.uint64) + a.astype(np.uint64) * ODD[3]).view(np.int64)
                    yield _rows(CONTEXT, key, np.zeros(len(a), np.int64), did[row[cuts]], tie[row[cuts]], a, a - z)

    return run


# ------------------------------------------------------------ 2: whole contexts


def _index(hot: int):
    """A block's contexts, sorted by anchor, context and place, as a stream: whole factors, and the contexts whose words decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first of each context of the last anchor
        crowded = False  # the last anchor has had more than hot
        before = None  # the last row

        def decide(rows: list[np.ndarray], kind: int) -> pa.RecordBatch:
            return _rows(FACTOR, *rows[2:6], rows[0], np.full(len(rows[0]), kind))

        for b in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            done = rows[5] < 0
            if done.any():
                ready = [c[done] for c in rows]
                yield _rows(FACTOR, ready[2], ready[3], ready[4], -ready[5], ready[0], np.full(len(ready[0]), FOUND))
                rows = [c[~done] for c in rows]
            if not len(rows[0]):
                continue
            if before is not None:
                rows = [np.r_[x, c] for x, c in zip(before, rows, strict=True)]
            skip, before = int(before is not None), [c[-1:] for c in rows]
            same = lambda *of: np.r_[False, np.logical_and.reduce([rows[i][1:] == rows[i][:-1] for i in of])]  # noqa: E731, B023
            anchor_goes_on, context_goes_on = same(0), same(0, 1)
            copies = same(0, 1, 2, 3, 4)  # rows of equal documents
            factor = context_goes_on & ~copies
            factor[:skip] = False
            if factor.any():
                f = [c[factor] for c in rows]
                yield _rows(FACTOR, *f[2:6], f[0], np.full(len(f[0]), FOUND))
            fresh = ~context_goes_on
            fresh[:skip] = False
            begins = ~anchor_goes_on & fresh
            rows = [c[fresh] for c in rows]
            begins = np.flatnonzero(begins[fresh])
            upto = int(begins[0]) if len(begins) else len(rows[0])
            if upto:  # the anchor of the batch before goes on
                own = [c[:upto] for c in rows]
                if crowded:
                    yield decide(own, HOT)
                else:
                    held = [np.r_[x, c] for x, c in zip(held, own, strict=True)]
                    if len(held[0]) > hot:
                        yield decide(held, HOT)
                        held, crowded = None, True
            if len(begins):
                if held is not None and len(held[0]) > 1:
                    yield decide(held, OPEN)
                sizes = np.diff(np.r_[begins, len(rows[0])])
                size = np.repeat(sizes, sizes)
                inner, last = [c[begins[0] : begins[-1]] for c in rows], [c[begins[-1] :] for c in rows]
                size = size[: len(inner[0])]
                for chosen, kind in (((size > 1) & (size <= hot), OPEN), (size > hot, HOT)):
                    if chosen.any():
                        yield decide([c[chosen] for c in inner], kind)
                crowded = len(last[0]) > hot
                held = None if crowded else last
                if crowded:
                    yield decide(last, HOT)
        if held is not None and len(held[0]) > 1:
            yield decide(held, OPEN)

    return run


# --------------------------------------------------------- 3: factor boundaries


def _passages(width: int):
    """Rows of text and the contexts whose words decide, to their words, each for its block; without words what the batch has earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, tie = b.column(0).to_pylist(), b.column(1).to_pylist()
            single: dict[int, tuple] = {}
            out = []
            for i in sorted(range(b.num_rows), key=lambda i: (did[i], tie[i])):  # noqa: B023
                words = b.column(2)[i].as_py().encode("utf-8", "surrogatepass").split()
                for c in sorted(b.column(3)[i].as_py(), key=lambda c: c["start"]):
                    start, n = c["start"], c["n"]
                    if c["kind"] == OPEN:
                        out.append((c["anchor"], did[i], tie[i], start, n, b" ".join(words[start : start + n])))
                        continue
                    for at in range(start, start + n - width + 1):
                        window = b" ".join(words[at : at + width])
                        block = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "big", signed=True)
                        earlier = single.setdefault(block, (did[i], tie[i], at, window))
                        if earlier[3] != window or earlier[:3] == (did[i], tie[i], at):
                            out.append((block, did[i], tie[i], at, width, window))
                        else:
                            out.append((at, did[i], tie[i], at, width, None))
                if len(out) > 20_000:
                    yield _rows(PASSAGE, *zip(*out, strict=True))
                    out = []
            if out:
                yield _rows(PASSAGE, *zip(*out, strict=True))

    return run


class Block:
    """The index of a reference block: where each window of its passages first stands."""

    def __init__(self, width: int) -> None:
        self.width, self.texts, self.index = width, [], {}

    def parse(self, passage: bytes) -> list[tuple[int, int]]:
        """Factors of a passage, first word and words, by the passages before; then windows that are new are indexed."""
        words, found, at = passage.split(), [], 0
        self.texts.append(words)
        while at + self.width <= len(words):
            window = b" ".join(words[at : at + self.width])
            source = self.index.setdefault(window, (len(self.texts) - 1, at))
            if source == (len(self.texts) - 1, at):
                at += 1
                continue
            text, n = self.texts[source[0]], self.width
            while at + n < len(words) and source[1] + n < len(text) and words[at + n] == text[source[1] + n]:
                n += 1
            found.append((at, n))
            # The factor can't go on: the windows across its end are looked up one by one.
            at += n - self.width + 1
        if found == [(0, len(words))]:
            self.texts.pop()
        return found


def _parse(width: int):
    """A block's passages, sorted by block and place, to factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, last = None, Block(width), None
        for b in batches:
            out = []
            for k, did, tie, start, n, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if words is None:
                    out.append((did, tie, start, n, 0, FOUND))
                    continue
                if k != key:
                    key, block = k, Block(width)
                elif (did, tie, start) == last:  # of an equal document
                    continue
                last = did, tie, start
                out += [(did, tie, start + at, size, 0, FOUND) for at, size in block.parse(words)]
            if out:
                yield _rows(FACTOR, *zip(*out, strict=True))

    return run


# --------------------------------------------------------------------- 4: cuts


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their factors to what is left of them; of a copy (nth of equal rows, from 2) nothing is."""
    for b in batches:
        out = []
        for did, text, start, size, width, nth in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = text.encode("utf-8", "surrogatepass").split()
            n = len(words)
            if nth > 1 and n >= width:
                start, size = [0], [n]
            spans, kept = [], words
            if start:
                a = np.array(start)
                cover = np.cumsum(np.bincount(a, minlength=n + 1) - np.bincount(a + np.array(size), minlength=n + 1)) > 0
                edge = np.flatnonzero(np.diff(np.r_[False, cover[:n], False].astype(np.int8)))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
                kept = list(compress(words, ~cover[:n]))
            out.append((None if did == NULL_ID else did, n, n - len(kept), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
        if out:
            ids, words, removed, spans, kept = zip(*out, strict=True)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 20, gram: int = 6, hot: int = 512) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_words, n_removed, spans (array of start and end, in words) and kept (the words left, joined by a blank).

    A word goes if one of the windows of ``width`` words that cover it starts elsewhere earlier: in a smaller doc_id, or
    before in its own document. ``gram`` (words of an anchor) and ``hot`` don't change results.
    """
    if not 0 < gram <= width:
        raise ValueError("an anchor has from 1 word to a window's")
    bound_batches(docs.sparkSession)
    parts = parts_of(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("tie"), text.alias("text"))
    found = rows.mapInArrow(_anchors(width, gram), CONTEXT).repartition(parts, "anchor").sortWithinPartitions("anchor", "context", "did", "tie", "start")
    found = cut(found.mapInArrow(_index(hot), FACTOR), "factors")
    rows = rows.repartition(parts, "did", "tie")
    unsure = found.filter(F.col("kind") != FOUND).groupBy("did", "tie").agg(F.collect_list(F.struct("start", "n", "anchor", "kind")).alias("unsure"))
    passages = rows.join(unsure, ["did", "tie"]).select("did", "tie", "text", "unsure").mapInArrow(_passages(width), PASSAGE)
    parsed = passages.repartition(parts, "block").sortWithinPartitions("block", "did", "tie", "start").mapInArrow(_parse(width), FACTOR)
    known = found.filter(F.col("kind") == FOUND).select("did", "tie", "start", "n").unionByName(parsed.select("did", "tie", "start", "n"))
    known = known.groupBy("did", "tie").agg(F.collect_list(F.struct("start", "n")).alias("known"))
    nth = F.row_number().over(Window.partitionBy("did", "tie").orderBy("did"))
    told = rows.join(known, ["did", "tie"], "left").select("did", "text", "known.start", "known.n", F.lit(width).alias("width"), nth.alias("nth"))
    return told.mapInArrow(_cuts, "doc_id long, n_words long, n_removed long, spans array<struct<start: int, end: int>>, kept string")
