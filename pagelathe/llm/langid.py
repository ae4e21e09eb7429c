"""Language identification by language-bitmask n-gram filters.

Every language has a Bloom filter of its characteristic n-grams; the filters are bit-sliced: slot by slot they lie side
by side in one integer, a bit for each language, so that two lookups and one AND give all languages that contain an
n-gram. A text's n-grams are counted per language, each count is corrected for its filter's false positives, and the
largest decides.

Defined results: ``und`` with score 0 for a null text or one without a letter (or when nothing could be learned); a text
with letters but no known n-gram gets the language seen most in training, score 0; repeated rows are judged alike; ties
go to the first language in name order. Texts are read whole, in chunks of bounded size. An empty table gives no rows;
columns other than the id, the text and (in training) the language are ignored, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut, small_side

SIZES = (3, 4)
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
PROBES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
#: Characters of a text handled at once.
CHUNK = 1 << 19
#: A task fills two to the power of this many slots of the filters at once.
BLOCK_BITS = 16


@dataclass(frozen=True)
class Model:
    languages: list[str]
    common: str | None
    bits: int
    slices: list[np.ndarray] = field(repr=False)
    false_rate: np.ndarray = field(repr=False)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Code points in lower case; each run of others is one blank; a blank at either end. Empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[c]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.where(letter, c, 32)[keep]
    return np.r_[np.uint32(32), c, np.uint32(32)].astype(np.uint64) if letter.any() else np.zeros(0, np.uint64)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded size, cut at a blank where there is one."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end), -1)
            end = at + CHUNK if end <= at else end
        yield text[at:end]
        at = end


def grams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of each size, in order of place."""
    for n in SIZES:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, np.uint64(n), np.uint64)
            for i in range(n):
                h = (h ^ (codes[i : len(codes) - n + 1 + i] * MULTIPLIERS[i])) * MULTIPLIERS[3 - i]
            yield h ^ (h >> np.uint64(29))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    held: dict[str, list[np.ndarray]] = {}

    def fold(lang: str) -> None:
        g, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        if lang in sums:
            g, at = np.unique(np.r_[sums[lang][0], g], return_inverse=True)
            n = np.bincount(at, np.r_[sums[lang][1], n]).astype(np.int64)
        sums[lang] = g, n

    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for piece in _pieces(text):
                held.setdefault(lang, []).extend(grams(_codes(piece)))
            if sum(map(len, held.get(lang, ()))) > 1 << 20:
                fold(lang)
    for lang in [x for x, y in held.items() if y]:
        fold(lang)
    for lang, (g, n) in sums.items():
        for i in range(0, len(g), 50_000):
            part = g[i : i + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + 50_000].astype(np.int64))], names=["lang", "gram", "n"])


def _slots(order: dict[str, int], bits: int):
    """Rows of lang and gram to the slots of their filters, with the language's bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = np.array([order[x] for x in b.column(0).to_pylist()], np.uint64)
            g = np.asarray(b.column(1)).view(np.uint64)
            for p in PROBES:
                slot = ((g * p) >> np.uint64(64 - bits)).astype(np.int64)
                mask = (np.uint64(1) << (lang % np.uint64(64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((lang // np.uint64(64)).astype(np.int64)), pa.array(slot), pa.array(mask)], names=["part", "slot", "mask"])

    return run


def _width(languages: int) -> type:
    return next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if languages <= most)


def _blocks(sizes: list[int], bits: int):
    """The filled slots of one block to its stretch of the finished filters."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        part, block = (k.as_py() for k in key)
        out = np.zeros(1 << min(bits, BLOCK_BITS), _width(sizes[part]))
        out[np.asarray(rows["slot"]) - (block << BLOCK_BITS)] = np.asarray(rows["mask"]).view(np.uint64).astype(out.dtype)
        return pa.table({"part": pa.array([part], pa.int64()), "block": pa.array([block], pa.int64()), "filled": pa.array([out.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, per_language: int = 1500, min_count: int = 3, share: float = 0.5, bits: int = 20, max_chars: int = 1 << 24) -> Model:
    """Learn from docs (doc_id, text, lang): rows with text and lang.

    Bound: about per_language texts of each language (those that hash lowest), or as many fewer as hold about max_chars
    code points where its texts are long. An n-gram belongs to a language if it occurs there min_count times and its rate
    is at least ``share`` of its highest rate in any. Filters have two to the power of ``bits`` slots, or as many more as
    keep 16 for each n-gram of the fullest, so that at most one of 64 strange n-grams is found in one; they are built in
    tasks, and only they and a row a language come to the driver.
    """
    bound_batches(docs.sparkSession)
    rows = docs.filter("text IS NOT NULL AND lang IS NOT NULL")
    # One row a language; the share that gives the wanted number is compared with a row's hash, so nothing is sorted and
    # no text but the sample's moves. Repeated rows hash alike and count once.
    part = F.least(F.lit(per_language) / F.count(F.lit(1)), F.lit(max_chars) / F.greatest(F.sum(F.length("text")), F.lit(1)))
    wanted = rows.groupBy("lang").agg((part * (1 << 30)).alias("most")).select(F.col("lang").alias("l"), "most")
    h = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    sample = rows.select("doc_id", "text", "lang").join(small_side(cut(wanted, "rates")), F.col("lang") == F.col("l")).filter(h < F.col("most"))
    sample = cut(sample.groupBy("lang", F.xxhash64("doc_id", "text").alias("h")).agg(F.min("text").alias("text")).select("text", "lang").repartition(16), "langs")
    counts = cut(sample.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = cut(counts.groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("total")), "totals")
    counts = counts.join(small_side(totals), F.col("lang") == F.col("l")).withColumn("rate", F.col("n") / F.col("total"))
    # A gram has at most a row for each language.
    counts = counts.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter((F.col("rate") >= share * F.col("top")) & (F.col("n") >= min_count))
    own = cut(counts.select("lang", "gram", "n"), "own")
    known = {r["lang"]: (r["grams"], r["n"]) for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("grams"), F.sum("n").alias("n")).collect()}
    languages = sorted(known)
    bits = max(bits, *(int(16 * n).bit_length() for n, _ in known.values()), 1)
    sizes = [len(languages[i : i + 64]) for i in range(0, len(languages), 64)]
    masks = [np.zeros(1 << bits, _width(n)) for n in sizes]
    slots = own.select("lang", "gram").mapInArrow(_slots({x: i for i, x in enumerate(languages)}, bits), "part long, slot long, mask long")
    slots = slots.groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).withColumn("block", F.shiftright("slot", BLOCK_BITS))
    for r in slots.groupBy("part", "block").applyInArrow(_blocks(sizes, bits), "part long, block long, filled binary").collect():
        found = np.frombuffer(r["filled"], masks[r["part"]].dtype)
        masks[r["part"]][r["block"] << BLOCK_BITS :][: len(found)] = found
    false_rate = np.array([np.mean((masks[i // 64] >> masks[i // 64].dtype.type(i % 64)) & masks[i // 64].dtype.type(1)) ** len(PROBES) for i in range(len(languages))])
    return Model(languages, max(languages, key=lambda x: (known[x][1], x), default=None), bits, masks, false_rate)


def predict_text(text: str | None, m: Model) -> tuple[str, float]:
    hits, total, letters = np.zeros(len(m.languages)), 0, False
    for piece in _pieces(text or ""):
        codes = _codes(piece)
        letters |= len(codes) > 0
        for h in grams(codes):
            total += len(h)
            at = [(h * p) >> np.uint64(64 - m.bits) for p in PROBES]
            for k, table in enumerate(m.slices):
                both = table[at[0]] & table[at[1]]
                for i in range(k * 64, min(len(m.languages), k * 64 + 64)):
                    hits[i] += np.count_nonzero(both & table.dtype.type(1 << (i - k * 64)))
    if not letters or not m.languages:
        return "und", 0.0
    hits = np.maximum(0.0, (hits - total * m.false_rate) / (1 - m.false_rate))
    if hits.max() <= 0:
        return m.common, 0.0
    i = int(np.argmax(hits))
    return m.languages[i], float(min(1.0, hits[i] / hits.sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) to doc_id, lang_pred, score. The model's size is bounded by its sample: two to the power of its bits, times its languages' bits."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [predict_text(t.as_py(), m) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
