"""SentencePiece encoding and decoding with the N best segmentations of each text.

A text is a lattice of vocabulary pieces; a segmentation's score is the sum of its pieces' scores in the model file (a
character without a piece becomes its UTF-8 bytes' pieces, at ten below the lowest score). For unigram models that is the
library's own N-best list. Of a merge model the scores are ranks of merges: the library applies merges instead and offers
no N-best list, so the best path here is another segmentation than its own. Forward Viterbi scores of all
places are the exact heuristic of a backward A* search from the end, which so pops segmentations best first.

Where no piece of the model reaches over a blank or a line end (or from a letter to a mark), a text's lattice is a chain of
independent units (a blank and the word behind it); else a text is one unit. Texts are cut together, in arrays; each
distinct unit of them is looked up once, solved once (new ones together) and kept, with whether its ids spell it. The N best
of a text change none but the N - 1 units whose second-best segmentations cost least: those gaps come exactly from forward
and backward scores, and only those units are searched by A*. Scores are kept as whole numbers of 2 ** -shift, so nothing is lost to rounding.

Defined results: a null or empty text has no tokens, one segmentation with score 0; among equal scores the Viterbi path
(longest last pieces) comes first; a text with fewer segmentations than asked for gives fewer; repeated rows are encoded
alike; texts are encoded whole, in memory bounded by one text and a cache of fixed size. An empty table gives no rows; a
row is in a struct, so its columns can't clash. A model of more than 65,536 pieces, or with scores finer than 2^-30, raises.
"""

from __future__ import annotations

import heapq
import itertools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import CACHES, release
from pagelathe.llm.common import batches as bound_batches

BLANK = "▁"
LETTER, MARK = "[A-Za-z\u00c0-\u024f]", "[.,!?;:|]"
#: Units: a blank and the word behind it, or a line end; also cut between a letter and a mark, where no piece joins them.
WORDS = re.compile(f"{BLANK}?[^{BLANK}\n]+|{BLANK}|\n")
FINER = re.compile(f"{BLANK}?[^{BLANK}\n.,!?;:|]*{LETTER}(?={MARK})|{WORDS.pattern}")
WHOLE = re.compile("(?s).+")
#: Such scores are a model's way to say that a piece isn't used (runs of blanks): such pieces take no part; a single
#: character of that kind scores like one without a piece.
UNUSED = -1e8
NONE = -(1 << 60)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: By bytes of UTF-8: marks, letters of one byte.
MARKS, LETTERS = (np.array([bool(re.match(x, chr(b))) for b in range(128)] + [False] * 128) for x in (MARK, LETTER))
WIDEST, SLOT_BITS = 24, 18


class Pieces:
    """The pieces of a model file, and the solved units."""

    def __init__(self, path: str, most: int = 700_000) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.vocab_size() > 1 << 16:
            raise ValueError("ids are held in two bytes")
        self.most, self.ids, self.scores, self.surface = most, {}, {}, [b""] * sp.vocab_size()
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.surface[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                piece, score = sp.id_to_piece(i), sp.get_score(i)
                self.surface[i] = piece.replace(BLANK, " ").encode()
                if score > UNUSED or len(piece) == 1:
                    self.ids[piece], self.scores[piece] = i, score
        used = [x for x in self.scores.values() if x > UNUSED]
        self.shift = next((n for n in range(31) if all((x * 2**n).is_integer() for x in used)), None)
        if self.shift is None:
            raise ValueError("a score is finer than 2 ** -30")
        self.scores = {x: s if s <= UNUSED else int(s * 2**self.shift) for x, s in self.scores.items()}
        cross = any(BLANK in x[1:] or ("\n" in x and len(x) > 1) for x in self.ids)
        self.unit = WHOLE if cross else WORDS if any(re.search(LETTER + MARK, x) for x in self.ids) else FINER
        if cross:
            self.most = 0  # whole texts aren't met again
        self.known = frozenset(x for x in self.ids if len(x) == 1)
        self.longest = max(map(len, self.ids))
        self.unknown = int((min(used) - 10) * 2**self.shift)
        self.scores = {x: s if type(s) is int else self.unknown for x, s in self.scores.items()}
        # A trie of the pieces: (node, character) to a node, as keys in a table of slots; a full slot passes a key on to the next.
        steps: dict[int, int] = {}
        ends = {}
        for piece in self.ids:
            node = 0
            for c in piece:
                node = steps.setdefault(node << 21 | ord(c), len(steps) + 1)
            ends[node] = piece
        self.node_score, self.node_id = np.full(len(steps) + 1, NONE, np.int64), np.zeros(len(steps) + 1, np.uint16)
        for node, piece in ends.items():
            self.node_score[node], self.node_id[node] = self.scores[piece], self.ids[piece]
        bits = max(SLOT_BITS, (4 * len(steps)).bit_length())
        self.slot_shift = np.uint64(64 - bits)
        self.slot_key, self.slot_node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.probes = 1
        for at, (key, node) in zip(self._slots(np.array(list(steps), np.int64)).tolist(), steps.items(), strict=True):
            n = 1
            while self.slot_key[at] >= 0:
                at, n = (at + 1) % len(self.slot_key), n + 1
            self.slot_key[at], self.slot_node[at], self.probes = key, node, max(self.probes, n)
        self.surface_size = np.array([len(x) for x in self.surface], np.int64)
        self.clear()

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * SPREAD >> self.slot_shift).view(np.int64)

    def _next(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The nodes that the characters lead to from those nodes; 0: none."""
        keys = nodes << 21 | codes
        slot = self._slots(keys)
        here = self.slot_key[slot]
        out = np.where(here == keys, self.slot_node[slot], 0)
        open_ = np.flatnonzero((here != keys) & (here >= 0))
        for n in range(1, self.probes):
            if not len(open_):
                break
            at = (slot[open_] + n) % len(self.slot_key)
            here = self.slot_key[at]
            hit = here == keys[open_]
            out[open_[hit]] = self.slot_node[at[hit]]
            open_ = open_[~hit & (here >= 0)]
        return out

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        # Of each unit held: where its best ids begin and how many they are, their score, the gap to the second best, whether they spell it.
        self.flat = np.zeros(0, "<u2")
        self.first, self.size, self.score, self.gap = (np.zeros(0, np.int64) for _ in range(4))
        self.spells = np.zeros(0, bool)
        self.searched: dict[tuple[str, int], list[tuple[int, tuple[int, ...]]]] = {}

    # -------------------------------------------------- one unit, plainly

    def edges(self, unit: str, end: int) -> Iterator[tuple[int, int, str | None]]:
        """(start, score, piece) of the pieces that end there; piece None: a character by its bytes."""
        for start in range(max(0, end - self.longest), end):
            piece = unit[start:end]
            if piece in self.scores:
                yield start, self.scores[piece], piece
        if unit[end - 1] not in self.scores:
            yield end - 1, self.unknown, None

    def forward(self, unit: str) -> list[int]:
        best = [0] + [NONE] * len(unit)
        for end in range(1, len(unit) + 1):
            best[end] = max(best[start] + score for start, score, _ in self.edges(unit, end))
        return best

    def tokens(self, unit: str, start: int, piece: str | None) -> tuple[int, ...]:
        return (self.ids[piece],) if piece else tuple(self.bytes[b] for b in unit[start].encode("utf-8", "replace"))

    def search(self, unit: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best segmentations of a unit: backward A*, the forward scores as heuristic."""
        if (unit, n) in self.searched:
            return self.searched[unit, n]
        if len(self.searched) > min(50_000, self.most):
            self.searched.clear()
        ahead = self.forward(unit)
        count = itertools.count()
        agenda = [(-ahead[-1], next(count), len(unit), 0, None)]
        out: list[tuple[int, tuple[int, ...]]] = []
        while agenda and len(out) < n:
            cost, _, place, behind, path = heapq.heappop(agenda)
            if place == 0:
                ids: list[int] = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-cost, tuple(ids)))
                continue
            for start, score, piece in self.edges(unit, place):
                heapq.heappush(agenda, (-(ahead[start] + score + behind), next(count), start, behind + score, (self.tokens(unit, start, piece), path)))
        self.searched[unit, n] = out
        return out

    # -------------------------------------------------- many units at once

    def _solve_plain(self, unit: str) -> tuple[np.ndarray, int, int]:
        """As _solve_many, for long units and those with characters without a piece: linear in the unit's length."""
        ahead = self.forward(unit)
        ids: list[tuple[int, ...]] = []
        on, place = set(), len(unit)
        while place:
            start, score, piece = min((e for e in self.edges(unit, place) if ahead[e[0]] + e[1] == ahead[place]), key=lambda e: e[0])
            on.add((start, place))
            ids.append(self.tokens(unit, start, piece))
            place = start
        back = [NONE] * len(unit) + [0]
        second = NONE
        for end in range(len(unit), 0, -1):
            for start, score, _ in self.edges(unit, end):
                back[start] = max(back[start], score + back[end])
        for end in range(len(unit), 0, -1):
            for start, score, _ in self.edges(unit, end):
                if (start, end) not in on:
                    second = max(second, ahead[start] + score + back[end])
        return np.array([i for x in reversed(ids) for i in x], "<u2"), ahead[-1], ahead[-1] - second

    def _solve_many(self, units: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For units of one length: all their best ids, how many each has, scores, and gaps to the second best (huge if there is none)."""
        m = len(units)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).reshape(m, width).T.astype(np.int64).ravel()
        reach = min(self.longest, width)
        score = np.full((reach + 1, width, m), NONE, np.int64)
        ids = np.zeros((reach + 1, width, m), np.uint16)
        # From all places at once, a character a step; what is no piece's beginning goes.
        live, nodes, some = np.arange(width * m), np.zeros(width * m, np.int64), np.zeros((reach + 1, width), bool)
        for n in range(1, reach + 1):
            inside = np.searchsorted(live, (width - n + 1) * m)
            live, nodes = live[:inside], nodes[:inside]
            nodes = self._next(nodes, codes[live + (n - 1) * m])
            on = np.flatnonzero(nodes)
            live, nodes = live[on], nodes[on]
            if not len(live):
                break
            found = self.node_score[nodes]
            end = np.flatnonzero(found > NONE)
            score[n].ravel()[live[end]] = found[end]
            ids[n].ravel()[live[end]] = self.node_id[nodes[end]]
            some[n] = np.bincount(live[end] // m, minlength=width) > 0
        steps = [[n for n in range(1, min(reach, width - start) + 1) if some[n, start]] for start in range(width)]
        ahead = np.full((width + 1, m), NONE, np.int64)
        step = np.zeros((width + 1, m), np.int64)
        ahead[0] = 0
        for end in range(1, width + 1):
            for n in range(1, min(reach, end) + 1):
                if some[n, end - n]:
                    x = ahead[end - n] + score[n, end - n]
                    np.copyto(step[end], n, where=x >= ahead[end])
                    np.maximum(ahead[end], x, out=ahead[end])
        rows, place = np.arange(m), np.full(m, width)
        path, size = np.zeros((m, width), "<u2"), np.zeros(m, np.int64)
        taken = np.zeros((width, m), np.int64)
        live = rows
        while len(live):
            n = step[place[live], live]
            place[live] -= n
            size[live] += 1
            path[live, width - size[live]] = ids[n, place[live], live]
            taken[place[live], live] = n
            live = live[place[live] > 0]
        # The second best uses one piece off the best path at least.
        back = np.full((width + 1, m), NONE, np.int64)
        back[width] = 0
        second = np.full(m, NONE, np.int64)
        for start in range(width - 1, -1, -1):
            for n in steps[start]:
                x = score[n, start] + back[start + n]
                np.maximum(back[start], x, out=back[start])
                x += ahead[start]
                np.copyto(x, NONE, where=taken[start] == n)
                np.maximum(second, x, out=second)
        return path[np.arange(width) >= (width - size)[:, None]], size, ahead[width], ahead[width] - second

    def places(self, texts: list[list[str]]) -> list[list[int]]:
        """Where the units of texts are held, solving those that aren't yet."""
        out = [list(map(self.at.get, units)) for units in texts]
        lost = [i for i, own in enumerate(out) if None in own]
        new = {u for i in lost for u, place in zip(texts[i], out[i], strict=True) if place is None}
        if len(self.at) + len(new) > self.most:
            self.clear()
            lost, new = range(len(texts)), set(itertools.chain.from_iterable(texts))
        self.learn(new)
        for i in lost:
            out[i] = [self.at[u] for u in texts[i]]
        return out

    def learn(self, units: set[str]) -> None:
        """Solve units, none of which is held."""
        by: dict[int, list[str]] = {}
        for u in units:
            plain = len(u) > WIDEST or not self.known.issuperset(u)
            by.setdefault(0 if plain else len(u), []).append(u)
        names: list[str] = []
        new: list[tuple[np.ndarray, ...]] = []
        for width, own in sorted(by.items()):
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                if width:
                    ids, size, score, gap = self._solve_many(part, width)
                else:
                    solved = [self._solve_plain(u) for u in part]
                    ids, (size, score, gap) = np.concatenate([x for x, _, _ in solved]), np.array([(len(x), s, g) for x, s, g in solved], np.int64).T
                names += part
                new.append((ids, size, score, gap, self.spelled(part, ids, size)))
        if new:
            self.at.update(zip(names, range(len(self.size), len(self.size) + len(names)), strict=True))
            self.flat, self.size, self.score, self.gap, self.spells = (np.concatenate([held, *more]) for held, more in zip((self.flat, self.size, self.score, self.gap, self.spells), zip(*new, strict=True), strict=True))
            self.first = np.cumsum(self.size) - self.size

    def spelled(self, units: list[str], ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which of the units come back when their ids are decoded."""
        raw = b"".join([self.surface[i] for i in ids.tolist()])
        ends = np.cumsum(self.surface_size[ids])[np.cumsum(size) - 1].tolist()
        return np.array([raw[a:b] == u.replace(BLANK, " ").encode() for a, b, u in zip([0, *ends[:-1]], ends, units, strict=True)], bool)

    # ------------------------------------------------------------ texts

    def cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct units of texts, the units of all texts as places in that list, and where each text's units end.

        Of bytes, what ``unit.findall`` finds in each text, with a blank before it.
        """
        rows = [f" {t.replace(BLANK, ' ')}".encode() if t else b"" for t in texts]
        raw, ends = b"".join(rows), np.cumsum([len(x) for x in rows], dtype=np.int64)
        codes = np.frombuffer(raw, np.uint8)
        if self.unit is WHOLE:
            starts = np.unique(np.r_[0, ends])[:-1]
        else:
            begins = (codes == 32) | (codes == 10)
            begins[1:] |= codes[:-1] == 10
            starts = np.flatnonzero(begins)
            if self.unit is FINER:
                # A word's first mark begins a unit if a letter (of one byte, or of two from U+00C0 to U+024F) stands before it.
                marks = np.flatnonzero(MARKS[codes])
                word = np.searchsorted(starts, marks, "right")
                marks = marks[(np.diff(word, prepend=0) > 0) & (marks > starts[word - 1])]
                last, lead = codes[marks - 1], codes[marks - 2]
                begins[marks[LETTERS[last] | (last >= 0x80) & (lead >= 0xC3) & ((lead < 0xC9) | (lead == 0xC9) & (last < 0x90))]] = True
                starts = np.flatnonzero(begins)
        offsets = np.append(starts, len(raw)).astype(np.int64)
        found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        words = pc.replace_substring(found.dictionary, " ", BLANK).to_numpy(zero_copy_only=False)
        return words, found.indices.to_numpy(), np.searchsorted(starts, ends)

    def units(self, text: str | None) -> list[str]:
        words, at, _ = self.cut([text])
        return words[at].tolist()

    def nbest(self, units: Sequence[str], places: Sequence[int], n: int) -> tuple[bytes, list[tuple[int, list[tuple[int, int, tuple[int, ...]]]]]]:
        """Best ids as two-byte numbers; then for each of the n best: score and changes (at token, tokens dropped, ids put)."""
        at = np.asarray(places, np.int64)
        first, size = self.first[at], self.size[at]
        begins = np.cumsum(size) - size
        raw = self.flat[np.arange(size.sum()) + np.repeat(first - begins, size)]
        total = int(self.score[at].sum())
        gaps = self.gap[at]
        least = np.argsort(gaps, kind="stable") if len(gaps) <= n else np.argpartition(gaps, n - 1)[: n - 1]
        tops: list[tuple[int, list[tuple[int, tuple[int, ...]]]]] = [(0, [])]
        for u in sorted(int(x) for x in least[: max(0, n - 1)]):
            if gaps[u] < -NONE // 2:
                own = self.search(units[u], n)
                best = tuple(raw[begins[u] : begins[u] + size[u]].tolist())
                other = [x for x in own if x[1] != best][: n - 1]
                choices = [(0, None), *((own[0][0] - score, seq) for score, seq in other)]
                tops = heapq.nsmallest(n, ((cost + more, [*changes, (u, seq)] if seq else changes) for cost, changes in tops for more, seq in choices), key=lambda x: x[0])
        return raw.tobytes(), [(total - cost, [(int(begins[u]), int(size[u]), seq) for u, seq in changes]) for cost, changes in tops]

    def decode(self, ids) -> str:
        raw = b"".join([self.surface[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}
CACHES.append(_loaded)


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


CHANGE = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("put", pa.list_(pa.int32()))])
ENCODED = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("nbest", pa.list_(pa.struct([("score", pa.int64()), ("changes", pa.list_(CHANGE))]))), ("round_trip", pa.bool_())])
ENCODED_DDL = "struct<ids: array<int>, n_tokens: bigint, ids_crc32: bigint, nbest: array<struct<score: bigint, changes: array<struct<at: int, drop: int, put: array<int>>>>>, round_trip: boolean>"


def _encode_texts(texts: list[str | None], p: Pieces, n: int, ids_out: bool) -> pa.Array:
    flat, sizes, crcs, nbests, trips = [], [], [], [], []
    part: list[str | None] = []

    def flush() -> None:
        words, at, ends = p.cut(part)
        places, names = np.array(p.places([words.tolist()])[0], np.int64)[at], words[at]
        begin = 0
        for text, end in zip(part, ends.tolist(), strict=True):
            own = places[begin:end]
            raw, best = p.nbest(names[begin:end], own, n)
            begin = end
            ids = np.frombuffer(raw, "<u2")
            sizes.append(len(ids))
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            nbests.append([{"score": s, "changes": [{"at": a, "drop": d, "put": list(q)} for a, d, q in c]} for s, c in best])
            # A text comes back if all of its units do.
            trips.append(bool(p.spells[own].all()) or p.decode(ids.tolist()) == (text or "").replace(BLANK, " "))
            if ids_out:
                flat.append(ids)
        part.clear()

    held = 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held > 1 << 22:
            flush()
            held = 0
    flush()
    ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, "<u2"), *flat]).astype(np.int32))) if ids_out else pa.nulls(len(texts), pa.list_(pa.int32()))
    arrays = [ids, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(nbests, ENCODED.field("nbest").type), pa.array(trips, pa.bool_())]
    return pa.StructArray.from_arrays(arrays, fields=list(ENCODED))


def encode(docs: DataFrame, model: str, n: int = 4, ids: bool = True) -> DataFrame:
    """docs in full, in a struct row, with ``encoded``: ids (null unless asked for), n_tokens, ids_crc32 (of the ids as u32), nbest, round_trip.

    round_trip: decoding the ids gives the text again (with its own blank signs, U+2581, as blanks).
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf(ENCODED_DDL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release(_loaded)
        p = pieces(model)
        for texts in batches:
            yield _encode_texts(texts.to_pylist(), p, n, ids)

    return docs.select(F.struct("*").alias("row"), run(F.col("text")).alias("encoded"))


def decode(encoded: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """encoded with an array column of ids to the same rows in a struct row, with text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = pieces(model)
        for b in batches:
            yield pa.array([None if x is None else p.decode(x) for x in b.to_pylist()], pa.string())

    return encoded.select(F.struct("*").alias("row"), run(F.col(ids)).alias("text"))
