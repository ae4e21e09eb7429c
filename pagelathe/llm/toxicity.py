"""Toxicity: a learned lexicon in a trie, searched by Levenshtein automata, and scores of the words around each hit.

Training (a bounded sample of labelled texts) finds words, and word beginnings, that toxic texts hold far oftener than
others, and words that stand beside them where they are only reported. Matching runs every word through the intersection of the lexicon's trie with the Levenshtein automaton of the
word's edits; the product's states are built when first reached and kept, so a word costs a few table steps. The words
around a hit, and quotation marks, tell reported speech from abuse.

Defined results: a null or empty text scores as a text without a hit; repeated rows score alike; nothing but the text
enters a score. Texts are read whole; memory is bounded by one text and two caches of fixed size. An empty table gives no
rows, and without a labelled text of either kind no lexicon. Scored rows are in a struct, so their columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import CACHES, release
from pagelathe.llm.common import batches as bound_batches
from pagelathe.llm.common import cut

#: Marks that open or close a quotation.
QUOTES = "\"'“”„‟«»‹›‘’‚`"
PREFIXES = range(4, 8)
WINDOW = 6
#: What each further term of a text adds, against the one before it in strength: terms of one text are not independent.
DAMPING = 0.5
#: Texts with hits, of either label, at which half of what they say about the words around hits is believed.
DOUBT = 20
KINDS = ("word", "prefix", "fuzzy")


def strip_word(token: str) -> str:
    """The token in lower case from its first to its last letter or digit."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j].lower()


@dataclass(frozen=True)
class Lexicon:
    """words and prefixes: term to weight (log likelihood ratio). base, prior: log odds of a text without hits, and of any. quoted: what a quotation leaves of a kind's weight. fuzzy: weight of misspellings of a term. context: weight of a word near a hit. reporting: words that tell of speech, by what they stand beside."""

    words: dict[str, float]
    prefixes: dict[str, float]
    base: float
    prior: float
    quoted: dict[str, float] = field(default_factory=dict)
    fuzzy: dict[str, float] = field(default_factory=dict)
    context: dict[str, float] = field(default_factory=dict)
    reporting: frozenset[str] = frozenset()


class Matcher(dict):
    """Token to (kind, term, edits) or None; a dict, so that a known token costs one lookup."""

    def __init__(self, words, prefixes, most: int = 120_000) -> None:
        super().__init__()
        self.most, self.old = most, {}
        self.trie: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.prefix: list[str | None] = [None]
        #: Edits that some word below a node allows.
        self.slack = [0]
        for term in sorted(words):
            self.word[self._add(term, self.allowed(term))] = term
        for term in sorted(prefixes):
            self.prefix[self._add(term, 0)] = term
        self._reset()

    @staticmethod
    def allowed(term: str) -> int:
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _add(self, term: str, slack: int) -> int:
        node = 0
        self.slack[0] = max(self.slack[0], slack)
        for c in term:
            if c not in self.trie[node]:
                self.trie[node][c] = len(self.trie)
                self.trie.append({})
                self.word.append(None)
                self.prefix.append(None)
                self.slack.append(0)
            node = self.trie[node][c]
            self.slack[node] = max(self.slack[node], slack)
        return node

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.steps: list[dict[str, int]] = []
        self.sets: list[dict[int, int]] = []
        self.ends: list[tuple[str, str, int] | None] = []
        self.begun: list[str | None] = []
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, found: dict[int, int]) -> int:
        """The product state of trie nodes with their fewest edits, after leaving out letters of terms."""
        queue = list(found.items())
        for node, edits in queue:
            if found[node] == edits:
                for child in self.trie[node].values():
                    if edits < self.slack[child] and found.get(child, 99) > edits + 1:
                        found[child] = edits + 1
                        queue.append((child, edits + 1))
        key = tuple(sorted(found.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(found)
            self.steps.append({})
            ends = [(e, self.word[n]) for n, e in found.items() if self.word[n] and e <= self.allowed(self.word[n])]
            edits, term = min(ends, default=(0, None))
            self.ends.append(("word" if not edits else "fuzzy", term, edits) if term else None)
            self.begun.append(next((self.prefix[n] for n, e in sorted(found.items()) if e == 0 and self.prefix[n]), None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            for letter, child in self.trie[node].items():
                e = edits + (letter != c)
                if e <= self.slack[child] or e == 0:
                    after[child] = min(e, after.get(child, 99))
            if edits < self.slack[node]:
                after[node] = min(edits + 1, after.get(node, 99))
        out = self.steps[state][c] = self._state(after)
        return out

    def __missing__(self, token: str):
        # Two generations: frequent tokens move up from the older one, memory stays bounded.
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if token in self.old:
            out = self[token] = self.old[token]
            return out
        if len(self.sets) > 50_000:
            self._reset()
        state, begun = self.start, None
        for c in strip_word(token):
            state = self.steps[state].get(c) if c in self.steps[state] else self._step(state, c)
            if state == self.dead:
                break
            begun = begun or self.begun[state]
        end = self.ends[state]
        if end and (end[0] == "word" or not begun):
            out = end
        else:
            out = ("prefix", begun, 0) if begun else None
        if len(token) <= 64:
            self[token] = out
        return out


def hits_of(text: str, matcher: Matcher, reporting: frozenset[str] = frozenset()) -> list[tuple[str, str, bool, list[str]]]:
    """Each hit's kind, term, whether it stands in a quotation or near a reporting word, and the words around it."""
    tokens = text.split()
    found = {t for t in set(tokens) if matcher[t]}
    if not found:
        return []
    out = []
    for i, token in enumerate(tokens):
        if token in found:
            kind, term, _ = matcher[token]
            around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
            near = [strip_word(x) for x in around]
            opened = token[0] in QUOTES or any(x[0] in QUOTES for x in tokens[max(0, i - WINDOW) : i])
            closed = token.rstrip(".,;:!?")[-1:] in QUOTES if token.rstrip(".,;:!?") else False
            closed = closed or any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in tokens[i + 1 : i + 1 + WINDOW] if x.rstrip(".,;:!?"))
            out.append((kind, term, (opened and closed) or not reporting.isdisjoint(near), near))
    return out


def score_text(text: str | None, m: Lexicon, matcher: Matcher) -> float:
    """Probability of label 1: prior log odds, plus all terms, each once, from the strongest with damping, and the strongest misspelling.

    Only one misspelling counts: chance likenesses pile up in long texts.
    """
    best: dict[str, float] = {}
    fuzzy = 0.0
    for kind, term, quoted, near in hits_of(text or "", matcher, m.reporting):
        w = m.prefixes.get(term, 0.0) if kind == "prefix" else m.words.get(term, 0.0)
        w = min(w, m.fuzzy.get(term, 0.0)) if kind == "fuzzy" else w
        w *= m.quoted[kind] if quoted else 1.0
        w += max(-1.0, min(1.0, sum(m.context.get(x, 0.0) for x in near)))
        if kind == "fuzzy":
            fuzzy = max(fuzzy, w)
        else:
            best[term] = max(best.get(term, -9.0), w)
    z = m.prior + fuzzy + sum(w * DAMPING**i for i, w in enumerate(sorted(best.values(), reverse=True))) if best or fuzzy > 0 else m.base
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _log_odds(tox: float, clean: float, n_tox: float, n_clean: float) -> float:
    """With more doubt about absence from clean texts: near copies of one toxic text share their harmless words too."""
    return math.log((tox + 0.5) / (n_tox + 1)) - math.log((clean + 2) / (n_clean + 4))


def _counts(unit):
    """Map side of counting units of a text by label; unit gives a text's distinct units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([counts[k][0] for k in part], pa.int64()), pa.array([counts[k][1] for k in part], pa.int64())], names=["unit", "tox", "clean"])

        counts: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for u in unit(text):
                    counts.setdefault(u, [0, 0])[0 if toxic else 1] += 1
            if len(counts) > 300_000:
                yield from out(counts)
                counts = {}
        yield from out(counts)

    return run


def _terms(text: str) -> set[str]:
    words = {strip_word(t) for t in set(text.split())} - {""}
    return {"w" + w for w in words if len(w) > 2} | {f"p{w[:n]}" for w in words for n in PREFIXES if len(w) > n} | {"="}


def sample_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """About max_rows labelled documents (text, toxic): those whose doc_id hashes below the share that gives so many.

    A doc_id is toxic if any of its labels says so, and stands for one text, the least. The sample is bounded by
    max_rows, so its ids can be broadcast; no text is shuffled but the sample's.
    """
    labels = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = int(min(1.0, max_rows / max(1, labels.count())) * (1 << 30))
    ids = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_docs: int = 5, min_share: float = 0.004, min_odds: float = 3.0, reported: float = -1.5, rounds: int = 4) -> Lexicon:
    """docs: doc_id, text. labels: doc_id, toxic. Bound: about max_rows texts; all that is counted in them counts.

    A term must occur in min_docs toxic texts, min_share of them all, and with log odds of min_odds at least (so there are
    at most 1 / min_share times as many as words in a toxic text); it is sought in so many rounds, the strongest terms
    first. A word is a reporting one if it stands beside hits in a tenth of the clean texts with hits (min_docs
    at least), and the log odds of those hits are ``reported`` at most.
    """
    bound_batches(docs.sparkSession)
    rows = cut(sample_rows(docs, labels, max_rows).repartition(16), "labelled")

    def counted(unit, keep) -> list[tuple[str, int, int]]:
        sums = rows.mapInArrow(_counts(unit), "unit string, tox long, clean long").groupBy("unit").agg(F.sum("tox").alias("tox"), F.sum("clean").alias("clean"))
        return [tuple(r) for r in keep(sums).collect()]

    total = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    n_tox = total["t"] or 0
    n_clean = (total["n"] or 0) - n_tox
    least = max(min_docs, math.ceil(min_share * n_tox))
    strong = (F.col("tox") + 0.5) / (n_tox + 1) >= math.exp(min_odds) * (F.col("clean") + 2) / (n_clean + 4)
    found = counted(_terms, lambda s: s.filter((F.col("tox") >= least) & strong & (F.col("unit") != "=")))
    candidates = {u for u, _, _ in found}
    words: dict[str, float] = {}
    prefixes: dict[str, float] = {}
    # Harmless words of toxic texts stand beside telling ones: after the strongest terms, a term counts only for
    # texts that they leave unexplained.
    for _ in range(rounds):
        weight = {u: _log_odds(t, c, n_tox, n_clean) for u, t, c in found}
        weight = {u: w for u, w in weight.items() if w >= min_odds}
        if not weight:
            break
        strong = {u: t for u, t, _ in found if weight.get(u, 0) >= max(weight.values()) - 1}
        # A beginning stands for its words if it finds clearly more texts than each; the shortest such beginning wins.
        for u in sorted((u for u in strong if u[0] == "p"), key=lambda u: (len(u), u)):
            own = [strong[w] for w in strong if w[0] == "w" and w[1:].startswith(u[1:])]
            if strong[u] >= 1.25 * max(own, default=0) and not any(u[1:].startswith(p) for p in prefixes):
                prefixes[u[1:]] = weight[u]
        # Words that a beginning covers stay, for the automaton to find their misspellings.
        words |= {u[1:]: weight[u] for u in strong if u[0] == "w"}
        told, wanted = (dict(words), dict(prefixes)), frozenset(candidates)

        def unexplained(text: str, told=told, wanted=wanted) -> set[str]:
            matcher = _matcher(*told)
            if any(x and x[0] != "fuzzy" for x in (matcher[t] for t in set(text.split()))):
                return set()
            return _terms(text) & wanted

        found = counted(unexplained, lambda s: s.filter(F.col("tox") >= least))
    matcher_terms = (dict(words), dict(prefixes))

    def near_of(text: str) -> set[str]:
        hits = hits_of(text, _matcher(*matcher_terms))
        return {w for _, _, _, near in hits for w in near if len(w) > 1} | ({"="} if hits else set())

    beside = {u: (t, c) for u, t, c in counted(near_of, lambda s: s.filter((F.col("tox") + F.col("clean") >= 5) | (F.col("unit") == "=")))}
    hit = beside.pop("=", (0, 0))
    # Few hits of either label say little: the odds shrink towards none, without a number at which they begin to count.
    sure = min(hit) / (min(hit) + DOUBT)
    odds = {u: sure * _log_odds(t, c, *hit) for u, (t, c) in beside.items()}
    often = max(min_docs, math.ceil(0.1 * hit[1]))
    reporting = frozenset(u for u, x in odds.items() if x <= reported and beside[u][1] >= often)

    def kinds_of(text: str) -> set[str]:
        hits = hits_of(text, _matcher(*matcher_terms), reporting)
        kinds = {(k, q) for k, _, q, _ in hits}
        # A kind counts only where no surer kind or plainer use of the term is there too.
        order = [(k, q) for q in (False, True) for k in KINDS]
        first = next((x for x in order if x in kinds), None)
        fuzzy = {f"fuzzy {t}" for k, t, _, _ in hits} if first and first[0] == "fuzzy" else set()
        return fuzzy | ({f"{first[0]}{int(first[1])}"} if first else {"none"})

    # A few rows for kinds, and one a term at most.
    after = {u: (t, c) for u, t, c in counted(kinds_of, lambda s: s)}
    prior = math.log((n_tox + 0.5) / (n_clean + 1))
    none = after.get("none", (0, n_clean))
    base = math.log((none[0] + 0.5) / (none[1] + 1))
    # What a quotation leaves of a hit's weight: two pseudo texts say 0.4, texts whose only hits are quoted the rest.
    quoted = {}
    for k in KINDS:
        (t, c), (qt, qc) = after.get(f"{k}0", (0, 0)), after.get(f"{k}1", (0, 0))
        plain, said = (math.log((x + 0.5) / (y + 0.5)) - prior for x, y in ((t, c), (qt, qc)))
        share = max(0.1, min(1.0, said / plain)) if plain > 0 and qt + qc else 0.4
        quoted[k] = (2 * 0.4 + (qt + qc) * share) / (2 + qt + qc)
    fuzzy = {}
    for term in words:
        t, c = after.get(f"fuzzy {term}", (0, 0))
        # A term's misspellings start below the term itself, the further the shorter it is: short ones are met by chance.
        fuzzy[term] = (2 * (words[term] - max(0.5, 6 - len(term) / 2)) + (t + c) * (math.log((t + 0.5) / (c + 0.5)) - prior)) / (2 + t + c)
    return Lexicon(words, prefixes, base, prior, quoted, fuzzy, {u: 0.25 * x for u, x in odds.items()}, reporting)


_matchers: dict[tuple, Matcher] = {}
CACHES.append(_matchers)


def _matcher(words: dict[str, float], prefixes: dict[str, float]) -> Matcher:
    key = (tuple(sorted(words)), tuple(sorted(prefixes)))
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(words, prefixes)
    return _matchers[key]


def score(docs: DataFrame, m: Lexicon) -> DataFrame:
    """docs in full, in a struct row, with score. The lexicon is bounded by the sample that it was learned from."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release(_matchers)
        lexicon = shared.value
        matcher = _matcher(lexicon.words, lexicon.prefixes)
        for texts in batches:
            yield pa.array([score_text(t.as_py(), lexicon, matcher) for t in texts], pa.float64())
        # The worker lives on, for other work: it doesn't keep this task's tokens.
        _matchers.clear()

    return docs.select(F.struct("*").alias("row"), scores(F.col("text")).alias("score"))
