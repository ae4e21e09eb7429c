"""Top-k, toxicity, language ID, SentencePiece, binary records, Jaccard join, pipeline."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from plain import edits, plain_score
from pyspark.sql import functions as F
from support import DATA

from pagelathe.llm import binary_output, common, components, jaccard_join, langid, sentencepieces, shingles, topk, toxicity
from pagelathe.llm.queries import QUERIES

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " \n\t ", "x " * 30_000, "same text", "same text", "é" * 70, "naïve 日本 🙂"]


def odd(spark):
    rows = [(i if i != 2 else None, t, "en", "clash", 1.0, "row") for i, t in enumerate(ODD)] + [(4, "same text", "en", "clash", 1.0, "row")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, score double, row string")


# ------------------------------------------------------------------- top-k


def test_topk_by_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 256]) for i in range(300)]
    rows += [(900, [1e30] * 6), (905, [1e30, 1.0, 0.0, 0.0, 0.0, 0.0]), (906, [1e30, 2.0, 0.0, 0.0, 0.0, 0.0]), (950, [-1e30] * 6), (1000, [3e5, -2e9] + [1.0] * 4)]
    finite = len(rows)
    rows += [(901, None), (902, [float("nan")] * 6), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (904, [1.0, 2.0]), (907, []), (None, [0.1] * 6)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, score string, rank int")
    v = {i: [int(np.floor(256 * float(np.float32(c)))) for c in x] for i, x in rows[:finite]}
    want = []
    for q in (i for i in v if i % 50 == 0):
        products = {c: sum(x * y for x, y in zip(v[q], v[c], strict=True)) for c in v if c != q}
        top = sorted(products, key=lambda c: (-products[c], c))[:5]
        want += [(q, r, c, max(-(2**63), min(2**63 - 1, products[c]))) for r, c in enumerate(top, 1)]
    assert any(x[3] == 2**63 - 1 for x in want) and any(x[3] == -(2**63) for x in want) is False
    for tasks in (1, 5, 40):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, tile_rows=32, query_rows=2, tasks=tasks).collect()))
        assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_lists_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "MERGED", 2)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(200)], "vec_id long, embedding array<double>")
    deep = topk.top_k(df, F.col("vec_id") % 20 == 0, k=3, tile_rows=8, tasks=13)
    assert deep._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") > 6
    monkeypatch.setattr(topk, "MERGED", 10_000)
    flat = topk.top_k(df, F.col("vec_id") % 20 == 0, k=3, tile_rows=8, tasks=2)
    assert sorted(map(tuple, deep.collect())) == sorted(map(tuple, flat.collect()))
    assert topk.grid(100, 50, 1) == (71, 2) and topk.grid(1, 5, 0) == (1, 1)


def test_topk_few_and_repeated(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536)]


# ---------------------------------------------------------------- toxicity


def test_automaton_by_edit_distance():
    rng = random.Random(1)
    terms = ["stupid", "idiot", "abc", "worthless", "loser", "clown"]
    m = toxicity.Matcher(terms, ["qqqq"])
    words = terms + ["".join(rng.sample(t, len(t)))[: rng.randint(1, 9)] for t in terms for _ in range(40)]
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k, c = rng.randrange(len(w) + 1), rng.choice("abcdefgorst")
                w[k : k + rng.randint(0, 1)] = [c] * rng.randint(0, 1)
                w = w or ["a"]
            words.append("".join(w))
    for w in words:
        near = [(edits(w, t), t) for t in terms]
        near = [x for x in near if x[0] <= m.allowed(x[1])]
        got = m[w]
        assert (got is None) == (not near), w
        if near:
            assert got[2] == min(near)[0] and got[0] == ("word" if got[2] == 0 else "fuzzy")
    assert m["qqqqzzz"] == ("prefix", "qqqq", 0) and m["«Stupid!»"][0] == "word"


def test_quotation_scores_lower():
    lex = toxicity.Lexicon({"idiot": 7.0}, {}, -6.0, -2.0, {"word": 0.2, "prefix": 0.2, "fuzzy": 0.2}, {"idiot": 3.0})
    m = toxicity.Matcher(["idiot"], [])
    s = lambda t: toxicity.score_text(t, lex, m)
    assert s("you idiot you") > 0.9 > 0.5 > s('the word "idiot" is old') > s("clean words")
    assert s("you idiiot") > s("clean") and s(None) == s("") < 0.01


def test_toxicity_learns(spark):
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = rng.choices(plain, k=30) + (["grumblefux"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    lex = toxicity.train(docs.filter("doc_id < 300"), labels)
    out = toxicity.score(docs, lex).select("row.doc_id", "score").collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in out if r["doc_id"] >= 300)
    scored = toxicity.score(odd(spark), lex)
    assert scored.count() == 9 and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    empty = toxicity.train(docs.limit(0), labels)
    assert toxicity.score(docs.limit(3), empty).filter("score < 0.5").count() == 3


def test_scores_by_brute_force(spark, monkeypatch):
    """Every score of the query again: each token against every term by edit distance, no trie and no automaton."""
    learned = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: learned.append(train(*a, **k)) or learned[-1])
    folder = DATA.replace("0.001", "0.01")
    got = {r["doc_id"]: r["score"] for r in QUERIES["op3_toxicity"](spark, folder).collect()}
    m = learned[0]
    assert len(m.words) + len(m.prefixes) > 3

    kinds = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        assert abs(got[r["doc_id"]] - plain_score(r["text"], m, kinds)) < 1e-9, r["doc_id"]


def test_reporting_words_are_learned(spark):
    """Hits beside a reporting word come from clean texts, so the word is learned, and hits beside it weigh less."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = rng.choices([f"w{j}" for j in range(300)], k=40)
        toxic, told = i % 3 == 0, i % 30 == 1
        if toxic or told:
            at = rng.randrange(5, 30)
            words[at : at + 2] = ["grumblefux", words[at]] if toxic else ["reportedly", "grumblefux"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    m = toxicity.train(docs, labels, min_odds=1.5)
    assert "reportedly" in m.reporting and len(m.reporting) <= 3 and "grumblefux" in m.words
    matcher = toxicity._matcher(m.words, m.prefixes)
    assert toxicity.score_text("a grumblefux you", m, matcher) > 0.9 > toxicity.score_text("x reportedly grumblefux x", m, matcher)


def test_few_hits_say_little(spark):
    """What stands beside hits counts from the first clean text with a hit on, and the more, the more of them there are."""
    odds = []
    for told in (0, 2, 8, 40):
        rows = [(i, f"a{i} grumblefux b{i % 7}", 1) for i in range(200)] + [(1000 + i, f"c{i} reportedly grumblefux d", 0) for i in range(told)]
        rows += [(5000 + i, f"e{i} f{i % 9}", 0) for i in range(800)]
        df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
        m = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), min_odds=1.0)
        odds.append(m.context.get("reportedly", 0.0))
    assert odds[0] == 0.0 and odds == sorted(odds, reverse=True) and odds[3] < -0.3


def test_all_terms_count():
    lex = toxicity.Lexicon({w: 1.0 for w in ("aaa", "bbb", "ccc", "ddd", "eee")}, {}, -6.0, -2.0, {}, {}, {})
    m = toxicity.Matcher(lex.words, [])
    scores = [toxicity.score_text(" ".join(list(lex.words)[:n]), lex, m) for n in range(1, 6)]
    assert scores == sorted(set(scores))


def test_toxicity_held_out(spark):
    out = QUERIES["op3_toxicity"](spark, DATA.replace("0.001", "0.1")).join(spark.read.parquet(f"{DATA.replace('0.001', '0.1')}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    hit = out[out.toxic == 1].predicted.mean()
    false = out[out.toxic == 0].predicted.mean()
    assert hit > 0.85 and false < 0.02


# ------------------------------------------------------------- language ID


def test_langid_by_plain_sets(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog sat", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")] * 30)], "doc_id long, text string, lang string")
    m = langid.train(docs, min_count=1)
    assert m.languages == ["de", "en", "fr"]
    # The filters say what plain sets of the same n-grams say, but for rare false positives.
    sets = {lang: set() for lang in m.languages}
    for t, lang in {(r["text"], r["lang"]) for r in docs.collect()}:
        for h in langid.grams(langid._codes(t)):
            sets[lang] |= set(h.tolist())
    for lang in m.languages:
        i = m.languages.index(lang)
        g = np.array(sorted(sets[lang]), np.uint64)
        at = [(g * p) >> np.uint64(64 - m.bits) for p in langid.PROBES]
        inside = (m.slices[0][at[0]] & m.slices[0][at[1]]) >> i & 1
        rate = {x: sum(h in sets[x] for h in g.tolist()) for x in sets}
        assert inside.mean() > 0.6 and rate[lang] == len(g)
    for t, lang in (("the dog and cat", "en"), ("die katze und der hund", "de"), ("chat et chien", "fr")):
        assert langid.predict_text(t, m)[0] == lang
    assert langid.predict_text("123 !!", m) == ("und", 0.0) and langid.predict_text(None, m) == ("und", 0.0)
    assert langid.predict_text("日本", m)[0] in m.languages
    out = langid.predict(odd(spark), m)
    assert out.count() == 9 and out.filter("lang_pred = 'und'").count() == 3
    assert langid.predict(docs, langid.train(docs.limit(0))).filter("lang_pred <> 'und'").count() == 0


def test_langid_by_brute_force(spark):
    """The query again with plain sets of n-grams as strings, without hashes and filters."""
    import re
    from collections import Counter

    folder = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in QUERIES["op9_language_id"](spark, folder).collect()}

    def grams(text):
        t = f" {' '.join(re.findall(r'[^\W\d_]+', (text or '').lower()))} "
        return Counter(t[i : i + n] for n in (3, 4) for i in range(len(t) - n + 1)) if t.strip() else Counter()

    counts = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"]:
            counts.setdefault(r["lang"], Counter()).update(grams(r["text"]))
    total = {x: sum(c.values()) for x, c in counts.items()}
    top = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[x])
    own = {x: {g for g, n in c.items() if n >= 3 and n / total[x] >= 0.5 * top[g]} for x, c in counts.items()}
    other = 0
    for r in docs:
        g = grams(r["text"])
        hits = {x: sum(n for y, n in g.items() if y in own[x]) for x in sorted(own)}
        best = max(hits, key=lambda x: (hits[x], -sorted(own).index(x)))
        held_out, lang, score = got[r["doc_id"]]
        assert held_out == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not g:
            assert (lang, score) == ("und", 0.0)
            continue
        close = sum(x > hits[best] - 3 - 0.01 * sum(g.values()) for x in hits.values()) > 1
        assert lang == best or close, r["doc_id"]
        other += lang != best
        assert abs(score - hits[best] / max(1, sum(hits.values()))) < 0.02 + 3 / sum(g.values()) or close
    assert other <= 2


def test_langid_filters_are_built_in_blocks(spark, monkeypatch):
    """Whatever the blocks, and beyond 64 languages, every gram is in its language's filter, and no slot besides."""
    rng = random.Random(4)
    names = [f"l{i:02d}" for i in range(70)]
    texts = {x: " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(30)) for x in names}
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts.items())], "doc_id long, text string, lang string")
    models = []
    for block in (16, 5):
        monkeypatch.setattr(langid, "BLOCK_BITS", block)
        models.append(langid.train(docs, min_count=1, share=0.0, bits=12))
    a, b = models
    assert a.languages == names and [len(s) for s in a.slices] == [1 << a.bits] * 2
    assert all((x == y).all() for x, y in zip(a.slices, b.slices, strict=True)) and (a.false_rate == b.false_rate).all()
    for i, x in enumerate(names):
        g = np.concatenate([h for piece in langid._pieces(texts[x]) for h in langid.grams(langid._codes(piece))])
        full = {int(s) for p in langid.PROBES for s in (g * p) >> np.uint64(64 - a.bits)}
        table = a.slices[i // 64]
        assert set(np.flatnonzero((table >> table.dtype.type(i % 64)) & table.dtype.type(1)).tolist()) == full
        assert abs(a.false_rate[i] - (len(full) / (1 << a.bits)) ** 2) < 1e-12


def test_langid_sample_is_bounded_by_characters(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(concat('wort', translate(id, '0123456789', 'abcdefghij'), ' '), 50) AS text", "'de' AS lang")
    few, all_ = (langid.train(docs, min_count=1, max_chars=n) for n in (20_000, 1 << 24))
    grams = [m.slices[0].astype(bool).sum() for m in (few, all_)]
    assert 0 < grams[0] < grams[1]


def test_langid_chunks_agree(monkeypatch):
    """Texts cut into chunks are judged as whole ones, with blanks to cut at and without any."""
    m = langid.Model(["a", "b"], "a", 20, [np.random.default_rng(1).integers(0, 4, 1 << 20).astype(np.uint8)], np.array([0.1, 0.1]))
    for text in ("the cat and the dog sat on the mat " * 50, "nurbuchstaben" * 400):
        whole = langid.predict_text(text, m)
        monkeypatch.setattr(langid, "CHUNK", 64)
        assert "".join(langid._pieces(text)) == text
        parts = langid.predict_text(text, m)
        monkeypatch.setattr(langid, "CHUNK", 1 << 19)
        assert parts[0] == whole[0] and abs(parts[1] - whole[1]) < 0.05


def test_langid_held_out(spark):
    folder = DATA.replace("0.001", "0.1")
    out = QUERIES["op9_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.filter("lang = lang_pred").count() / out.count() > 0.98


# ----------------------------------------------------------- SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.Pieces(PIECES)


def all_best(p, text, n):
    s, best = sentencepieces.BLANK + text.replace(" ", sentencepieces.BLANK), [[(0, ())]]
    for end in range(1, len(s) + 1):
        found = [(a + p.scores[s[i:end]], q + (p.ids[s[i:end]],)) for i in range(max(0, end - 20), end) if s[i:end] in p.scores for a, q in best[i]]
        if s[end - 1] not in p.scores:
            found += [(a + p.unknown, q + tuple(p.bytes[b] for b in s[end - 1].encode())) for a, q in best[end - 1]]
        best.append(sorted(found, key=lambda x: -x[0])[:n])
    return best[-1]


def test_nbest_by_brute_force(pieces):
    rng = random.Random(1)
    parts = ["the ", "a", "er", ", ", ". ", "ing", "é", "\n", "日本", " ", "x1", "foo.com ", "|", "²."]
    for _ in range(200):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        u = pieces.units(t)
        raw, best = pieces.nbest(u, pieces.places([u])[0], 4)
        ids = np.frombuffer(raw, "<u2").tolist()
        seqs = []
        for _, changes in best:
            y = list(ids)
            for at, drop, put in sorted(changes, reverse=True):
                y[at : at + drop] = put
            seqs.append(tuple(y))
        assert [s for s, _ in best] == [s for s, _ in all_best(pieces, t, 4)]
        assert len(set(seqs)) == len(seqs) and seqs[0] == tuple(ids) and pieces.decode(ids) == t


def unigram_model(pieces):
    """A model file of the given pieces and scores, byte pieces behind them: the format's fields, written out."""

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if isinstance(value, float):
            return varint(number << 3 | 5) + np.float32(value).tobytes()
        return varint(number << 3 | 2) + varint(len(value)) + value

    kinds = [("<unk>", 0.0, 2), *((x, s, 1) for x, s in pieces.items()), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    body = b"".join(field(1, field(1, x.encode()) + field(2, s) + field(3, k)) for x, s, k in kinds)
    return body + field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(4, 0))


@pytest.mark.parametrize("crossing", [False, True])
def test_nbest_like_the_library(tmp_path, crossing):
    """A unigram model, with and without pieces over blanks, line ends and marks: the library's own N-best lists."""
    import sentencepiece

    rng = random.Random(6)
    words = ["▁", "a", "b", "c", "d", "é", ".", "\n", "▁a", "▁ab", "ab", "bc", "abc", "cd", "da", "▁d", "éa", "▁abcd"] + ["a▁b", "d.", ".\n", "▁a▁", "\n▁d"] * crossing
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(unigram_model({w: -rng.randrange(1 << 10, 1 << 14) / 1024 for w in words}))
    p, sp = sentencepieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert (p.unit is sentencepieces.WHOLE) == crossing and p.shift == 10
    for _ in range(150):
        t = "".join(rng.choice([*"abcdéa. \n", "ab", " abcd", "日"]) for _ in range(rng.randint(1, 12)))
        u = p.units(t)
        raw, best = p.nbest(u, p.places([u])[0], 5)
        got = []
        for _, changes in best:
            y = np.frombuffer(raw, "<u2").tolist()
            for at, drop, put in sorted(changes, reverse=True):
                y[at : at + drop] = put
            got.append(y)
        want = sp.nbest_encode(t, nbest_size=5)
        assert len(got) == len(want) and got[0] == sp.encode(t)
        score = lambda ids: round(sum(sp.get_score(i) for i in ids) * 1024)
        if "日" not in t:
            assert [x for x, _ in best] == [score(y) for y in want] == [score(y) for y in got]
        if len({x for x, _ in best}) == len(best):
            assert got[:4] == want[:4]
        assert p.decode(got[0]) == t


def test_encode_and_decode(spark):
    df = odd(spark)
    out = sentencepieces.encode(df, PIECES, n=3)
    assert out.filter("encoded.round_trip").count() == 9
    back = sentencepieces.decode(out.select("row.doc_id", F.col("row.text").alias("want"), "encoded.ids"), PIECES)
    assert all((r["want"] or "") == r["text"] for r in back.select("row.want", "text").collect())
    nulls = out.filter("row.text IS NULL").select("encoded.*").first()
    assert nulls["n_tokens"] == 0 and [x["score"] for x in nulls["nbest"]] == [0]
    assert sentencepieces.encode(df.limit(0), PIECES).count() == 0


def test_cache_may_be_small(pieces):
    small = sentencepieces.Pieces(PIECES, most=3)
    for t in ("one two three four", "five six", "one two"):
        u = small.units(t)
        assert small.nbest(u, small.places([u])[0], 2)[0] == pieces.nbest(u, pieces.places([u])[0], 2)[0]


def test_units_are_cut_together(pieces):
    rng = random.Random(7)
    parts = ["a", "Z", "é", "ɏ", "ɐ", "¿", "×", "1", "[", "日", "😀", "ß.", "\n", " ", "▁", "\t", "\x00", *".,!?;:|", "foo.com,x", "the ing"]
    texts = [None, "", " ", ".", "▁", "\n"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    words, at, ends = pieces.cut(texts)
    assert len(set(words)) == len(words)
    for text, a, b in zip(texts, [0, *ends], ends, strict=False):
        want = pieces.unit.findall(sentencepieces.BLANK + text.replace(" ", sentencepieces.BLANK)) if text else []
        assert words[at[a:b]].tolist() == want == pieces.units(text)
    assert [len(x) for x in pieces.cut([])] == [0, 0, 0]


def test_units_are_looked_up_once(pieces, monkeypatch):
    """A batch's units are looked up and solved by their distinct values, however often they occur."""
    asked, places = [], pieces.places
    monkeypatch.setattr(pieces, "places", lambda texts: asked.extend(u for x in texts for u in x) or places(texts))
    out = sentencepieces._encode_texts(["one two one.", None, "two one", ""] * 50, pieces, 4, True)
    assert sorted(asked) == sorted({*pieces.units("one two one."), *pieces.units("two one")})
    assert out.slice(4, 4).equals(out.slice(0, 4)) and all(out.field("round_trip").to_pylist())


def test_units_that_do_not_come_back(pieces):
    """A text whose ids spell something else is found by decoding, as its units are when they are solved."""
    own = sentencepieces.Pieces(PIECES)
    used = [set(np.frombuffer(own.nbest([u], own.places([[u]])[0], 1)[0], "<u2").tolist()) for u in ("▁two", "▁one")]
    bad = min(used[0] - used[1])
    own.surface[bad], own.surface_size[bad] = b"?!", 2
    own.clear()
    assert sentencepieces._encode_texts(["one two", "one"], own, 2, False).field("round_trip").to_pylist() == [False, True]
    assert own.spells[own.places([["▁two", "▁one"]])[0]].tolist() == [False, True]


# ---------------------------------------------------------- binary records


def test_records_like_the_library(spark):
    from tokenizers import Tokenizer

    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-5, None), (10**6, ""), (10**6 + 1, "Ünï ΑΣ <|endoftext|> ß.. a., İ x"), (None, "first")], "doc_id long, text string"))
    manifest = binary_output.write_records(df, WORDS, 1, parts=5)
    got = binary_output.read_records(spark, manifest).orderBy("start").collect()
    t = Tokenizer.from_file(WORDS)
    start = 0
    for r, d in zip(got, df.orderBy(F.asc_nulls_first("doc_id")).collect(), strict=True):
        ids = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (d["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    # Any record alone, by the index.
    part = manifest.orderBy("part").first()
    own = [r for r in got if r["start"] >= part["start"]][: part["docs"]]
    for k in (0, part["docs"] // 2, part["docs"] - 1):
        doc_id, ids = binary_output.read_one(part["file"], part["dtype"], k)
        assert (doc_id, ids.tolist()) == (own[k]["doc_id"], own[k]["ids"])


def test_ids_are_the_librarys():
    """20,000 strings of letters, stops, marks, blanks, case that changes lengths, special tokens: no id differs."""
    e = binary_output.WordEncoder(WORDS)
    rng = random.Random(4)
    pool = [*"abcXYZ.,'\"!? \n\t03ÉßİıΣσςǅŉẞµ<|>", "'s", "'LL", "<|endoftext|>", "\u0307", "\u0301", "e\u0301", "\u3000", "\u2028", "\xa0", "\x1c", "日", "🙂", "ﬁ", "\u212b", "\u0345", ". ", ", ", "the ", "\r\n", "\u200b", "\xad", "٣", "Ⅷ", "²", "가"]
    for _ in range(20_000):
        x = "".join(rng.choice(pool) if rng.random() < 0.95 else chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(1, 14)))
        assert np.frombuffer(e.encode(x), e.dtype).tolist() == e.tokenizer.encode(x, add_special_tokens=False).ids, ascii(x)


def test_records_lie_where_spark_looks(spark, tmp_path):
    """A folder without a scheme is on the default file system: here one that pyarrow can't reach, so nothing may appear on the local disk."""
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    plain = str(tmp_path / "a b")
    manifest = binary_output.write_records(docs, WORDS, 1, plain)
    assert all(r["file"].startswith("file:/") for r in manifest.collect()) and binary_output.read_records(spark, manifest).count() == 2
    file = manifest.first()
    assert binary_output.read_one(file["file"], file["dtype"], 0)[0] in (1, 2)
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "viewfs://elsewhere/")
        conf.set("fs.viewfs.mounttable.elsewhere.link./records", f"file://{tmp_path}")
        with pytest.raises(Exception):  # noqa: B017
            binary_output.write_records(docs, WORDS, 1, f"/records/{tmp_path.name}").count()
    finally:
        conf.set("fs.defaultFS", old or "file:///")
    assert not (tmp_path / tmp_path.name).exists() and not __import__("os").path.exists(f"/records/{tmp_path.name}")


def test_damage_is_found():
    import io

    whole = binary_output.frame(b"abcd")
    assert binary_output.read_frame(io.BytesIO(whole)) == b"abcd"
    for i in range(len(whole)):
        bad = bytearray(whole)
        bad[i] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            binary_output.read_frame(io.BytesIO(bytes(bad)))


def test_small_word_cache_and_empty_table(spark):
    e = binary_output.WordEncoder(WORDS, most=4)
    full = binary_output.WordEncoder(WORDS)
    text = "one two, three. four five one two six."
    assert e.encode(text) == full.encode(text) and len(e) <= 5 and e.direct
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert binary_output.read_records(spark, binary_output.write_records(empty, WORDS, 1)).count() == 0


# ------------------------------------------------------------ Jaccard join


def plain_sets(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [(i, plain_sets(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


def near_copies(rng, n_base, copies, length, edit):
    out = []
    for b in range(n_base):
        base = [f"b{b}w{rng.randrange(length)}" for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edit)):
                w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("small", "far"), [(2, False), (24, False), (2, True), (24, True)])
def test_join_by_brute_force(spark, monkeypatch, small, far):
    """far: no table is small enough to be broadcast, regions are compared in blocks of a few, and every key is cold."""
    if far:
        for name, value in (("SHIPPED", -1), ("SHIPPED_PAIRS", -1), ("BLOCKED", 7), ("PIVOTS", (3,))):
            monkeypatch.setattr(jaccard_join, name, value)
        monkeypatch.setattr(common, "SMALL", -1)
        monkeypatch.setattr(common, "HOT", 1)
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 3, 30, 90, 5) + near_copies(rng, 12, 4, 60, 3) + [f"{passage} " + " ".join(f"u{i}v{j}" for j in range(30)) for i in range(40)]
    texts += ["one two three", "ONE  two\nthree", "one", "a b c d e", "a b c d e f", "", " \t", "ÉA b c d e", "éa b c d e"] + [passage] * 3
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, jaccard_join.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), small=small).collect()))
    assert got == brute(rows)


def test_shingles_of_long_and_odd_texts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(3000))
    (whole,) = shingles.shingle_sets([text])
    monkeypatch.setattr(shingles, "PIECE", 100)
    (pieces,) = shingles.shingle_sets([text])
    assert np.array_equal(whole, pieces) and len(whole) == len(plain_sets(text))
    assert [len(s) for s in shingles.shingle_sets([None, "", "a", "a b c d e f"])] == [0, 0, 1, 2]
    a, b = shingles.shingle_sets(["ab c", "a bc"])
    assert not np.array_equal(a, b)


def test_sketches_bound_intersections():
    rng = np.random.default_rng(1)
    for n, m, k in ((50, 60, 40), (700, 5000, 300), (5, 2000, 5), (1, 1, 1)):
        both = rng.integers(0, 2**63, n + m, dtype=np.int64).astype(np.uint64)
        x, y = np.unique(both[:n]), np.unique(np.r_[both[:k], both[n:]])
        assert jaccard_join.most_shared(jaccard_join.sketch(x), jaccard_join.sketch(y))[2] >= len(np.intersect1d(x, y))
        bits = [np.array(jaccard_join.bits(v)).view(np.uint8) for v in (x, y)]
        assert int(np.unpackbits(bits[0] ^ bits[1]).sum()) <= len(np.setxor1d(x, y))


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for e in links for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(8 * cores))
        rows = spark.range(1000).repartition(8 * cores, "id")
        assert common.few_files(rows, 1000).rdd.getNumPartitions() == 2 * cores
        assert common.few_files(rows, 3 * cores * common.FILE_ROWS).rdd.getNumPartitions() == 3 * cores
        assert common.few_files(rows, 10**9).rdd.getNumPartitions() == 8 * cores
        assert sorted(r.id for r in common.cut(rows, "few", 1000).collect()) == list(range(1000))
        # A path of links takes rounds, so its tables are written as few files.
        got = dict(map(tuple, components.components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")).collect()))
        assert got == dict.fromkeys(range(41), 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_links_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for i in range(120):
        w = list(base[i % 6])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"x{rng.randrange(900)}"
        texts.append(" ".join(w))
    rows = list(enumerate([*texts, texts[0], texts[0], "own words that nobody else has", "", None]))
    sets = [set(s.tolist()) for s in jaccard_join.shingle_sets([t for _, t in rows], 5)]
    near = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = {i: sum(near(sets[i], sets[j]) for j, _ in rows if j != i) for i, _ in rows}
    assert len(set(want.values())) > 5
    for block in (128, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        got = jaccard_join.count_links(spark.createDataFrame(rows, "doc_id long, text string"))
        assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want
    assert "n_links" in QUERIES["op7_jaccard_join"](spark, DATA).columns


def test_keep_one_and_odd_rows(spark):
    df = odd(spark)
    out = jaccard_join.join_documents(df)
    assert out.count() == 9 and out.filter("n_shingles = 0").count() == 3
    assert {r["component_id"] for r in out.filter("doc_id IN (4, 5)").collect()} == {4}
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and kept.filter("text = 'same text'").count() == 1 and kept.count() == 9 - 2
    assert jaccard_join.join_documents(df.limit(0)).count() == 0 and jaccard_join.keep_one(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    assert [n for n, _ in c.STAGES] == ["toxicity", "quality_rules", "jaccard_join", "mixing", "sentencepiece"]
    folder = DATA.replace("0.001", "0.01")
    out = c.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert set(docs.columns) <= set(out.columns) and 0 < out.count() < docs.count()
    # What the stages promise holds of the result.
    ids = out.select("doc_id").distinct()
    kept = docs.join(ids, "doc_id")
    assert jaccard_join.join_documents(kept).filter("doc_id <> component_id").count() == 0
    words = QUERIES["op4_quality_rules"](spark, folder).filter("base_failed").select("doc_id")
    assert ids.join(words, "doc_id").count() == 0
    assert all(r["n_tokens"] == len(r["ids"]) for r in out.select("n_tokens", "ids").collect())


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as c

    df = odd(spark).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))
    for name, stage in c.STAGES:
        for docs in (df, df.limit(0)):
            got = stage(spark, docs, DATA)
            assert got.count() <= 2 * df.count(), name
            if name != "sentencepiece":
                assert got.columns == df.columns
