"""The pipeline, stage by stage: what each keeps of its own input, again in plain Python (the mixture in SQL)."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from plain import plain_score
from pyspark.sql import functions as F
from support import DATA

from pagelathe.llm import sentencepieces, toxicity
from pagelathe.llm.queries import LINES, OP1_SQL

FOLDER = DATA.replace("0.001", "0.01")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Name of each stage to its rows before and after, and the lexicon that the first one learned."""
    root, learned, train = tmp_path_factory.mktemp("steps"), [], toxicity.train
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # Lines on many pages, some with other digits and blanks; texts that are little else; near copies with a word changed.
    line = F.concat(F.lit("Subscribe  to our list of "), (F.col("doc_id") % 10).cast("string"), F.lit(" letters a week\n"))
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(line, "text")).when(F.col("doc_id") % 70 == 1, F.concat(F.repeat(line, 7), F.lit("and six words of its own")))
    docs = docs.withColumn("text", F.coalesce(text, "text"))
    near = docs.filter("doc_id % 40 = 3").withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("text", F.concat(F.col("text"), F.lit(" tail")))
    docs.unionByName(near).write.parquet(f"{root}/documents")
    docs, out = spark.read.parquet(f"{root}/documents"), {}
    toxicity.train = lambda *a, **k: learned.append(train(*a, **k)) or learned[-1]
    try:
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            stage(spark, docs, FOLDER).write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
            out[name] = before.collect(), docs.collect(), docs.columns
    finally:
        toxicity.train = train
    return out, learned[0], root


def rows(found):
    return Counter((r["doc_id"], r["text"]) for r in found)


def test_toxic_documents_go(steps):
    before, after, _ = steps[0]["toxicity"]
    kinds = {}
    want = [r for r in before if plain_score(r["text"], steps[1], kinds) < 0.5]
    assert len(want) < len(before) and rows(after) == rows(want)


def test_poor_documents_and_common_lines_go(steps):
    before, after, columns = steps[0]["quality_rules"]
    blank = re.compile(r"[\x20\x09-\x0D]+")

    def normal(line):
        return re.sub("[0-9]", "0", blank.sub(" ", line).strip(" ")).lower()

    held, hosts = Counter(), Counter(r["source"] for r in before)
    for r in before:
        held.update((r["source"], x) for x in {normal(x) for x in (r["text"] or "").split("\n") if WORD.search(x)})
    common = {(h, x) for (h, x), n in held.items() if (n > LINES["line_min_docs"] and n * 100 > hosts[h] * LINES["line_max_pct"]) or n > LINES["line_max_docs"]}
    want, depleted = Counter(), 0
    for r in before:
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for i in range(len(words) - 7):
            windows[tuple(words[i : i + 8])].append(i)
        repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
        if len(words) < 20 or 100 * len(repeated) > 30 * len(words):
            continue
        lines = text.split("\n")
        gone = [bool(WORD.search(x)) and (r["source"], normal(x)) in common for x in lines]
        left = len(words) - sum(len(WORD.findall(x)) for x, g in zip(lines, gone, strict=True) if g)
        if left < 20 or 100 * left < 30 * len(words):
            depleted += 1
            continue
        clean = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if any(gone) else r["text"]
        want[(r["doc_id"], clean)] += 1
    assert common and depleted and rows(after) == want
    assert "n_chars" not in columns or all(r["n_chars"] == len(r["text"]) for r in after if (r["doc_id"], r["text"]) not in rows(before))


def test_one_of_each_group_stays(steps):
    before, after, _ = steps[0]["jaccard_join"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, holders = {}, defaultdict(list)
    for r in before:
        w = WORD.findall((r["text"] or "").translate(lower))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
        for s in sets[r["doc_id"]]:
            holders[s].append(r["doc_id"])
    assert len(sets) == len(before)
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, own in sets.items():
        for y, n in Counter(y for s in own for y in holders[s] if y > x).items():
            if 100 * n >= 80 * (len(own) + len(sets[y]) - n):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    want = [r for r in before if find(r["doc_id"]) == r["doc_id"]]
    assert len(want) < len(before) and rows(after) == rows(want)


def test_mixture_is_that_of_the_sql(steps):
    before, after, _ = steps[0]["mixing"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{steps[2]}/jaccard_join/*.parquet')")
    copies = {i: e + (p > 0) for i, e, p in con.sql(f"SELECT doc_id, whole_epochs, part_tokens FROM ({OP1_SQL})").fetchall()}
    want = Counter({(r["doc_id"], r["text"]): copies[r["doc_id"]] for r in before})
    assert set(copies.values()) >= {0, 1} and rows(after) == +want


def test_segmentations_are_the_best(steps):
    before, after, columns = steps[0]["sentencepiece"]
    assert rows(before) == rows(after) and {"ids", "n_tokens", "nbest"} < set(columns)
    p = sentencepieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    longest = max(map(len, p.scores))
    scores = {i: s for x, i in p.ids.items() for s in [p.scores[x]]}
    for r in {r["doc_id"]: r for r in after}.values():
        s = sentencepieces.BLANK + (r["text"] or "").replace(" ", sentencepieces.BLANK) if r["text"] else ""
        best = [0]
        for end in range(1, len(s) + 1):
            found = [best[i] + p.scores[s[i:end]] for i in range(max(0, end - longest), end) if s[i:end] in p.scores]
            best.append(max(found) if s[end - 1] in p.scores else max([best[-1] + p.unknown, *found]))
        assert r["n_tokens"] == len(r["ids"]) and p.decode(r["ids"]) == (r["text"] or "")
        assert abs(r["nbest"][0]["score"] * (1 << p.shift) - best[-1]) < 0.5
        # An unknown character's bytes stand for one unknown piece.
        if all(i in scores for i in r["ids"]):
            assert sum(scores[i] for i in r["ids"]) == best[-1]
