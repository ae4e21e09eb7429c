"""Vector codes, substring dedup, the conversation trie: against brute force, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from support import DATA

from pagelathe.llm import common, substring_dedup, turn_trie, vector_codes

# ---------------------------------------------------------------- vector codes


def plain_codes(rows, parts, entries, rounds, scale=1024.0):
    """rows: vec_id, vector, label. Everything in Python's integers."""
    kept = [(i, [int(np.floor(scale * c)) for c in v], label) for i, v, label in rows]
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    seeds = [cut(v) for _, v, _ in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[1]))[:entries]]
    books = [[s[p] for s in seeds] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    best = lambda x, book: min((far(x, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        took = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                took.setdefault((p, best(x, books[p])[1]), []).append(x)
        for (p, i), xs in took.items():
            books[p][i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for i, v, label in kept:
        found = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    total = {}
    for *_, error, label in out:
        total[label] = total.get(label, 0) + error
    return sorted((str(i), code, error, total[label], hashlib.sha256(text.encode()).hexdigest()) for i, code, error, label in out)


VECTOR = "vec_id long, embedding array<float>, label int, code string, told long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], VECTOR).repartition(3)


@pytest.mark.parametrize("hot", [1000, 2])
def test_codes_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = np.random.default_rng(3)
    # Few distinct values, so that distances tie; repeated ids and rows; one label holds most.
    rows = [(int(rng.integers(0, 90)), [float(x) for x in rng.integers(-2, 3, 8) / 1024], None if k % 3 else int(rng.integers(0, 3))) for k in range(200)]
    rows += rows[:5] + [(None, [0.5] * 8, 1)]
    odd = [(901, None, 1), (902, [float("nan")] * 8, 1), (903, [1.0, None] * 4, 1), (904, [float("inf")] * 8, 1), (905, [], 1), (906, [1.0] * 4, 1), (907, [1.0] * 7, 1)]
    got = vector_codes.encode(frame(spark, rows + odd), parts=4, entries=16, rounds=3)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_codes(rows, 4, 16, 3)


def test_few_vectors_and_none(spark):
    rows = [(7, [0.1, -0.2, 0.3, 0.4], 1), (3, [0.0, 0.0, 0.0, -0.001], 1)]
    got = vector_codes.encode(frame(spark, rows))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_codes(rows, 4, 256, 4)
    assert vector_codes.encode(frame(spark, rows).limit(0)).collect() == []
    assert vector_codes.encode(frame(spark, [(1, None, 1)])).columns == got.columns
    with pytest.raises(Exception, match="distances would leave the longs"):
        vector_codes.encode(frame(spark, [(1, [1e30] * 4, 1)])).collect()


@pytest.mark.parametrize("size", [3, 700, 20_000_000])
def test_screening_is_exact(size):
    """Entries a unit apart at every size: float32 alone can't tell them."""
    rng = np.random.default_rng(size)
    book = rng.integers(-size, size + 1, (256, 16))
    book[100:200] = book[:100] + rng.integers(-1, 2, (100, 16))
    book[200:210] = book[90:100]
    x = np.concatenate([book[rng.integers(0, 256, 300)] + rng.integers(-1, 2, (300, 16)), rng.integers(-size, size + 1, (300, 16))])
    chosen, far, again = vector_codes.nearest(x, book)
    d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (far == d.min(axis=1)).all() and (chosen == d.argmin(axis=1)).all()
    assert again < x.shape[0] * 256 / 4
    assert size < 20_000_000 or ((x.astype("f4")[:, None] - book.astype("f4")[None]) ** 2).sum(axis=2).argmin(axis=1).tolist() != chosen.tolist()


# ------------------------------------------------------------- substring dedup


def plain_removal(rows, width):
    """rows: doc_id, text, in the order of documents; what is left of each."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone |= set(range(i, i + width))
            seen.add(window)
        kept = [w.decode() for i, w in enumerate(words) if i not in gone]
        out.append((str(doc_id), len(words), len(gone), " ".join(kept)))
    return sorted(out)


def removal(docs, **how):
    rows = substring_dedup.remove_repeats(docs, **how).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows)


@pytest.mark.parametrize(("hot", "chunk", "piece"), [(4096, 1 << 20, 1 << 20), (2, 1 << 20, 300), (1, 7, 40)])
@pytest.mark.parametrize("gram", [1, 2, 4])
def test_removal_by_brute_force(spark, monkeypatch, hot, chunk, piece, gram):
    """Small alphabets, so that windows, anchors and edges repeat in every way."""
    rng = random.Random(100 * hot + gram)
    passage = [[rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passage) if rng.random() < 0.5 else [rng.choice("abcXYZ") for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", "\n", "\t \r"]).join(words)))
    rows += [(200, None), (201, ""), (202, "b " * 50), (203, "é b c " * 4), (None, rows[5][1]), (204, "a b c d e f\x0bg\x0ch a b c d e f g")]
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    rng.shuffle(rows)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, did string, start int").repartition(5)
    assert removal(docs, width=4, gram=gram, hot=hot) == plain_removal(order, 4)


def test_small_arrow_batches_agree(spark, monkeypatch):
    """Anchors, copies and crowded anchors that go on from batch to batch."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 12))) + " c d e f g") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(substring_dedup, "bound_batches", lambda s: common.batches(s, rows=3))
    try:
        for hot in (1, 5, 4096):
            assert removal(docs, width=4, gram=2, hot=hot) == plain_removal(rows, 4)
    finally:
        common.batches(spark)


def test_equal_rows_are_copies(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text), (2, "short one"), (2, "short one"), (0, None), (0, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = removal(docs)
    assert got == sorted([("1", 40, 0, text), ("1", 40, 40, ""), ("1", 40, 40, ""), ("2", 2, 0, "short one"), ("2", 2, 0, "short one"), ("0", 0, 0, ""), ("0", 0, 0, ""), ("None", 0, 0, "")])
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0
    two = spark.createDataFrame([(1, text), (1, text + " more")], "doc_id long, text string")
    assert sorted(r[1:3] for r in removal(two)) in ([(40, 0), (41, 40)], [(40, 40), (41, 0)])


def test_long_factors_by_boundary_checks():
    block = substring_dedup.Block(3)
    assert block.parse(b"a b c d e f") == []
    assert block.parse(b"x b c d e y") == [(1, 4)]
    assert block.parse(b"d e y x b") == [(0, 3)]
    assert block.parse(b"b c d e y x b c") == [(0, 4), (2, 3), (3, 4), (5, 3)]
    assert block.parse(b"a b c d e f") == [(0, 6)]


def test_texts_are_shuffled_once(spark):
    out = substring_dedup.remove_repeats(spark.read.parquet(f"{DATA}/documents.parquet"))
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


# --------------------------------------------------- conversation prefix trie


def plain_rebuilt(rows):
    own = {}
    for conv_id, turn, role, text in rows:
        own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items() if c is not None}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}


def plain_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.append((min(own), len(node), str(up), len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes_of(df):
    return sorted((r["conv_id"], r["depth"], str(r["parent_conv_id"]), r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


TURN = "conv_id long, turn long, role string, text string, path string, low int"


@pytest.mark.parametrize(("ranges", "at_once", "held", "hot"), [(1, 32, None, 1000), (9, 2, 1, 1000), (40, 3, 1, 2)])
def test_trie_by_brute_force(spark, monkeypatch, ranges, at_once, held, hot):
    rng = random.Random(ranges)
    rows = []
    for c in [*range(60), *range(100, 160), 207, 333]:
        turns = [(rng.choice(["user", "assistant", None]), rng.choice(["", "a", "é🙂", None])) for _ in range(rng.randint(1, 6))]
        rows += [(c, k if k or c % 2 else None, *t) for k, t in enumerate(turns)]
    rows += [(4, 50, "user", "late"), (None, 0, "user", "nobody's")] + [(61, k, "user", f"{k}") for k in range(40)] + [(62, k, "user", f"{k}") for k in range(30)]
    rng.shuffle(rows)
    monkeypatch.setattr(turn_trie, "MERGED", at_once)
    monkeypatch.setattr(common, "HOT", hot)
    monkeypatch.setattr(turn_trie, "merged", lambda parts, f=turn_trie.merged: f(([x] for p in parts for x in p), held))
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], TURN).repartition(4)
    assert nodes_of(turn_trie.build(turn_trie.share_heads(turn_trie.turns_of(df)), ranges)) == plain_nodes(plain_rebuilt(rows))


def test_turnless_and_empty(spark):
    few = [(c, 0, "user", "hi") for c in range(1, 40)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in few], TURN)
    got = nodes_of(turn_trie.build(turn_trie.share_heads(turn_trie.turns_of(df)), 3))
    assert got == plain_nodes(plain_rebuilt(few)) and len(got) == 2
    assert turn_trie.build(turn_trie.share_heads(turn_trie.turns_of(df.limit(0)))).count() == 0
    ties = spark.createDataFrame([(1, 0, "user", t, "", 1) for t in "abab"], TURN)
    assert turn_trie.turns_of(ties).count() == 1


@pytest.mark.parametrize("held", [None, 1, 5000])
def test_mergesort(held):
    rng = random.Random(5)
    turn = lambda: bytes([rng.randint(0, 2)]) * turn_trie.TURN
    paths = [b"".join(turn() for _ in range(rng.randint(0, 12))) for _ in range(700)]
    parts = [[(p, [(k,)]) for k, p in enumerate(paths)][i::13] for i in range(13)]
    out = list(turn_trie.merged([list(p) for p in parts], held))
    assert [p for _, p, _ in out] == sorted(paths) and sorted(s[0][0] for *_, s in out) == list(range(700))
    assert all(lcp == turn_trie.shared(a, b) for (_, a, _), (lcp, b, _) in zip(out, out[1:]))


def test_shared_turns_are_not_compared_again():
    """Paths of 500 shared turns: comparing from the start would look at 500 turns a comparison."""
    head = b"h" * 500 * turn_trie.TURN
    paths = [head + i.to_bytes(turn_trie.TURN, "big") for i in range(64)]
    merge = turn_trie.Merge([turn_trie.sorted_run([(p, []) for p in paths[i::8]]) for i in range(8)])
    assert [p for _, p, _ in merge] == paths
    assert merge.compared < 7 * 501 + 64 * 3 * 2
