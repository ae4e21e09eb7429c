"""Hashing, storing and freezing files; searching quotes."""

import hashlib
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import text
from pagelathe.operators import knowledge, manifest, search
from pagelathe.sources import storage

sha = lambda x: hashlib.sha256(x).hexdigest()


@pytest.fixture
def files(tmp_path):
    (tmp_path / "in").mkdir()
    content = {f"a {i}%é.bin": bytes([i]) * (i * 700_001) for i in range(4)}
    for name, x in content.items():
        (tmp_path / "in" / name).write_bytes(x)
    return tmp_path, content


def test_files_are_hashed_as_streams(spark, files, monkeypatch):
    root, content = files
    listed = storage.list_files(spark, str(root / "in"))
    got = {r["path"].rpartition("/")[2]: r for r in storage.hash_files(listed.withColumn("odd", F.lit(1))).collect()}
    assert {n: r["sha256"] for n, r in got.items()} == {n: sha(x) for n, x in content.items()} and all(r["size_bytes"] == len(content[n]) for n, r in got.items())
    gone = spark.createDataFrame([(storage.qualified(spark, str(root / "none")), 1)], "path string, size_bytes long")
    assert storage.hash_files(gone).select("sha256", F.col("error").isNotNull()).first()[:] == (None, True)
    assert storage.hash_files(gone.limit(0)).count() == 0


def test_large_files_take_little_memory(tmp_path, spark):
    """3 GB, beyond what binaryFile reads, hashed by a job, and here with a look at the memory that it takes."""
    import resource

    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
    files = storage.list_files(spark, str(big))
    (row,) = storage.hash_files(files).collect()
    most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert storage._hash(*storage.opened(row["path"])) == (row["sha256"], 3 << 30)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - most < 200 << 10
    h = hashlib.sha256()
    for _ in range(3 << 10):
        h.update(bytes(1 << 20))
    assert row["sha256"] == h.hexdigest()


def test_paths_are_those_of_spark(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    try:
        conf.set("fs.defaultFS", "hdfs://elsewhere:8020")
        with pytest.raises(Exception, match="elsewhere|Unknown"):
            storage.qualified(spark, "/x/y") and spark.read.parquet("/x/y")
    finally:
        conf.set("fs.defaultFS", old or "file:///")
    assert storage.qualified(spark, "/x/y z") == "file:/x/y z"
    assert storage.opened("file:/x/y %20é?#z")[1] == storage.opened("file:///x/y %20é?#z")[1] == "/x/y %20é?#z"
    assert storage.SCHEMES["s3a"] == "s3"


ENTRY = "path string, sha256 string, content binary"


def entries(spark, *rows):
    return spark.createDataFrame([(p, sha(x) if h is None else h, x) for p, x, h in rows], ENTRY)


def test_freeze_is_whole_or_nothing(spark, tmp_path):
    root = str(tmp_path / "frozen")
    good = entries(spark, ("a/1.txt", b"one", None), ("a/2 é.txt", b"", None))
    facts = spark.createDataFrame([("r", 2)], "run string, pages int")
    storage.freeze(facts, good, root, "s1")
    told, held = storage.frozen(spark, root, "s1")
    assert told.collect() == facts.collect() and {r["path"]: r["size_bytes"] for r in held.collect()} == {"a/1.txt": 3, "a/2 é.txt": 0}
    assert {tuple(r) for r in storage.verify_frozen(spark, root, "s1").collect()} == {("a/1.txt", "ok"), ("a/2 é.txt", "ok")}
    attempts = lambda: sorted(os.listdir(f"{root}/_attempts"))
    one = attempts()
    # Repeated, damaged, unsafe, twice the same, not to be read: nothing is left, and nothing replaced.
    with pytest.raises(FileExistsError):
        storage.freeze(facts, entries(spark, ("b", b"other", None)), root, "s1")
    bad = spark.createDataFrame([("c", sha(b""), str(tmp_path / "none"))], "path string, sha256 string, source string")
    for wrong in (entries(spark, ("b", b"x", None), ("c", b"y", sha(b"z"))), entries(spark, ("../b", b"x", None)), entries(spark, ("b", b"x", None), ("b", b"x", None)), bad):
        with pytest.raises(storage.Damaged):
            storage.freeze(facts, wrong, root, "s2")
        assert attempts() == one and not storage.exists(spark, f"{root}/s2.json")
    with pytest.raises(FileNotFoundError):
        storage.frozen(spark, root, "s2")
    for name in ("", "a/b", "..", ".x"):
        with pytest.raises(ValueError):
            storage.freeze(facts, good, root, name)
    # An attempt that was lost on the way is no snapshot, and goes when it is old.
    os.makedirs(f"{root}/_attempts/lost/files")
    assert storage.clean_attempts(spark, root) == [] and storage.clean_attempts(spark, root, older=-10) == ["lost"] and attempts() == one
    assert storage.clean_attempts(spark, str(tmp_path / "no")) == []
    # What lies there is hashed again.
    spot = f"{root}/_attempts/{one[0]}/files/a"
    open(f"{spot}/1.txt", "w").write("two")
    os.remove(f"{spot}/2 é.txt")
    assert {tuple(r) for r in storage.verify_frozen(spark, root, "s1").collect()} == {("a/1.txt", "mismatch"), ("a/2 é.txt", "missing")}


def test_of_two_freezes_one_wins(spark, tmp_path, monkeypatch):
    """Both find no snapshot by the name; only one file can be created."""
    root, won, lost = str(tmp_path / "frozen"), [], []
    gate, publish = threading.Barrier(2), storage.publish
    monkeypatch.setattr(storage, "publish", lambda *a: (gate.wait(60), publish(*a)))

    def run(n):
        try:
            storage.freeze(spark.createDataFrame([(n,)], "n int"), entries(spark, ("a", b"%d" % n, None)), root, "s")
            won.append(n)
        except FileExistsError:
            lost.append(n)

    both = [threading.Thread(target=run, args=(n,)) for n in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert len(won) == len(lost) == 1 and storage.frozen(spark, root, "s")[0].first()["n"] == won[0]
    assert len(os.listdir(f"{root}/_attempts")) == 1


def test_equal_contents_are_one_file(spark, tmp_path, files):
    root = str(tmp_path / "store")
    rows = [("p1", b"image"), ("p2", b"image"), ("p2", b"image"), ("p3", b"x"), ("p3", b"y"), ("p4", b"new"), ("p5", b"old")]
    df = spark.createDataFrame(rows, "path string, content binary").repartition(5)
    index = spark.createDataFrame([("p4", sha(b"was")), ("p5", sha(b"old"))], "path string, sha256 string")
    got = {r["path"]: (r["state"], r["sha256"]) for r in storage.put_objects(df, index, root).collect()}
    assert {p: s for p, (s, _) in got.items()} == {"p1": "new", "p2": "new", "p3": "conflict", "p4": "conflict", "p5": "known"} and got["p1"][1] == sha(b"image")
    held = [os.path.join(d, f) for d, _, names in os.walk(root) for f in names]
    assert sorted(os.path.basename(f) for f in held) == sorted({sha(x) for _, x in rows})
    assert all(sha(open(f, "rb").read()) == os.path.basename(f) for f in held)
    base, content = files
    from_disk = storage.list_files(spark, str(base / "in")).select("path", F.col("path").alias("source"), "size_bytes")
    assert {(r["state"], r["sha256"]) for r in storage.put_objects(from_disk, None, root).collect()} == {("new", sha(x)) for x in content.values()}
    lost = spark.createDataFrame([("q", str(base / "none"))], "path string, source string")
    assert [r["state"] for r in storage.put_objects(lost, None, root).collect()] == ["error"]


def test_files_below_a_root(spark, files):
    root, content = files
    (root / "in" / "sub").mkdir()
    (root / "in" / "sub" / "p.md").write_bytes(b"x")
    got = {r["path"]: (r["sha256"], r["size_bytes"], r["error"]) for r in manifest.list_files(spark, str(root / "in")).collect()}
    assert got == {n: (sha(x), len(x), None) for n, x in (content | {"sub/p.md": b"x"}).items()}
    state = manifest.verify(manifest.list_files(spark, str(root / "in")).select("path", "sha256"), spark.createDataFrame([("sub/p.md", "0" * 64)], "path string, sha256 string"))
    assert {r["path"]: r["state"] for r in state.collect()} == dict.fromkeys(content, "missing") | {"sub/p.md": "mismatch"}


def test_registered_keys_are_not_moved(spark):
    name = "held_in_buckets"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"DROP TABLE IF EXISTS {name}_plain")
    try:
        for part in (range(0, 50), range(50, 100)):
            manifest.store_bucketed(spark.createDataFrame([(sha(b"%d" % i), i) for i in part], "content_hash string, n int"), name, "content_hash", 2)
        spark.sql(f"CREATE TABLE {name}_plain USING parquet AS SELECT * FROM {name}")
        new = spark.createDataFrame([(sha(b"%d" % i), i) for i in [*range(90, 110), 105, 106]] + [(None, 1)], "content_hash string, n int")
        out = manifest.register_bucketed(spark, name, new, "content_hash")
        assert sorted(r["n"] for r in out.collect()) == list(range(100, 110))
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        # One exchange, that of the new rows; the table's scan has none above it.
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1
        assert "Exchange" not in plan[plan.index("Scan ExistingRDD") :]
        with pytest.raises(ValueError):
            manifest.register_bucketed(spark, f"{name}_plain", new, "content_hash")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"DROP TABLE IF EXISTS {name}_plain")


# ------------------------------------------------------------------- searching


@pytest.mark.parametrize(("quote_chars", "text_chars"), [(search.QUOTES, search.TEXTS), (5, 40)])
def test_first_holders_by_brute_force(spark, quote_chars, text_chars):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé🙂") for _ in range(rng.randint(0, n)))
    pages = [(rng.choice(["d", "e", None]), rng.randint(1, 40), rng.choice([None, word(60), word(60)])) for _ in range(150)]
    quotes = [(rng.choice(["d", "e", "f", None]), k, rng.choice([None, "", word(5), word(5)])) for k in range(200)]
    t = spark.createDataFrame(pages, "document_id string, page_no int, markdown string")
    q = spark.createDataFrame(quotes, "document_id string, quote_id int, quote string")
    want = {k: min((p for d2, p, x in pages if d2 == d and x and quote and quote in x), default=None) if d else None for d, k, quote in quotes}
    found = search.first_holders(q, t, ["document_id"], "markdown", "page_no", quote_chars, text_chars)
    got = q.join(found, ["document_id", "quote"], "left")
    assert {r["quote_id"]: r["hit"] for r in got.collect()} == want
    assert {r["quote_id"]: r["hit"] for r in knowledge.first_match(q, t, ["document_id"], "markdown", "page_no").collect()} == want
    assert search.first_holders(q.limit(0), t, ["document_id"], "markdown", "page_no").count() == 0


def test_many_quotes_of_a_long_document_stay_few_rows(spark):
    """10,000 pages and 10,000 quotes of one document: a join would make 100 million pairs."""
    pages = spark.range(10_000).selectExpr("'d' AS document_id", "id AS page_no", "concat('page <', id, '> holds <', id % 100, '> and <', id * 7 % 10000, '>') AS markdown")
    quotes = spark.range(10_000).selectExpr("'d' AS document_id", "id AS quote_id", "concat('<', id, '>') AS quote")
    out = knowledge.first_match(quotes, pages, ["document_id"], "markdown", "page_no")
    rows = out.collect()
    back = {i * 7 % 10_000: i for i in reversed(range(10_000))}
    assert {r["quote_id"]: r["hit"] for r in rows} == {i: min(i, back[i]) if i >= 100 else 0 if i == 0 else min(i, back[i]) for i in range(10_000)}
    plan = out._jdf.queryExecution().executedPlan()
    made = []

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            made.append(metric.get().value())
        for name in ("finalPhysicalPlan", "plan"):
            if hasattr(node, name) and node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
                try:
                    walk(getattr(node, name)())
                    return
                except Exception:
                    pass
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    assert len(made) > 3 and max(made) <= 40_000


# ----------------------------------------------------------------- page splitting


@pytest.mark.parametrize(("markdown", "want"), [
    ("a\n　\nb", [("paragraph", "a"), ("paragraph", "b")]), ("a\n \nb", [("paragraph", "a"), ("paragraph", "b")]), ("a\n\x85\t\n\n b", [("paragraph", "a"), ("paragraph", "b")]),
    ("1.2　标题", [("heading", "1.2　标题")]), ("١.٢ x", [("heading", "١.٢ x")]), ("1.2 x y z", [("heading", "1.2 x y z")]), ("1.2​x", [("paragraph", "1.2​x")]), ("1.2\x1cx", [("paragraph", "1.2\x1cx")]),
])
def test_unicode_blanks_and_digits(spark, markdown, want):
    df = spark.createDataFrame([(markdown,)], "m string").select(F.explode(text.markdown_blocks(F.col("m"))).alias("b"))
    assert [(r["b"]["kind"], r["b"]["content"]) for r in df.collect()] == want
