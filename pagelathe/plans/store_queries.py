"""Queries over what is stored: calls within a budget, files by their content, frozen snapshots, claims, pruning, each with its SQL."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from pagelathe.operators import manifest, provider
from pagelathe.operators.prune_log import PruneLog
from pagelathe.plans import flows
from pagelathe.plans.queries import query, table
from pagelathe.sources import storage
from pagelathe.sources.versions import VersionedTable
from pagelathe.streaming import claims


def orderly_parser(image, raw_text, page_no):
    """Stands for a model: what becomes of a call shows in the text."""
    if raw_text[0] == "P":
        raise provider.Retryable("busy")
    if raw_text[1] == "5":
        raise provider.InvalidPage("no page", raw_text)
    if raw_text[1] == "2":
        raise ValueError("broken")
    return raw_text.upper()


@query("""
WITH p AS (SELECT o_custkey AS r, o_orderkey AS p, CASE WHEN o_orderstatus = 'P' OR o_orderpriority LIKE '5%' THEN 'retry' WHEN o_orderpriority LIKE '2%' THEN 'failed' ELSE 'ok' END AS kind, 12 - count(*) FILTER (o_orderpriority LIKE '1%') OVER (PARTITION BY o_custkey) AS calls FROM orders),
a AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY p) <= calls)::INT AS g1 FROM p),
b AS (SELECT *, calls - sum(g1) OVER (PARTITION BY r) AS left1, kind = 'retry' OR g1 = 0 AS open1 FROM a),
c AS (SELECT *, (open1 AND row_number() OVER (PARTITION BY r, open1 ORDER BY p) <= left1)::INT AS g2 FROM b),
d AS (SELECT *, left1 - sum(g2) OVER (PARTITION BY r) AS left2, kind = 'retry' OR g1 + g2 = 0 AS open2 FROM c),
e AS (SELECT *, (open2 AND row_number() OVER (PARTITION BY r, open2 ORDER BY p) <= left2)::INT AS g3 FROM d)
SELECT r AS run_id, CAST(p AS INTEGER) AS page_no, CAST(g1 + g2 + g3 AS BIGINT) AS calls, CASE WHEN g1 + g2 + g3 > 0 AND kind <> 'retry' THEN kind WHEN g1 + g2 + g3 = 3 THEN 'failed' ELSE 'budget' END AS outcome FROM e""")
def budget_rounds(spark, d):
    """Orders as pages of a customer's run: 12 calls a run, of which urgent orders have had one before; three attempts a page."""
    o = table(spark, d, "orders", "o_custkey AS run_id", "CAST(o_orderkey AS INT) AS page_no", "CAST(NULL AS BINARY) AS image", "concat(o_orderstatus, o_orderpriority) AS raw_text")
    made = o.filter("raw_text LIKE '_1%'").selectExpr("CAST(run_id AS STRING) AS run_id", "page_no", "1 AS attempt", "'{}' AS response", "CAST(NULL AS STRING) AS error", "'ok' AS outcome")
    asked = o.withColumn("run_id", F.col("run_id").cast("string"))
    none = spark.createDataFrame([], "run_id string, page_no int")
    answers = flows.parse_run(asked, none, made, orderly_parser, provider.Limits(attempts=3, calls=12))
    calls = answers.groupBy("run_id", "page_no").agg(F.count_if(F.col("outcome") != "budget").alias("calls"))
    last = provider.final_answers(answers).join(calls, ["run_id", "page_no"])
    return last.select(F.col("run_id").cast("long").alias("run_id"), "page_no", "calls", "outcome")


CARD = "s_name || '|' || s_suppkey || '|' || s_nationkey"


@query(f"SELECT 'cards/' || s_suppkey || '.txt' AS path, sha256({CARD}) AS sha256, CAST(strlen({CARD}) AS BIGINT) AS size_bytes, 'ok' AS state, (SELECT count(*) FROM supplier) AS files FROM supplier")
def frozen_files(spark, d):
    """Suppliers' cards frozen as files and a table of facts, then hashed where they lie."""
    s = table(spark, d, "supplier", "concat('cards/', s_suppkey, '.txt') AS path", "concat_ws('|', s_name, s_suppkey, s_nationkey) AS t").select("path", F.sha2("t", 256).alias("sha256"), F.col("t").cast("binary").alias("content"))
    root = storage.shared_path(spark, "frozen")
    storage.freeze(s.agg(F.count(F.lit(1)).alias("files")), s, root, "cards")
    facts, entries = storage.frozen(spark, root, "cards")
    return entries.select("path", "sha256", "size_bytes").join(storage.verify_frozen(spark, root, "cards"), "path").withColumn("files", F.lit(facts.first()["files"]))


@query("""
WITH n AS (SELECT s_nationkey % 7 || '.txt' AS path, sha256('nation ' || s_nationkey) AS h, strlen('nation ' || s_nationkey) AS b FROM supplier), o AS (SELECT path, min(h) AS sha256, count(DISTINCT h) AS n, max(b) AS size_bytes FROM n GROUP BY path)
SELECT path, sha256, CAST(size_bytes AS BIGINT) AS size_bytes, CASE WHEN n > 1 THEN 'conflict' WHEN path = '3.txt' THEN CASE WHEN sha256 = sha256('nation 3') THEN 'known' ELSE 'conflict' END ELSE 'new' END AS state FROM o""")
def stored_objects(spark, d):
    """Suppliers' nations stored by content: equal contents once, paths with several contents told."""
    s = table(spark, d, "supplier", "concat(s_nationkey % 7, '.txt') AS path", "CAST(concat('nation ', s_nationkey) AS BINARY) AS content")
    index = spark.sql("SELECT '3.txt' AS path, sha2('nation 3', 256) AS sha256")
    return storage.put_objects(s, index, storage.shared_path(spark, "store"))


QUEUED = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded' WHEN 3 THEN 'queued' ELSE 'running' END"


@query(f"""
WITH j AS (SELECT event_id AS id, ts, {QUEUED} AS s, event_id % 5 = 1 AS late FROM events), q AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS n FROM j WHERE s = 'queued' OR late),
c AS (SELECT 'w' || c_custkey AS worker, c_mktsegment < 'H' AS early, row_number() OVER (ORDER BY c_mktsegment < 'H' DESC, c_custkey) AS n FROM customer)
SELECT j.id, CASE WHEN worker IS NOT NULL THEN 'running' WHEN late THEN 'queued' ELSE s END AS status, CAST(CASE WHEN worker IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempt, coalesce(worker, CASE WHEN s = 'running' AND NOT late THEN 'old' END) AS lease_owner,
    CASE WHEN worker IS NOT NULL THEN CASE WHEN early THEN '2030-01-01 03:00:00' ELSE '2030-01-01 04:00:00' END WHEN s = 'running' AND NOT late THEN '2031-01-01 00:00:00' END AS lease_expires
FROM j LEFT JOIN q ON j.id = q.id LEFT JOIN c ON q.n = c.n""")
def batched_claims(spark, d):
    """Customers claim events as jobs in two micro-batches, both of which come twice."""
    jobs = table(
        spark, d, "events", "event_id AS id", f"{QUEUED} AS status", "0 AS attempt", "3 AS max_attempts", f"CASE WHEN {QUEUED} = 'running' THEN 'old' END AS lease_owner", f"CASE WHEN event_id % 5 = 1 THEN TIMESTAMP_NTZ'2029-01-01' WHEN {QUEUED} = 'running' THEN TIMESTAMP_NTZ'2031-01-01' END AS lease_expires_at",
        "ts AS created_at", "CAST(NULL AS TIMESTAMP_NTZ) AS started_at", "CAST(NULL AS TIMESTAMP_NTZ) AS finished_at", "CAST(NULL AS STRING) AS error_json",
    )
    held = VersionedTable(spark, storage.shared_path(spark, "jobs"), claims.TABLE)
    held.commit(-1, jobs)
    c = table(spark, d, "customer", "c_custkey AS seq", "concat('w', c_custkey) AS worker", "CASE WHEN c_mktsegment < 'H' THEN TIMESTAMP_NTZ'2030-01-01 01:00:00' ELSE TIMESTAMP_NTZ'2030-01-01 02:00:00' END AS ts", "c_mktsegment < 'H' AS early")
    for batch, rows in ((0, c.filter("early")), (0, c.filter("early")), (1, c.filter("NOT early")), (0, c.filter("early")), (1, c.filter("NOT early"))):
        claims.claim_batch(held, rows, batch, "waiting", 7200)
    return held.read().select("id", "status", "attempt", "lease_owner", F.date_format("lease_expires_at", "yyyy-MM-dd HH:mm:ss").alias("lease_expires"))


RUN, PART = "id long, document_id long, status string, artifact_state string, prune_summary string", "id string, run_id long, review_status string, page_no int, kind string, content_hash string, size_bytes long"


@query("""
WITH p AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'pruned' ELSE 'available' END AS artifact_state, o_orderstatus = 'F' AS told, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE coalesce(n, 0) END AS pages, CASE WHEN o_orderstatus = 'O' THEN 'rolled_back' ELSE 'purged' END AS operation FROM orders LEFT JOIN p ON o_orderkey = k""")
def logged_prune(spark, d):
    """Orders as runs: finished ones are pruned, open ones pruned and brought back, by two operations with logs."""
    root = storage.shared_path(spark, "prune")
    o = table(spark, d, "orders", "o_orderkey AS id", "o_custkey AS document_id", "'parsed' AS status", "'available' AS artifact_state", "CAST(NULL AS STRING) AS prune_summary", "o_orderstatus AS state")
    lines = table(spark, d, "lineitem", "concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey, '/', l_extendedprice, '/', l_shipdate) AS id", "l_orderkey AS run_id", "'needs_review' AS review_status", "CAST(l_linenumber AS INT) AS page_no", "'page' AS kind", "'h' AS content_hash", "1L AS size_bytes")
    runs, pages, parts = (VersionedTable(spark, f"{root}/{n}", s, near=by) for n, s, by in (("runs", RUN, None), ("pages", PART, "run_id"), ("artifacts", PART, "run_id")))
    runs.commit(-1, o)
    pages.commit(-1, lines)
    # The same rows, which lie dealt by now.
    parts.commit(-1, pages.read(), dealt=True)
    log = PruneLog(spark, f"{root}/log", runs, pages, parts)
    plan = lambda s: o.filter(F.col("state") == s).select("id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("refusal"), F.lit(1).cast("long").alias("reclaimable_bytes"))
    ended = {}
    for s in ("F", "O"):
        log.plan(s, plan(s), "h", "none")
        ended[s] = log.run(s, "h", "none")
    ended["O"] = log.roll_back("O", "h", "none")
    n = pages.count_near(f"{root}/counts").withColumnRenamed("run_id", "id")
    out = runs.read().join(n, "id", "left").join(o.select("id", "state"), "id")
    return out.select("id", "artifact_state", F.col("prune_summary").isNotNull().alias("told"), F.coalesce("n", F.lit(0)).cast("long").alias("pages"), F.when(F.col("state") == "O", ended["O"]).otherwise(ended["F"]).alias("operation"))


@query("""
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE lang = 'en' AND text IS NOT NULL) GROUP BY text""")
def bucketed_registration(spark, d):
    """Documents of all languages offered to a store, in buckets by content, that holds the English ones."""
    t = table(spark, d, "documents", "doc_id", "lang", "sha2(text, 256) AS content_hash")
    name = "held_" + uuid.uuid4().hex
    # The table is the query's own: it goes when the process ends.
    atexit.register(lambda: spark.sql(f"DROP TABLE IF EXISTS {name}") if spark.getActiveSession() else None)
    manifest.store_bucketed(t.filter("lang = 'en' AND content_hash IS NOT NULL").select("content_hash"), name, "content_hash", int(spark.conf.get("spark.sql.shuffle.partitions")))
    first = t.filter("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return manifest.register_bucketed(spark, name, first, "content_hash")
