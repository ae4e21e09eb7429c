"""More queries over the driver's tables: records, guards, views and page facts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.functions import geometry, ids, repair, text
from pagelathe.operators import evaluate, knowledge, maintenance, manifest, pages, reviews, runs
from pagelathe.plans import flows
from pagelathe.plans.queries import NORMAL, PY, _page, query, table
from pagelathe.sources import readers
from pagelathe.sources.schemas import BOX
from pagelathe.streaming import jobs

STRIP = f"regexp_replace(regexp_replace(%s, '^[{PY}\\n]+', ''), '[{PY}\\n]+\\z', '')"

# ------------------------------------------------------------------- texts


@query(f"WITH t AS (SELECT doc_id, replace(coalesce(text, ''), '. ', ' . ' || chr(10) || chr(12288)) AS x FROM documents) SELECT doc_id, sha256(regexp_replace({NORMAL}, '[{PY}\\n]+', '', 'g')) AS hash FROM t")
def normalize_latex(spark, d):
    t = table(spark, d, "documents", "doc_id", "replace(coalesce(text, ''), '. ', concat(' . ', chr(10), '　')) AS x")
    return t.select("doc_id", F.sha2(text.normalize_latex(F.col("x")), 256).alias("hash"))


@query(f"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(coalesce(text, ''), '. ', ' ；; '), '[;；]'), lambda v: {STRIP % "v"}), lambda v: v <> '') AS e FROM documents)
SELECT doc_id, len(e) AS n, CAST(coalesce(list_sum(list_transform(e, lambda v: length(v))), 0) AS BIGINT) AS chars FROM t""")
def split_errors(spark, d):
    t = table(spark, d, "documents", "doc_id", "replace(coalesce(text, ''), '. ', ' ；; ') AS x").select("doc_id", text.split_errors(F.col("x")).alias("e"))
    return t.select("doc_id", F.size("e").cast("long").alias("n"), F.aggregate("e", F.lit(0).cast("long"), lambda s, v: s + F.length(v)).alias("chars"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 <> 2 THEN doc_id END AS found, doc_id % 4 = 3 AS repaired FROM documents""")
def json_answers(spark, d):
    """A model's answers: fenced, with words behind, without an object, with a raw line end in a string."""
    t = table(
        spark, d, "documents", "doc_id", """CASE doc_id % 4 WHEN 0 THEN concat('```json\\n{"id": ', doc_id, '}\\n```') WHEN 1 THEN concat('{"id": ', doc_id, '} and so on') WHEN 2 THEN concat('no ', doc_id)
        ELSE concat('{"id": ', doc_id, ', "t": "a\\nb"}') END AS answer""",
    )
    j = t.select("doc_id", repair.json_object(F.col("answer")).alias("j"))
    return j.select("doc_id", F.get_json_object("j.json", "$.id").cast("long").alias("found"), F.coalesce("j.repaired", F.lit(False)).alias("repaired"))


MIME = "CASE doc_id % 6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/markdown' WHEN 4 THEN 'application/pdf' ELSE 'application/octet-stream' END"


@query(f"SELECT doc_id, {MIME} AS mime, sha256('data:' || {MIME} || ';base64,' || to_base64(encode(text))) AS hash FROM documents WHERE text IS NOT NULL")
def data_urls(spark, d):
    path = "concat('a.b/', doc_id, element_at(array('.PNG', '.jpeg', '.json', '.md', '.pdf', ''), CAST(doc_id % 6 AS INT) + 1)) AS path"
    t = table(spark, d, "documents", "doc_id", "text", path).filter("text IS NOT NULL")
    t = t.select("doc_id", ids.mime_of(F.col("path")).alias("mime"), F.col("text").cast("binary").alias("content"))
    return t.select("doc_id", "mime", F.sha2(ids.data_url(F.col("content"), F.col("mime")), 256).alias("hash"))


@query("""
SELECT doc_id, doc_id % 70 BETWEEN 7 AND 64 AND doc_id % 11 <> 0 AND (doc_id % 3 <> 0 OR doc_id % 2 = 0) AS ok FROM documents""")
def revision_checks(spark, d):
    commit = "upper(concat(left(sha2(CAST(doc_id AS STRING), 256), CAST(doc_id % 70 AS INT)), CASE WHEN doc_id % 70 > 64 THEN 'abcdef' ELSE '' END, CASE WHEN doc_id % 11 = 0 THEN 'g' ELSE '' END))"
    t = table(spark, d, "documents", "doc_id", f"{commit} AS c", "doc_id % 3 = 0 AS dirty", "CASE WHEN doc_id % 2 = 0 THEN sha2('x', 256) ELSE 'x' END AS h")
    return t.select("doc_id", ids.is_revision(F.col("c"), F.col("dirty"), F.col("h")).alias("ok"))


# ------------------------------------------------------------------- boxes

BOXES = "CAST(l_partkey % 1200 AS DOUBLE) - 50 AS x0, CAST(l_suppkey % 900 AS DOUBLE) - 20 AS y0, CAST(l_partkey % 1200 AS DOUBLE) - 60 + CAST(l_quantity AS DOUBLE) AS x1, CAST(l_suppkey % 900 AS DOUBLE) + l_linenumber * 30 - 40 AS y1"


@query(f"""
WITH b AS (SELECT l_orderkey, l_linenumber, {BOXES} FROM lineitem), o AS (SELECT *, x0 >= 0 AND x0 < x1 AND y0 >= 0 AND y0 < y1 AND x1 <= 1000 AND y1 <= 1000 AS ok FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN round(x0 * 595 / 1000, 6) END AS left_, CASE WHEN ok THEN round(y1 * 842 / 1000, 6) END AS bottom,
    l_linenumber % 3 < 2 AND least(x1, 595) - greatest(x0, 0) >= 1 AND least(y1, 842) - greatest(y0, 0) >= 1 AS cropped FROM o""")
def scaled_boxes(spark, d):
    t = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", *[b.strip() for b in BOXES.split(", ")], "element_at(array('figure', 'table', 'paragraph'), CAST(l_linenumber % 3 AS INT) + 1) AS kind")
    box, w, h = F.array("x0", "y0", "x1", "y1"), F.lit(595), F.lit(842)
    b = t.withColumn("s", geometry.scaled_box(box, w, h))
    return b.select("l_orderkey", "l_linenumber", F.round(F.col("s")[0], 6).alias("left_"), F.round(F.col("s")[3], 6).alias("bottom"), geometry.can_crop(F.col("kind"), box, w, h).alias("cropped"))


# ------------------------------------------------------------- page facts


@query(f"""
WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS m, doc_id % 3 = 0 AS hb, doc_id % 4 = 0 AS hk, CASE WHEN doc_id % 8 = 0 THEN 'blank' WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'chapter' WHEN doc_id % 4 = 0 THEN 'content' END AS kind FROM documents),
g AS (SELECT *, {STRIP % "coalesce(m, '')"} = '' AS nothing, CASE WHEN hb OR hk THEN 'native_page' WHEN {STRIP % "coalesce(m, '')"} = '' THEN 'invalid' ELSE 'markdown_only' END AS tag FROM t),
k AS (SELECT *, CASE WHEN tag = 'markdown_only' THEN 'content' ELSE kind END AS k2, hb OR tag = 'markdown_only' AS b2 FROM g)
SELECT doc_id, tag AS schema_tag, CASE WHEN k2 IS NULL OR k2 NOT IN ('content', 'reference', 'blank') THEN 'page_kind' WHEN m IS NULL OR NOT b2 THEN 'types' WHEN k2 <> 'blank' AND nothing THEN 'empty' END AS flaw FROM k""")
def schema_tags(spark, d):
    t = table(spark, d, "documents", "doc_id", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS markdown", "doc_id % 3 = 0 AS has_blocks", "doc_id % 4 = 0 AS has_kind", "CASE WHEN doc_id % 8 = 0 THEN 'blank' WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'chapter' WHEN doc_id % 4 = 0 THEN 'content' END AS page_kind")
    block = F.struct(F.lit("paragraph"), F.lit("x"), *[F.lit(None)] * 2, F.lit(None), F.lit(1.0), F.lit("vision")).cast(pages.MODEL_BLOCK)
    t = pages.normalize_schema(t.withColumn("blocks", F.when(F.col("has_blocks"), F.array(block))))
    return t.select("doc_id", "schema_tag", pages.page_flaw(F.col("page_kind"), F.col("markdown"), F.col("blocks")).alias("flaw"))


@query(f"""
WITH t AS (SELECT doc_id AS id, {STRIP % "coalesce(text, '')"} AS t FROM documents),
r AS (SELECT *, CASE WHEN id % 3 = 0 THEN '' ELSE left(t, 500) END AS raw, id % 5 = 0 AS lost_model, CASE WHEN id % 7 = 0 THEN 0.001 ELSE 0.01 END AS ink FROM t),
k AS (SELECT *, CASE WHEN lost_model THEN 'content' WHEN id % 13 = 0 THEN 'blank' WHEN id % 6 = 0 THEN 'content' ELSE 'reference' END AS kind, {STRIP % "CASE WHEN lost_model OR id % 11 = 0 THEN raw ELSE coalesce(nullif(t, ''), raw) END"} AS md,
    NOT lost_model AND id % 4 <> 0 AND t <> '' AS made, id % 3 <> 0 AND t <> '' AS native FROM r),
p AS (SELECT *, CASE WHEN md = '' AND kind <> 'blank' AND ink < 0.002 THEN 'blank' ELSE kind END AS page_kind, made OR native AS blocks FROM k)
SELECT id AS doc_id, page_kind, CASE WHEN lost_model AND raw = '' THEN 'timeout' WHEN md = '' AND page_kind <> 'blank' THEN 'empty text' WHEN NOT blocks AND page_kind <> 'blank' THEN 'no blocks' END AS error, length(md) AS chars,
    CASE WHEN made AND NOT (native AND id % 2 = 0) THEN CAST(297.5 AS DOUBLE) WHEN blocks THEN CAST(3 AS DOUBLE) END AS box_right, CASE WHEN raw <> '' THEN 'text_quote' ELSE 'page_image' END AS evidence_kind, length(left(raw, 300)) AS quoted,
    CAST((raw = '' AND page_kind <> 'blank')::INT + lost_model::INT + (NOT blocks)::INT AS INTEGER) AS issues, 'parser-' || (id % 2) AS provider FROM p""")
def page_facts(spark, d):
    """Answers, text layers and failures by turns: kinds, blocks, boxes, evidence, quality and errors of the pages that come of them."""
    t = table(spark, d, "documents", "doc_id AS id", "coalesce(text, '') AS t").withColumn("t", text.strip(F.col("t")))
    start = F.left("t", F.lit(60))
    layer = F.when((F.col("id") % 3 != 0) & (F.col("t") != ""), F.array(F.struct(start.alias("text"), F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)]).alias("bbox"))))
    layer = F.coalesce(layer, F.array().cast(f"array<struct<text:string,bbox:{BOX}>>"))
    quote = F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("zzz"), F.left("t", F.lit(30))))
    thousand = F.array(*[F.lit(float(i)) for i in (0, 0, 500, 500)])
    block = F.struct(F.lit(""), start, F.lit(None), quote, thousand, F.lit(0.0), F.lit("")).cast(pages.MODEL_BLOCK)
    kind = F.when(F.col("id") % 13 == 0, "blank").when(F.col("id") % 6 == 0, "oddity").otherwise("reference")
    model = F.struct(kind.alias("page_kind"), F.when(F.col("id") % 11 == 0, "").otherwise(F.col("t")).alias("markdown"), F.when(F.col("id") % 4 == 0, F.array().cast(f"array<{pages.MODEL_BLOCK}>")).otherwise(F.array(block)).alias("blocks"))
    parsed = t.select(
        F.lit("run").alias("run_id"), F.lit("doc").alias("document_id"), F.col("id").cast("int").alias("page_no"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), F.when(F.col("id") % 7 == 0, 0.001).otherwise(0.01).alias("ink_ratio"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.left("t", F.lit(500))).alias("raw_text"), pages.native_blocks(layer).alias("native"), F.when(F.col("id") % 5 != 0, model).alias("model"), F.when(F.col("id") % 5 == 0, "timeout").alias("parser_error"), F.concat(F.lit("parser-"), F.col("id") % 2).alias("provider"),
    )
    p = pages.page_facts(parsed)
    return p.select(
        F.col("page_no").cast("long").alias("doc_id"), "page_kind", "error", F.length("markdown").cast("long").alias("chars"), F.get(F.get("blocks", F.lit(0))["bbox"], F.lit(2)).alias("box_right"), F.col("evidence")[0]["kind"].alias("evidence_kind"),
        F.length(F.col("evidence")[0]["quote"]).cast("long").alias("quoted"), F.size("quality.issues").alias("issues"), F.col("quality.provider").alias("provider"),
    )


@query(None)
def page_text_diffs(spark, d):
    """Unified diffs of neighbouring documents, which SQL can't express: lines added and taken away, and a digest; tests hold them against difflib."""
    t = table(spark, d, "documents").select(F.col("source").alias("comparison_id"), F.expr("doc_id div 2").alias("page_no"), (F.col("doc_id") % 2).alias("side"), _page(F.col("text"), F.col("lang")).alias("page"))
    out = evaluate.compare_pages(t.select("comparison_id", "page_no").distinct(), t.filter("side = 0"), t.filter("side = 1"))
    starts = lambda c: F.size(F.filter("text_diff", lambda x: F.startswith(x, F.lit(c)))).cast("long")
    return out.select("comparison_id", "page_no", starts("+").alias("added"), starts("-").alias("taken"), F.sha2(F.array_join("text_diff", "\n"), 256).alias("hash"))


# -------------------------------------------------------------------- runs


@query("SELECT o_custkey AS document_id, l_orderkey AS run_id, l_linenumber AS page_no FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (o_custkey, o_orderkey) IN (SELECT (o_custkey, max(o_orderkey)) FROM orders WHERE o_custkey % 3 <> 0 GROUP BY o_custkey)")
def current_run_pages(spark, d):
    o = table(spark, d, "orders", "o_orderkey AS run_id", "o_custkey AS document_id")
    documents = o.groupBy(F.col("document_id").alias("id")).agg(F.max("run_id").alias("current_parse_run_id")).withColumn("current_parse_run_id", F.when(F.col("id") % 3 != 0, F.col("current_parse_run_id")))
    return runs.current_pages(documents, table(spark, d, "lineitem", "l_orderkey AS run_id", "l_linenumber AS page_no").join(o, "run_id")).select("document_id", "run_id", "page_no")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0")
def available_runs(spark, d):
    return runs.require_available(table(spark, d, "orders", "o_orderkey AS id", "CASE WHEN o_orderkey % 5 = 0 THEN 'pruned' WHEN o_orderkey % 3 = 0 THEN 'available' END AS artifact_state")).select("id")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def hidden_columns(spark, d):
    t = table(spark, d, "orders", "o_orderkey AS id", "o_orderstatus AS status", "'x' AS path", "'x' AS source_path", "'x' AS definition_path", "'x' AS files", "'x' AS runs_backup", "'x' AS own")
    return evaluate.hide(t, "own")


@query("""SELECT l_orderkey AS run_id, l_linenumber AS page_no FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_returnflag = 'R')""")
def pages_to_resume(spark, d):
    t = table(spark, d, "lineitem", "l_orderkey AS run_id", "l_linenumber AS page_no", "l_returnflag AS f")
    return pages.pending_pages(t.drop("f"), t.filter("f = 'R'"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'parsed' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'interrupted' ELSE 'failed' END AS run_status, CASE WHEN o_orderkey % 4 = 0 THEN 'needs_review' ELSE 'failed' END AS document_status FROM orders""")
def run_outcomes(spark, d):
    t = table(spark, d, "orders", "o_orderkey AS id", "element_at(array('finished', 'cancelled', 'interrupted', 'failed'), CAST(o_orderkey % 4 AS INT) + 1) AS outcome")
    run, document = runs.finished_status(F.col("outcome"))
    return t.select("id", run.alias("run_status"), document.alias("document_status"))


@query("""
SELECT 'run' AS what, o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'interrupted' ELSE 'parsed' END AS status FROM orders
UNION ALL SELECT 'document', c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'failed' ELSE 'parsed' END FROM customer""")
def recovered_runs(spark, d):
    r = table(spark, d, "orders", "o_orderkey AS id", "o_custkey AS document_id", "CASE o_orderstatus WHEN 'P' THEN 'parsing' ELSE 'parsed' END AS status")
    after, documents = runs.recover_interrupted(r, table(spark, d, "customer", "c_custkey AS id", "'parsed' AS status"))
    return after.select(F.lit("run").alias("what"), "id", "status").unionByName(documents.select(F.lit("document").alias("what"), "id", "status"))


@query("""
SELECT CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 2 AS VARCHAR) ELSE substr(sha256(CAST(o_custkey AS VARCHAR) || chr(0) || 'job-' || o_orderkey || chr(0) || 'now'), 1, 32) END AS id, 'job-' || o_orderkey AS job_id, o_orderkey % 3 = 0 AS reopened,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS INTEGER) ELSE 0 END AS model_calls FROM orders""")
def opened_runs(spark, d):
    t = table(spark, d, "orders", "o_custkey AS document_id", "o_orderkey AS k", "concat('job-', o_orderkey) AS job_id", "'{}' AS provider_summary")
    old = t.filter("k % 3 = 0").selectExpr("k * 2 AS id", "document_id", "job_id", "provider_summary", "CAST(k % 9 AS INT) AS model_calls", "'then' AS created_at", "'failed' AS status")
    made = runs.open_runs(old, t.select("document_id", "job_id", "provider_summary", F.lit("now").alias("created_at")))
    return made.select("id", "job_id", "reopened", "model_calls")


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, substr(sha256(CAST(o_custkey AS VARCHAR) || chr(0) || '{"o":' || o_orderkey || '}' || chr(0) || strftime(o_orderdate, '%Y-%m-%d')), 1, 32) AS id FROM orders)
SELECT substr(sha256(id || chr(0) || 'release'), 1, 32) AS id, o_custkey AS document_id, id AS revision_id, '{"o":' || o_orderkey || '}' AS snapshot_json, 'published' AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, id DESC) AS n FROM r) WHERE n = 1""")
def revision_releases(spark, d):
    t = table(spark, d, "orders", "o_custkey AS document_id", "concat('x/', o_orderkey) AS path", """concat('{"o":', o_orderkey, '}') AS snapshot_json""", "date_format(o_orderdate, 'yyyy-MM-dd') AS created_at")
    return knowledge.release_revisions(knowledge.revise(t), F.lit("now")).drop("created_at")


@query("""
WITH j AS (SELECT event_id AS id, ts, event_id % 4 AS a, CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' ELSE 'cancel_requested' END AS s, event_id % 5 = 1 AS late FROM events),
w AS (SELECT *, CASE WHEN late AND a < 3 THEN 'queued' WHEN late THEN 'failed' ELSE s END AS s2 FROM j),
q AS (SELECT id, row_number() OVER (ORDER BY ts, id) AS n FROM w WHERE s2 = 'queued'), c AS (SELECT 'w' || c_custkey AS worker, row_number() OVER (ORDER BY c_custkey) AS n FROM customer)
SELECT w.id, CASE WHEN worker IS NOT NULL THEN 'running' ELSE s2 END AS status, CAST(a + (worker IS NOT NULL)::INT AS INTEGER) AS attempt, coalesce(worker, CASE WHEN s2 IN ('running', 'cancel_requested') THEN 'old' END) AS lease_owner,
    CASE WHEN worker IS NOT NULL THEN '2030-01-01 00:02:00' WHEN s2 IN ('running', 'cancel_requested') THEN '2031-01-01 00:00:00' END AS lease_expires, late AND a >= 3 AS expired, worker IS NOT NULL AS claimed
FROM w LEFT JOIN q ON w.id = q.id LEFT JOIN c ON q.n = c.n""")
def global_claim(spark, d):
    """The oldest queued jobs of the whole table go to the waiting workers, after leases that ran out are swept."""
    state = "CASE event_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'running' WHEN 3 THEN 'succeeded' ELSE 'cancel_requested' END"
    owned = "event_id % 5 IN (1, 2, 4)"
    j = table(
        spark, d, "events", "event_id AS id", f"{state} AS status", "CAST(event_id % 4 AS INT) AS attempt", "3 AS max_attempts", f"CASE WHEN {owned} THEN 'old' END AS lease_owner", f"CASE WHEN event_id % 5 = 1 THEN TIMESTAMP_NTZ'2029-01-01' WHEN {owned} THEN TIMESTAMP_NTZ'2031-01-01' END AS lease_expires_at",
        "ts AS created_at", "CAST(NULL AS TIMESTAMP_NTZ) AS started_at", "CAST(NULL AS TIMESTAMP_NTZ) AS finished_at", "CAST(NULL AS STRING) AS error_json",
    )
    out = jobs.claim(j, table(spark, d, "customer", "c_custkey AS seq", "concat('w', c_custkey) AS worker"), "2030-01-01 00:00:00", 120)
    return out.select("id", "status", "attempt", "lease_owner", F.date_format("lease_expires_at", "yyyy-MM-dd HH:mm:ss").alias("lease_expires"), F.col("error_json").isNotNull().alias("expired"), "claimed")


# ----------------------------------------------------------------- lookups


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    """One row at most, by key: the limit is the feature."""
    return readers.lookup(table(spark, d, "orders"), o_orderkey=7).select("o_orderkey", "o_custkey")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def parameterised_sql(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("asked_orders")
    return readers.sql(spark, "SELECT o_orderpriority AS priority, count(*) AS n FROM asked_orders WHERE o_custkey > :least AND o_orderstatus = :status GROUP BY o_orderpriority", least=100, status="F")


@query("""
WITH h AS (SELECT o_custkey AS k, min(o_orderpriority) AS home, count(DISTINCT o_orderpriority) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)
SELECT c_custkey AS id, CASE WHEN n = 1 THEN home END AS case_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'conflict' ELSE 'found' END AS outcome FROM customer LEFT JOIN h ON c_custkey = k""")
def located_resources(spark, d):
    held = table(spark, d, "orders").filter("o_orderkey % 5 = 0").selectExpr("o_custkey AS id", "o_orderpriority AS case_id")
    return readers.locate(held, table(spark, d, "customer", "c_custkey AS id"), "id")


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE lang = 'en' AND doc_id % 5 = 3")
def first_file(spark, d):
    t = table(spark, d, "documents", "doc_id", "doc_id AS pos", "lang AS kind", "CAST(doc_id % 5 AS INT) AS page_no")
    return manifest.first_file(t, "en", 3).select("doc_id")


# ------------------------------------------------------------------ guards


@query("""
WITH k AS (SELECT l_orderkey AS id, count(*) AS n, bool_or(l_linenumber = 1 AND l_returnflag = 'A') AS m, bool_and(l_returnflag = 'R') AS bare FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey, l_linenumber),
p AS (SELECT id, sum(n) AS n, bool_or(m) AS m, bool_or(bare) AS bare FROM k GROUP BY id),
r AS (SELECT o_orderkey AS id, o_orderstatus AS s, n, m, bare, o_custkey % 7 AS c FROM orders LEFT JOIN p ON o_orderkey = p.id)
SELECT id, unnest(list_filter([CASE WHEN s <> 'F' THEN 'status' END, CASE WHEN id % 5 = 0 THEN 'artifacts' END, CASE WHEN n IS NULL THEN 'no pages' END, CASE WHEN NOT coalesce(m, false) THEN 'no manifest' END, CASE WHEN bare THEN 'page without json' END, CASE WHEN c = 0 THEN 'source hash' END], lambda x: x IS NOT NULL)) AS flaw FROM r""")
def capture_flaws(spark, d):
    o = table(spark, d, "orders", "o_orderkey AS id", "o_custkey % 7 AS document_hash", "CASE o_orderstatus WHEN 'F' THEN 'parsed' ELSE 'parsing' END AS status", "CASE WHEN o_orderkey % 5 = 0 THEN 'pruned' END AS artifact_state")
    p = table(spark, d, "lineitem", "l_orderkey AS run_id", "l_linenumber AS page_no", "l_returnflag AS f").filter("run_id % 13 <> 0")
    artifacts = p.filter("f <> 'R'").selectExpr("run_id", "page_no", "'page_json' AS kind").unionByName(p.filter("page_no = 1 AND f = 'A'").selectExpr("run_id", "page_no", "'parse_manifest' AS kind"))
    cases = o.select(F.col("document_hash").alias("content_hash")).distinct().filter("content_hash <> 0")
    return evaluate.capture_flaws(o, p.drop("f"), artifacts, cases)


@query("""
SELECT 's' || o_orderkey AS snapshot_id, string_agg(l_linenumber, ',' ORDER BY l_linenumber) AS page_numbers, CAST(min(l_linenumber) AS INTEGER) AS page_start, CAST(max(l_linenumber) AS INTEGER) AS page_end, o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 AS baseline_eligible
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def snapshot_facts(spark, d):
    r = table(spark, d, "orders", "o_orderkey AS id", "concat('s', o_orderkey) AS snapshot_id", "o_custkey AS case_id", "'l' AS label", "'h' AS document_hash", "1 AS model_calls", "CASE WHEN o_orderkey % 3 = 0 THEN 'main' WHEN o_orderkey % 3 = 1 THEN 'other' END AS branch", "CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN false END AS dirty")
    s = evaluate.snapshot_rows(r, table(spark, d, "lineitem", "l_orderkey AS run_id", "CAST(l_linenumber AS INT) AS page_no"))
    return s.select("snapshot_id", F.array_join(F.transform("page_numbers", lambda x: x.cast("string")), ",").alias("page_numbers"), "page_start", "page_end", "baseline_eligible")


@query("""
WITH s AS (SELECT o_orderkey AS k, o_custkey % 3 AS h, o_orderkey % 4 <> 0 AS e, [o_orderkey % 2, 9] AS p FROM orders)
SELECT b.k AS id, CASE WHEN b.k % 6 = 0 THEN 'same snapshot' WHEN NOT b.e THEN 'baseline' WHEN b.h <> c.h THEN 'document' WHEN b.p <> c.p THEN 'pages' END AS flaw FROM s b JOIN s c ON c.k = CASE WHEN b.k % 6 = 0 THEN b.k ELSE xor(b.k, 5) END""")
def compare_flaws(spark, d):
    s = table(spark, d, "orders", "o_orderkey AS snapshot_id", "o_custkey % 3 AS document_hash", "o_orderkey % 4 <> 0 AS baseline_eligible", "array(o_orderkey % 2, 9) AS page_numbers")
    wanted = s.select(F.col("snapshot_id").alias("id"), F.expr("CASE WHEN snapshot_id % 6 = 0 THEN snapshot_id ELSE snapshot_id ^ 5 END").alias("other"))
    side = lambda name, key: s.select(F.col("snapshot_id").alias(key), F.struct(*s.columns).alias(name))
    return wanted.join(side("b", "id"), "id").join(side("c", "other"), "other").select("id", evaluate.compare_flaw().alias("flaw"))


@query("""
SELECT source AS run_id, unnest(list_filter([CASE WHEN min(doc_id % 40) <> 1 OR max(doc_id % 40) <> count(*) OR count(DISTINCT doc_id % 40) <> count(*) THEN 'page numbers' END, CASE WHEN count(*) <> 25 THEN 'page count' END, CASE WHEN source = 'src1' THEN 'source hash' END], lambda x: x IS NOT NULL)) AS flaw FROM documents WHERE doc_id % 2 = 1 GROUP BY source""")
def replay_flaws(spark, d):
    p = table(spark, d, "documents").filter("doc_id % 2 = 1").selectExpr("source AS run_id", "doc_id % 40 AS page_no")
    wanted = p.select("run_id").distinct().selectExpr("run_id", "'h' AS source_hash", "25 AS page_count", "CASE WHEN run_id = 'src1' THEN 'g' ELSE 'h' END AS actual_hash")
    return flows.replay_flaws(p, wanted)


# ----------------------------------------------------------------- reviews


@query("""
WITH e AS (SELECT doc_id % 97 AS t, CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS s, lang, doc_id FROM documents WHERE doc_id % 3 = 0), l AS (SELECT t, arg_max(s, doc_id) AS s, arg_max(lang, doc_id) AS r FROM e GROUP BY t)
SELECT n_nationkey AS id, coalesce(s, 'needs_review') AS review_status, coalesce(r, '') AS review_reason FROM nation LEFT JOIN l ON n_nationkey = t""")
def review_states(spark, d):
    e = table(spark, d, "documents").filter("doc_id % 3 = 0").selectExpr("'page' AS target_type", "doc_id % 97 AS target_id", "CASE WHEN doc_id % 2 = 0 THEN 'accepted' ELSE 'rejected' END AS status", "lang AS reason", "doc_id AS seq")
    e = e.unionByName(e.withColumn("target_type", F.lit("edge")).withColumn("seq", F.col("seq") * 10).withColumn("status", F.lit("other")))
    return reviews.current_state(table(spark, d, "nation", "n_nationkey AS id", "'needs_review' AS review_status", "'' AS review_reason"), e, "page")


@query("SELECT n_nationkey AS target_id, n_nationkey + 1 AS seq FROM nation UNION ALL SELECT r_regionkey, (SELECT count(*) FROM nation) + row_number() OVER (ORDER BY r_regionkey DESC) FROM region")
def appended_reviews(spark, d):
    old = table(spark, d, "nation", "n_nationkey AS target_id", "n_nationkey + 1 AS seq")
    return reviews.append_review(old, table(spark, d, "region", "r_regionkey AS target_id", "-r_regionkey AS place")).select("target_id", "seq")


@query("""
WITH l AS (SELECT source, '- Page ' || d.doc_id || ': `' || CASE quality WHEN 1 THEN 'pass' ELSE 'failed' END || '` - ' || CASE WHEN toxic = 1 THEN 'rude' ELSE '' END AS line, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE source <> 'src2'),
a AS (SELECT source, string_agg(line, chr(10) ORDER BY doc_id) AS body FROM l GROUP BY source), s AS (SELECT DISTINCT source FROM documents)
SELECT s.source AS id, sha256('# Report' || chr(10) || chr(10) || '- Case: `' || s.source || '`' || chr(10) || '- Average: `none`' || chr(10) || chr(10) || '## Reviews' || chr(10) || chr(10) || coalesce(body, 'No reviews yet.') || chr(10)) AS hash FROM s LEFT JOIN a ON s.source = a.source""")
def report_texts(spark, d):
    t = table(spark, d, "documents", "doc_id", "source").join(table(spark, d, "labels"), "doc_id").filter("source <> 'src2'")
    r = t.select(F.col("source").alias("id"), F.col("doc_id").alias("page_no"), F.when(F.col("quality") == 1, "pass").otherwise("failed").alias("verdict"), F.when(F.col("toxic") == 1, "rude").alias("reason"))
    reports = table(spark, d, "documents", "source AS id").distinct().selectExpr("id", "id AS case_name", "CAST(NULL AS DOUBLE) AS average")
    return evaluate.report_markdown(reports, r, "Report", {"Case": "case_name", "Average": "average"}, "id").select("id", F.sha2("markdown", 256).alias("hash"))


# ------------------------------------------------------------------- views


@query("""
SELECT c_nationkey AS case_id, count(*) FILTER (c_custkey % 2 = 0) AS snapshots, count(*) FILTER (c_custkey % 3 = 0) AS assessments, CAST(coalesce(min(c_custkey) FILTER (c_custkey % 5 = 0), -1) AS BIGINT) AS first_comparison FROM customer GROUP BY c_nationkey
UNION ALL SELECT 1000, 0, 0, -1""")
def document_views(spark, d):
    c = table(spark, d, "customer", "c_custkey AS k", "c_nationkey AS case_id")
    of = lambda n, name: c.filter(F.col("k") % n == 0).select("case_id", F.col("k").alias(name))
    cases = c.select("case_id").distinct().unionByName(spark.range(1).selectExpr("CAST(1000 AS BIGINT) AS case_id"))
    v = evaluate.document_views(cases, of(2, "snapshot_id"), of(3, "assessment_id"), of(5, "comparison_id"))
    return v.select(F.col("case_id").cast("long").alias("case_id"), F.size("snapshots").cast("long").alias("snapshots"), F.size("assessments").cast("long").alias("assessments"), F.coalesce(F.get("comparisons", F.lit(0)).cast("long"), F.lit(-1)).alias("first_comparison"))


@query("""
WITH b AS (SELECT source AS s, d.doc_id AS p, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT * FROM b WHERE p % 7 <> 0 OR s = 'src1')
SELECT b.s AS assessment_id, count(r.p) AS reviews, count(*) - count(r.p) AS pending, CASE WHEN count(*) > count(r.p) THEN 'review_required' WHEN bool_and(r.quality = 1) THEN 'passed' ELSE 'failed' END AS quality_status,
    '/api/v1/evaluations/assessments/' || b.s || '/pages/3/assets/source' AS url FROM b LEFT JOIN r ON b.p = r.p GROUP BY b.s""")
def assessment_views(spark, d):
    b = table(spark, d, "documents", "doc_id", "source AS assessment_id").join(table(spark, d, "labels"), "doc_id")
    a = b.groupBy("assessment_id").agg(F.lit("engineering_chain").alias("profile"), F.collect_list(F.col("doc_id").cast("int")).alias("pages"), F.lit(None).cast("double").alias("minimum_average"))
    r = b.filter("doc_id % 7 <> 0 OR assessment_id = 'src1'").select("assessment_id", F.col("doc_id").cast("int").alias("page_no"), F.when(F.col("quality") == 1, "pass").otherwise("failed").alias("verdict"), F.lit(None).cast("map<string,int>").alias("scores"), F.lit(None).cast("array<string>").alias("critical_errors"), F.lit(1).alias("seq"))
    return evaluate.assessment_views(a, r).select("assessment_id", "reviews", F.size("pending_review_pages").cast("long").alias("pending"), "quality_status", evaluate.asset_url("assessments", F.col("assessment_id"), F.lit(3), "source").alias("url"))


@query("""
WITH l AS (SELECT source AS s, d.doc_id AS p, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT s AS comparison_id, count(quality) AS reviews, count(*) FILTER (p % 4 = 0 AND quality IS NULL) AS pending, 'b-' || s AS source_snapshot, 'c-' || s AS candidate_snapshot FROM l GROUP BY s""")
def comparison_views(spark, d):
    t = table(spark, d, "documents", "source AS comparison_id", "doc_id AS page_no", "doc_id % 4 = 0 AS changed")
    r = t.join(table(spark, d, "labels", "doc_id AS page_no", "quality"), "page_no").selectExpr("comparison_id", "page_no", "'equivalent' AS verdict", "1 AS seq")
    c = t.select("comparison_id").distinct().selectExpr("comparison_id", "concat('b-', comparison_id) AS baseline_snapshot_id", "concat('c-', comparison_id) AS candidate_snapshot_id")
    v = evaluate.comparison_views(c, t, r)
    return v.select("comparison_id", "reviews", F.size("pending_review_pages").cast("long").alias("pending"), evaluate.pane_snapshot(F.lit("source")).alias("source_snapshot"), evaluate.pane_snapshot(F.lit("candidate")).alias("candidate_snapshot"))


# ----------------------------------------------------------------- pruning


def _prunable(spark, d):
    o = table(spark, d, "orders")
    r = o.selectExpr("o_orderkey AS id", "'doc' AS document_id", "CASE o_orderstatus WHEN 'P' THEN 'parsing' ELSE 'parsed' END AS status", "CASE WHEN o_orderkey % 5 = 0 THEN 'pruned' END AS artifact_state", "CAST(NULL AS STRING) AS prune_summary")
    artifacts = table(spark, d, "lineitem", "l_orderkey AS run_id", "CASE WHEN l_linenumber = 1 THEN 'parse_manifest' ELSE 'page_json' END AS kind", "'h' AS content_hash", "CAST(l_quantity AS BIGINT) AS size_bytes", "l_orderkey * 10 + l_linenumber AS id")
    targets = o.selectExpr("o_orderkey AS id", "-o_orderkey AS pos")
    return r, artifacts, maintenance.prune_plan(targets.unionByName(targets.withColumn("pos", F.lit(0))), r, r.selectExpr("id", "document_id", "id % 7 = 0 AS is_current"), artifacts, "doc", 11)


MAY = "o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey <> 11"


@query(f"SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS reclaimable_bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {MAY}")
def reclaimable_bytes(spark, d):
    """Targets named twice count once."""
    return maintenance.reclaimable(_prunable(spark, d)[2])


@query(f"""
WITH p AS (SELECT 'op-1' AS operation_id, sha256(string_agg(o_orderkey, ',' ORDER BY -o_orderkey)) AS runs FROM orders WHERE {MAY}), q(operation_id, h, k, flaw) AS (VALUES ('op-1', 'h', '11', NULL), ('op-1', 'x', '11', 'mismatch'), ('op-1', 'h', NULL, 'mismatch'), ('op-2', 'h', '11', 'missing'), ('../op-1', 'h', '11', 'id'), ('', 'h', '11', 'id'))
SELECT q.operation_id, flaw, p.runs FROM q LEFT JOIN p ON q.operation_id = p.operation_id""")
def prune_operations(spark, d):
    made = maintenance.prune_operation(_prunable(spark, d)[2], "h", "11", "op-1")
    asked = spark.createDataFrame([("op-1", "h", "11"), ("op-1", "x", "11"), ("op-1", "h", None), ("op-2", "h", "11"), ("../op-1", "h", "11"), ("", "h", "11")], "operation_id string, document_hash string, keep_run_id string")
    found = maintenance.match_operation(made, asked)
    return found.join(made.select("operation_id", F.sha2(F.array_join("run_ids", ","), 256).alias("runs")), "operation_id", "left").select("operation_id", "flaw", "runs")


@query(f"""
WITH n AS (SELECT l_orderkey AS id, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS id, CASE WHEN {MAY} THEN 'pruned' WHEN o_orderkey % 5 = 0 THEN 'pruned' END AS artifact_state, CASE WHEN {MAY} THEN n END AS noted_pages, CASE WHEN {MAY} THEN b END AS noted_bytes, CASE WHEN {MAY} THEN 'available' WHEN o_orderkey % 5 = 0 THEN 'pruned' END AS state_after_roll_back, n AS artifacts_after_roll_back
FROM orders LEFT JOIN n ON o_orderkey = n.id""")
def pruned_and_rolled_back(spark, d):
    """Runs as pruning leaves them, with what their tombstones note, and as rolling it back does."""
    r, artifacts, plan = _prunable(spark, d)
    may = plan.filter("refusal IS NULL").select("id")
    p = table(spark, d, "lineitem", "l_orderkey AS run_id", "l_linenumber AS page_no", "'accepted' AS review_status")
    after, _, gone = maintenance.stage_prune(may, r, p, artifacts)
    back, rows = maintenance.roll_back(after, may, maintenance.drop_rows(artifacts, gone), gone)
    note = lambda k: F.get_json_object("prune_summary", f"$.{k}").cast("long")
    whole = rows.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("artifacts_after_roll_back"))
    out = after.select("id", "artifact_state", note("page_count").alias("noted_pages"), note("artifact_bytes").alias("noted_bytes"))
    return out.join(back.select("id", F.col("artifact_state").alias("state_after_roll_back")), "id").join(whole, "id", "left")
