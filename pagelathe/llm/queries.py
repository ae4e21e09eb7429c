"""One query for each training-data operator, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import binary_output, jaccard_join, langid, mixing, quality_rules, sentencepieces, sharding, substring_dedup, topk, toxicity, turn_trie, url_reputation, vector_codes
from pagelathe.llm.common import load

# ---------------------------------------------------------------- 1: mixing

MIX = mixing.Mix(weights={"domain": {"web": 3, "curated": 1}, "lang": {"en": 6, "de": 2}, "source": {"src0": 4}}, budget_pct=60, max_epochs=2, seed=17)


def domain_column():
    """The tables have no domain: half of the sources, by a digest of their name, stand for the web."""
    return F.when(F.substring(F.md5(F.coalesce("source", F.lit("")).cast("binary")), 1, 1) < "8", "web").otherwise("curated")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    slim = mixing.cut(mixing.slim_of(docs, domain_column()).drop("row"), "slim")
    leaves = mixing.plan(slim, MIX)
    return mixing.take(slim, leaves, MIX).select("doc_id", "domain", "lang", "source", "tokens", F.col("epochs").alias("whole_epochs"), F.col("part").alias("part_tokens"))


def _share_sql(src: str, parents: str, child: str, weight: str, name: str) -> str:
    p = f"PARTITION BY {parents} " if parents else ""
    o = f"{p}ORDER BY cap * 1000 // w, {child}"
    return f"""
{name}_w AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM {src}),
{name}_f AS (SELECT *, (budget - coalesce(sum(cap) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
      >= cap * sum(w) OVER ({o} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_ FROM {name}_w),
{name}_l AS (SELECT *, CAST(budget - coalesce(sum(cap) FILTER (full_) OVER ({p}), 0) AS BIGINT) AS left_, CAST(sum(w) FILTER (NOT full_) OVER ({p}) AS BIGINT) AS wall,
      CAST(coalesce(sum(w) FILTER (NOT full_) OVER ({o} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS wcum FROM {name}_f),
{name} AS (SELECT *, CASE WHEN full_ THEN cap ELSE least(left_ * wcum // wall - left_ * (wcum - w) // wall, cap) END AS quota FROM {name}_l)"""


OP1_SQL = f"""
WITH slim AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) * {MIX.max_epochs} AS BIGINT) AS cap FROM slim GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CAST(least(sum(sum(supply)) OVER () * {MIX.budget_pct} // 100, sum(sum(cap)) OVER ()) AS BIGINT) AS budget FROM leaf GROUP BY domain),
{_share_sql("dom", "", "domain", "CASE domain WHEN 'web' THEN 3 ELSE 1 END", "d")},
lng AS (SELECT l.domain, l.lang, CAST(sum(l.cap) AS BIGINT) AS cap, CAST(any_value(d.quota) AS BIGINT) AS budget FROM leaf l JOIN d ON l.domain = d.domain GROUP BY l.domain, l.lang),
{_share_sql("lng", "domain", "lang", "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 ELSE 1 END", "g")},
src AS (SELECT l.domain, l.lang, l.source, l.supply, l.cap, CAST(g.quota AS BIGINT) AS budget FROM leaf l JOIN g ON l.domain = g.domain AND l.lang = g.lang),
{_share_sql("src", "domain, lang", "source", "CASE source WHEN 'src0' THEN 4 ELSE 1 END", "s")},
q AS (SELECT domain, lang, source, CAST(coalesce(quota // nullif(supply, 0), 0) AS BIGINT) AS epochs, CAST(quota - coalesce(quota // nullif(supply, 0), 0) * supply AS BIGINT) AS rest FROM s),
o AS (SELECT slim.*, epochs, rest, sum(tokens) OVER (PARTITION BY slim.domain, slim.lang, slim.source ORDER BY md5('{MIX.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS before
    FROM slim JOIN q ON slim.domain = q.domain AND slim.lang = q.lang AND slim.source = q.source)
SELECT doc_id, domain, lang, source, tokens, epochs AS whole_epochs, CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS part_tokens FROM o"""

# --------------------------------------------------------- 2: exact top-k


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""

# ---------------------------------------------------------------- 3: toxicity


def text_id_crc():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic").filter(text_id_crc() % 5 != 0)
    return toxicity.train(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the lexicon is learned; tests hold the automaton against edit distances and the scores against held-out labels."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).select("row.doc_id", "score")
    return scored.select("doc_id", (text_id_crc() % 5 == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


# --------------------------------------------------------- 4: quality rules


#: A line is common above 10 documents and 1 % of its host's, or above 100 documents on any host (figures in the README); the pipeline's too.
LINES = {"line_min_docs": 10, "line_max_pct": 1, "line_max_docs": 100}


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_quality(load(spark, sf_dir, "documents", "doc_id", "text", "source"), **LINES)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def quality_sql(docs: str) -> str:
    """CTEs ending in ``quality``: rid, doc_id and the judgement of each row of docs."""
    return f"""
qd AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM {docs}),
qw AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM qd),
qi AS (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM qw WHERE len(w) >= 8),
qk AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i+7], chr(1))) AS c FROM qi),
qr AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM qk WHERE c > 1) GROUP BY rid),
qe AS (SELECT rid, host, unnest(ln) AS l FROM qw),
qn AS (SELECT rid, host, len(list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words, lower(regexp_replace(regexp_replace(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' ', 'g'), '^ | $', '', 'g'), '[0-9]', '0', 'g')) AS l FROM qe),
qc AS (SELECT host, l, count(DISTINCT rid) AS docs FROM qn GROUP BY host, l),
qh AS (SELECT host, count(*) AS n FROM qd GROUP BY host),
qx AS (SELECT qc.host, qc.l FROM qc JOIN qh ON qc.host IS NOT DISTINCT FROM qh.host WHERE docs > {LINES['line_min_docs']} AND docs * 100 > n * {LINES['line_max_pct']} OR docs > {LINES['line_max_docs']}),
ql AS (SELECT rid, sum(words) AS lost FROM qn JOIN qx ON qn.host IS NOT DISTINCT FROM qx.host AND qn.l = qx.l GROUP BY rid),
qa AS (SELECT qw.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, CAST(coalesce(qr.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS words_left
    FROM qw LEFT JOIN qr ON qw.rid = qr.rid LEFT JOIN ql ON qw.rid = ql.rid),
qb AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM qa),
quality AS (SELECT *, NOT base_failed AND words_left >= 20 AND 100 * words_left >= 30 * n_words AS kept FROM qb)"""


OP4_SQL = f"WITH {quality_sql('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left FROM quality"

# ------------------------------------------------------------- 5: SentencePiece


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: tests hold it against all segmentations by brute force, and every text against its decoding."""
    out = sentencepieces.encode(load(spark, sf_dir, "documents", "doc_id", "text"), piece_model(), n=4, ids=False)
    return out.select("row.doc_id", "encoded.n_tokens", "encoded.ids_crc32", F.transform("encoded.nbest", lambda x: x["score"]).alias("nbest_scores"), "encoded.round_trip")


# ------------------------------------------------------------------- 6: urls

RULES = [url_reputation.Rule("allow", "com/"), url_reputation.Rule("block", "example.com/en/"), url_reputation.Rule("allow", "www.example.com/en/"), url_reputation.Rule("block", "net/es/"), url_reputation.Rule("block", "net/fr/")]


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page (labels.doc_id is its page_id) came out well if its quality is 1 and it isn't toxic."""
    labels = load(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0).alias("good"))
    return url_reputation.judge_urls(load(spark, sf_dir, "pages", "page_id", "url"), outcomes, RULES)


def _strength_sql(level: str, name: str) -> str:
    return f"""
{name} AS (SELECT CASE WHEN min(rate) IS NULL OR min(rate) <= 0 OR min(rate) >= 1 OR count(*) < 2 OR coalesce(s, 0) <= 0.001 THEN 1000.0 ELSE floor(least(1000.0, greatest(1.0, (1 - s) / s)) + 0.5) END AS k FROM
    (SELECT rate, n, (sum(n * (good / n - rate) * (good / n - rate)) OVER () - (count(*) OVER () - 1) * rate * (1 - rate)) / nullif(sum(n) OVER () - sum(CAST(n AS DOUBLE) * n) OVER () / sum(n) OVER (), 0) / (rate * (1 - rate)) AS s
    FROM {level}, total WHERE n > 0) GROUP BY s)"""


OP6_SQL = f"""
WITH o AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix, count(good) AS n, CAST(coalesce(sum(good), 0) AS BIGINT) AS good FROM h LEFT JOIN o ON h.page_id = o.doc_id GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
total AS (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) AS rate FROM hosts),
{_strength_sql("suffixes", "k1")}, {_strength_sql("domains", "k2")}, {_strength_sql("hosts", "k3")},
m1 AS (SELECT suffix, (good + k * rate) / (n + k) AS m FROM suffixes, total, k1),
m2 AS (SELECT domain, (good + k * m) / (n + k) AS m FROM domains JOIN m1 USING (suffix), k2),
m3 AS (SELECT host, n, k, (good + k * m) / (n + k) AS m FROM hosts JOIN m2 USING (domain), k3),
b AS (SELECT host, n, m - 1.645 * sqrt(m * (1 - m) / (n + k + 1)) AS bound FROM m3),
r(pattern, verdict) AS (VALUES {", ".join(f"('{r.pattern}', '{r.verdict}')" for r in RULES)}),
f AS (SELECT page_id, arg_max(pattern, length(pattern)) AS rule, arg_max(verdict, length(pattern)) AS ruled FROM h JOIN r ON (host = split_part(pattern, '/', 1) OR ends_with(host, '.' || split_part(pattern, '/', 1))) AND starts_with(path, substr(pattern, instr(pattern, '/'))) GROUP BY page_id)
SELECT h.page_id, h.host, path, rule, coalesce(ruled, CASE WHEN bound >= 0.6 THEN 'allow' ELSE 'block' END) AS verdict, n AS host_labelled, round(bound, 6) AS posterior_bound
FROM h JOIN b ON h.host = b.host LEFT JOIN f ON h.page_id = f.page_id"""

# ------------------------------------------------------------ 7: Jaccard join


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL within reach on whole tables (all pairs): tests hold it against brute force."""
    return jaccard_join.count_links(load(spark, sf_dir, "documents", "doc_id", "text"))


# --------------------------------------------------------------- 8: sharding

SHARDS, SLOTS = [f"shard-{i:03d}" for i in range(96)], 65537


def op8_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(load(spark, sf_dir, "documents", "doc_id", "text", "source"), "doc_id", SHARDS, SLOTS)
    return placed.select("row.doc_id", "row.source", "slot", "shard", F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("n_bytes"))


def op8_sql() -> str:
    table = "".join(f"{i:02x}" for i in sharding.build_table(SHARDS, SLOTS))
    return f"""
WITH s AS (SELECT doc_id, source, text, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, source, slot, CAST('0x' || substr('{table}', slot * 2 + 1, 2) AS INTEGER) AS shard, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM s"""


# ------------------------------------------------------------ 9: language ID


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the filters are learned; tests hold it against a plain set-based version and held-out accuracy."""
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.filter(text_id_crc() % 3 != 1))
    return langid.predict(docs, model).select("doc_id", (text_id_crc() % 3 == 1).alias("held_out"), "lang_pred", "score")


# --------------------------------------------------- 10: token-ID binary output


def op10_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: encoding isn't expressible; tests hold it against the library's own encoding of whole texts."""
    import public_tokenizers

    manifest = binary_output.write_records(load(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return binary_output.read_records(spark, manifest, ids=False)


# ------------------------------------------------------------ 11: vector codes


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every distance in whole numbers; ties by index."""
    whole = "list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT))"
    out = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, {whole} AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, k, e[k * (len(e) // {parts}) + 1 : (k + 1) * (len(e) // {parts})] AS x FROM v, range({parts}) t(k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS i, x AS c FROM p WHERE r <= {entries})"""
    for n in range(rounds + 1):
        out += f""",
a{n} AS MATERIALIZED (SELECT r, k, (best).i AS i, (best).d AS d FROM (SELECT p.r, p.k, min({{'d': CAST(list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j]))) AS BIGINT), 'i': i}}) AS best FROM p JOIN b{n} b ON p.k = b.k GROUP BY p.r, p.k))"""
        if n < rounds:
            out += f""",
s{n} AS (SELECT k, i, j, CAST(floor(CAST(sum(x[j]) AS DECIMAL(38, 0)) / count(*)) AS BIGINT) AS m FROM (SELECT p.k, i, x, unnest(range(1, len(x) + 1)) AS j FROM p JOIN a{n} a ON p.r = a.r AND p.k = a.k) GROUP BY k, i, j),
b{n + 1} AS MATERIALIZED (SELECT b.k, b.i, coalesce(new.c, b.c) AS c FROM b{n} b LEFT JOIN (SELECT k, i, list(m ORDER BY j) AS c FROM s{n} GROUP BY k, i) new ON b.k = new.k AND b.i = new.i)"""
    return f"""{out},
f AS (SELECT r, string_agg(format('{{:02x}}', i), '' ORDER BY k) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY k, i)) FROM b{rounds}) AS codebooks_sha256
FROM f JOIN v ON f.r = v.r"""


# --------------------------------------------------------- 12: substring dedup


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(load(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP12_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT r, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS x FROM d WHERE len(w) >= 20),
k AS (SELECT r, i, row_number() OVER (PARTITION BY x ORDER BY r, i) AS nth FROM i),
c AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS j FROM k WHERE nth > 1),
x AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
o AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN c USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON d.r = o.r"""


# ------------------------------------------------- 13: conversation prefix trie


def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_trie.turns_of(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return turn_trie.build(turn_trie.share_heads(turns))


def _crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of ASCII text, by bits: DuckDB has no such function."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: {byte}), 4294967295)"


OP13_SQL = f"""
WITH h AS (SELECT conv_id, {_crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS MATERIALIZED (SELECT t.conv_id, list_concat(coalesce(g.t, [])[1:h.h], t.t[h.h + 1:]) AS t FROM t JOIN h ON t.conv_id = h.conv_id LEFT JOIN t g ON g.conv_id = t.conv_id - t.conv_id % 100),
x AS MATERIALIZED (SELECT conv_id, len(t) AS n, d, md5(CAST(t[1:d] AS VARCHAR)) AS key, CASE WHEN d > 0 THEN md5(CAST(t[1:d - 1] AS VARCHAR)) END AS up, CASE WHEN d > 0 THEN length(t[d].text) ELSE 0 END AS size FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM b)),
node AS MATERIALIZED (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM x GROUP BY d, key),
kid AS MATERIALIZED (SELECT d - 1 AS d, up AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(kid.n, 0) AS n_children FROM node LEFT JOIN kid ON node.d = kid.d AND node.key = kid.key),
below AS (SELECT x.d, x.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.size) AS saved FROM full_ f JOIN x ON x.conv_id = f.conv_id AND x.d <= f.d GROUP BY x.d, x.key)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(below.n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below ON f.d = below.d AND f.key = below.key LEFT JOIN node p ON p.d = f.d - 1 AND p.key = f.up"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_exact_topk": op2_exact_topk,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_url_reputation": op6_url_reputation,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_shard_placement": op8_shard_placement,
    "op9_language_id": op9_language_id,
    "op10_binary_records": op10_binary_records,
    "op11_vector_codes": op11_vector_codes,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_turn_trie": op13_turn_trie,
}


def oracles() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op2_exact_topk": OP2_SQL, "op4_quality_rules": OP4_SQL, "op6_url_reputation": OP6_SQL, "op8_shard_placement": op8_sql(), "op11_vector_codes": op11_sql(), "op12_substring_dedup": OP12_SQL, "op13_turn_trie": OP13_SQL}
