"""Quality rules: measures of each text, and the frequency of its lines across the documents of its host.

DataFrame functions only. Defined results: a null text is an empty one; a null source is a host of its own; repeated
rows are documents of their own; an empty table gives no rows; very long texts, lines and runs of blanks are measured
whole, in time n log n; extra columns are ignored or, in ``keep_good`` and ``clean_good``, returned as they came.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.common import SPACE, content_key, cut, join_hot

#: Words in a window, a power of two: windows are hashed by doubling.
WINDOW = 8
#: The characters of SPACE.
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Words; trimming and splitting take time in proportion to the text, long runs of blanks too."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def normal_line(line: Column) -> Column:
    """Lower case, white space as one blank, digits as 0."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), f"{SPACE}+", " "), "[0-9]", "0"))


def _pairs(hashes: str, apart: int) -> Column:
    """Hashes of each element and the one so many places on (null behind the end, which a hash passes over)."""
    return F.zip_with(hashes, F.slice(hashes, apart + 1, F.greatest(F.size(hashes), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def measure(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) to one row each with the base measures and the lines' hashes and word counts.

    A row keeps no text: it identifies its document by doc_id and a content key. Repeated windows are found by sorting
    the hashes of a text's windows, so a text costs n log n in its own length and stays in its task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", F.col("source").alias("host"), content_key("doc_id", "source", "text").alias("key"), text.alias("text"))
    a = a.select("doc_id", "host", "key", "text", words_of(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("ln"))
    n = F.size("w")
    # A window's hash is that of its halves' hashes, so each word is hashed once and each window in three steps.
    a = a.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    for apart in (1 << i for i in range(WINDOW.bit_length() - 1)):
        a = a.select("doc_id", "host", "key", "text", "w", "ln", _pairs("h", apart).alias("h"))
    a = a.select(
        "doc_id", "host", "key", n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.slice("h", 1, F.greatest(n - (WINDOW - 1), F.lit(0))).alias("h"),
        F.transform("ln", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("hash"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))).alias("lines"),
    )
    keep = [c for c in a.columns if c != "h"]
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    a = a.select(*keep, F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none).alias("s"))
    same = lambda e, k: F.coalesce(F.get("s", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("s", k + 1)["h"] == e["h"], F.lit(False))
    a = a.select(*keep, F.array_sort(F.transform(F.filter("s", same), lambda e: e["i"])).alias("p"))
    covered = F.aggregate(F.transform("p", lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get("p", k + 1) - v, F.lit(WINDOW)))), F.lit(0), lambda x, y: x + y)
    return a.select(*keep, covered.cast("long").alias("n_repeat_words"))


def _judged(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, line_min_docs: int = 10, line_max_pct: int = 10, min_left_pct: int = 30, line_max_docs: int | None = None) -> DataFrame:
    """judge_quality's rows, and common: the hashes of the document's common lines (null if it has none)."""
    a = cut(measure(docs).withColumn("rid", F.monotonically_increasing_id()), "quality")
    # A host's null is a value of its own; the count of documents is small, one row a host.
    n = a.count()
    hosts = cut(a.groupBy(F.col("host").alias("h")).agg(F.count(F.lit(1)).alias("host_docs")), "hosts")
    lines = a.select("host", F.explode(F.array_distinct(F.col("lines.hash"))).alias("hash"))
    common = cut(lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > line_min_docs), "often")
    over = F.col("docs") * 100 > F.col("host_docs") * line_max_pct
    over = over if line_max_docs is None else over | (F.col("docs") > line_max_docs)
    common = join_hot(common, hosts, F.col("host").eqNullSafe(F.col("h")), "host_docs", n).filter(over)
    common = cut(common.select(F.col("host").alias("chost"), F.col("hash").alias("chash"), "docs"), "common")
    each = a.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", F.col("line.hash").alias("hash"), F.col("line.words").alias("words"))
    met = join_hot(each, common, F.col("host").eqNullSafe(F.col("chost")) & (F.col("hash") == F.col("chash")), "docs", n)
    lost = met.select("rid", "hash", "words").groupBy("rid").agg(F.sum("words").alias("lost"), F.collect_set("hash").alias("common"))
    out = a.drop("lines").join(lost, "rid", "left").withColumn("words_left", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    good = (F.col("words_left") >= min_words) & (100 * F.col("words_left") >= min_left_pct * F.col("n_words"))
    return out.select("doc_id", "key", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_left", failed.alias("base_failed"), (~failed & good).alias("kept"), "common")


def judge_quality(docs: DataFrame, **limits) -> DataFrame:
    """One row a document: base measures, base_failed, words_left after common lines go, kept; with doc_id and key.

    A line is too common on its host when more than line_min_docs documents and more than line_max_pct percent of the
    host's documents hold it; or, with line_max_docs, when more than so many do (and line_min_docs), however large the
    host is. A document is depleted when fewer than min_words words, or fewer than min_left_pct percent of its words, are
    left. Without line_max_docs both limits are shares, so verdicts don't drift as a corpus grows.
    A hot host or line is no single task's work: counts are summed before the shuffle, and hot keys are joined by broadcast.
    """
    return _judged(docs, **limits).drop("common")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns."""
    out = judge_quality(docs, **limits).filter(~F.col("kept")).select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), content_key("doc_id", "source", "text").alias("key"))
    return rows.join(out, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key")), "left_anti").select("row.*")


def clean_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that judge_quality keeps, with all their columns, but without their host's common lines.

    The other lines stay as they are, blank ones too; n_chars, where docs has it, follows the text.
    """
    out = _judged(docs, **limits).filter(~F.col("kept") | F.col("common").isNotNull())
    out = out.select(F.col("doc_id").alias("told_id"), F.col("key").alias("told_key"), "kept", "common").dropDuplicates(["told_id", "told_key"])
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), content_key("doc_id", "source", "text").alias("key"))
    rows = rows.join(out, F.col("id").eqNullSafe(F.col("told_id")) & (F.col("key") == F.col("told_key")), "left").filter(F.coalesce("kept", F.lit(True)))
    stays = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~F.array_contains("common", F.xxhash64(normal_line(x)))
    text = F.when(F.col("common").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split("row.text", "\n"), stays), "\n"))
    rows = rows.select("row", "common", text.alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("common").isNull(), F.col("row")["n_chars"]).otherwise(F.length("clean")) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])
