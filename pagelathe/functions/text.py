"""Text normalisation, page splitting and table reading, as column expressions.

Python's idea of white space is wider than Java's ``\\s``: the class below lists it. Unicode NFC has no built-in in Spark
and runs as one Arrow function; leave it out (``nfc=False``) where texts are known to be composed.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the characters that Python's str.strip() removes.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the characters at which Python's str.splitlines() ends a line.
LINE_ENDS = "\\n-\\r\\x1c-\\x1e\\x85\\u2028\\u2029"
BLANKS = "".join(filter(str.isspace, map(chr, range(0x3001))))
QUOTE_CHARS, EVIDENCE_CHARS, SPAN_CHARS, CONTEXT_CHARS = 240, 300, 1000, 160
BLOCK = "struct<kind:string,content:string,latex:string,quote:string,order_no:int,bbox:array<double>,confidence:double,source:string>"


def nfc(text: Column) -> Column:
    @F.arrow_udf("string")
    def compose(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    # ASCII is composed as it is: only other texts go through Python.
    return F.coalesce(compose(F.when(text.rlike("[^\\x00-\\x7f]"), text)), text)


def composed(df: DataFrame, column: str) -> DataFrame:
    """df with all texts of a nested column in NFC: an Arrow function can't run within a lambda, so the whole goes through it as JSON, whose own signs NFC leaves alone."""
    ddl = df.schema[column].dataType.simpleString()
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.from_json(nfc(F.to_json(column)), ddl)))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def or_default(text: Column, default: str) -> Column:
    """The text, or the default where it is null or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def normalize_text(text: Column, nfc_form: bool = True) -> Column:
    """NFC, line ends as LF, no white space at line ends, none around the whole; null is empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    out = F.regexp_replace(nfc(out) if nfc_form else out, "\\r\\n?", "\n")
    # A run is tried once, from its beginning, and never given back in part: linear in the text's length.
    inner = f"[{SPACE}&&[^\\n]]"
    return strip(F.regexp_replace(out, f"(?<!{inner}){inner}++(?=\\n|\\z)", ""))


def normalize_latex(text: Column, nfc_form: bool = True) -> Column:
    return F.regexp_replace(normalize_text(text, nfc_form), f"[{SPACE}]+", "")


def table_matrix(text: Column, nfc_form: bool = False) -> Column:
    """Rows of trimmed cells of the lines that hold a bar; rows of dashes and colons only are rulers and go."""
    lines = F.filter(F.split(normalize_text(text, nfc_form), "\n"), lambda x: x.contains("|"))
    inner = lambda x: F.btrim(strip(x), F.lit("|"))
    rows = F.transform(lines, lambda x: F.transform(F.split(inner(x), "\\|"), strip))
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-{3,}:?\\z")))


def paragraphs(markdown: Column) -> Column:
    parts = F.transform(F.split(strip(F.coalesce(markdown, F.lit(""))), f"\\n[{SPACE}]*\\n"), strip)
    return F.filter(parts, lambda x: x != "")


def paragraph_kind(text: Column) -> Column:
    """text: one without white space around it. White space and digits are those of Unicode, in the number of a heading too."""
    first = strip(F.regexp_extract(text, f"^[^{LINE_ENDS}]*", 0))
    display = F.startswith(text, F.lit("$$")) & F.endswith(text, F.lit("$$"))
    inline = F.startswith(text, F.lit("$")) & F.endswith(text, F.lit("$")) & ~text.contains("\n")
    return F.when((F.length(text) <= 100) & first.rlike(f"^\\p{{Nd}}+(\\.\\p{{Nd}}+)+[{SPACE}]+[^{SPACE}]"), "heading").when(display | inline, "formula").otherwise("paragraph")


def markdown_blocks(markdown: Column) -> Column:
    """Blocks of a page of which only Markdown is known: kinds by form, confidence 0.7, no boxes."""
    latex = lambda x: strip(F.btrim(x, F.lit("$")))
    return F.transform(
        paragraphs(markdown),
        lambda x, i: F.struct(
            paragraph_kind(x).alias("kind"), x.alias("content"), F.when(paragraph_kind(x) == "formula", latex(x)).alias("latex"), F.left(x, F.lit(QUOTE_CHARS)).alias("quote"),
            i.cast("int").alias("order_no"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(0.7).alias("confidence"), F.lit(None).cast("string").alias("source"),
        ),
    )


def split_errors(text: Column) -> Column:
    """Critical errors as typed by a reviewer: parted by semicolons of either width."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[;；]"), strip), lambda x: x != "")
