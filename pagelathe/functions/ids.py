"""Stable identifiers, digests and path checks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions.text import SPACE, nfc, strip

#: Characters that file names can't hold.
UNSAFE = '[<>:"/\\\\|?*\\x00-\\x1f]'


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9a-f]{64}\\z"), F.lit(False))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, UNSAFE, ""), f"[{SPACE}]+", "-"), "^[ .-]+|[ .-]+\\z", "")


def case_id(title: Column, content_hash: Column, nfc_form: bool = True) -> Column:
    """Readable name of a document plus twelve digits of its hash; null for a hash that isn't one."""
    name = F.regexp_extract(title, "([^/]*)/*\\z", 1)
    stem = F.regexp_replace(name, "(?<=[^.])\\.[^.]+\\z", "")
    text = F.left(F.regexp_replace(_dashed(nfc(stem) if nfc_form else stem), "-+", "-"), F.lit(48))
    text = F.regexp_replace(text, "[ .-]+\\z", "")
    return F.when(is_sha256(content_hash), F.concat(F.when(text == "", "document").otherwise(text), F.lit("--"), F.left(content_hash, F.lit(12))))


def is_case_id(value: Column, content_hash: Column, nfc_form: bool = True) -> Column:
    """Whether a case id is in normal form and belongs to the hash."""
    title = F.regexp_extract(value, "(?s)^(.*)--", 1)
    return F.coalesce(~value.isin("", ".", "..") & ~value.rlike("[/\\\\]") & (case_id(title, content_hash, nfc_form) == value), F.lit(False))


def safe_label(text: Column, limit: int = 32, nfc_form: bool = True) -> Column:
    """A label fit for file names; null where nothing is left."""
    out = _dashed(nfc(strip(text)) if nfc_form else strip(text))
    return F.nullif(F.regexp_replace(F.left(out, F.lit(limit)), "[ .-]+\\z", ""), F.lit(""))


def digest(*parts: Column, digits: int = 64) -> Column:
    """First digits of the SHA-256 of the parts, joined by NUL."""
    return F.left(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(digits))


def snapshot_id(label: Column, commit: Column, run_id: Column, nfc_form: bool = True) -> Column:
    return F.when(commit.rlike("^[0-9a-f]{7,64}\\z"), F.concat_ws("-", safe_label(label, 32, nfc_form), F.left(commit, F.lit(12)), digest(run_id, digits=8)))


def assessment_id(snapshot: Column, experiment: Column, nfc_form: bool = True) -> Column:
    return F.concat_ws("-", F.lit("assessment"), safe_label(experiment, 32, nfc_form), digest(snapshot, experiment, digits=12))


def comparison_id(case: Column, baseline: Column, candidate: Column) -> Column:
    return F.concat(F.lit("comparison-"), digest(case, baseline, candidate, digits=16))


def input_version(content_hash: Column, model: Column, start: Column, end: Column, contract: Column, max_tokens: Column, attempts: Column, call_limit: Column) -> Column:
    """Identity of a parse request; its budget is the pages times attempts, within the overall limit."""
    budget = F.least(call_limit, (end - start + 1) * attempts)
    return F.concat_ws(":", content_hash, model, F.concat_ws("-", start, end), contract, max_tokens, attempts, budget)


def is_safe_relative(path: Column) -> Column:
    """A relative path that stays below its root and uses no reserved characters."""
    bad = path.rlike("^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|\\z)|[\\x00-\\x1f<>:\"|?*]")
    return F.coalesce((path != "") & ~bad, F.lit(False))


def is_safe_component(name: Column) -> Column:
    return is_safe_relative(name) & ~name.rlike("[/\\\\]") & ~name.isin(".", "..")


def is_revision(commit: Column, dirty: Column, diff_hash: Column) -> Column:
    """A commit of 7 to 64 hex digits; uncommitted changes need the hash of their diff."""
    return F.coalesce(F.lower(commit).rlike("^[0-9a-f]{7,64}\\z"), F.lit(False)) & (~F.coalesce(dirty, F.lit(False)) | is_sha256(diff_hash))


def data_url(content: Column, mime: Column) -> Column:
    # Spark breaks the text into lines, which an address must not have.
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)\\z", 1))
    known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "json": "application/json", "md": "text/markdown", "pdf": "application/pdf", "txt": "text/plain", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
    out = F.lit("application/octet-stream")
    for k, v in known.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
