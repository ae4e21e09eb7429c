"""Calling injected parsers and extractors over pages and documents. Nothing here opens a connection.

Answers are kept by (run, page, attempt) before anything is derived from them, and calls are counted from what was kept,
so a task that runs twice doesn't count twice. Switch speculation off around these functions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class PageParser(Protocol):
    """image, text layer, page number to an answer's text."""

    def __call__(self, image: bytes | None, raw_text: str, page_no: int) -> str: ...


class Extractor(Protocol):
    """A document's text to nodes and edges."""

    def __call__(self, markdown: str) -> dict: ...


class Retryable(Exception):
    """Time-outs, lost connections, too many requests and server errors: worth another attempt."""


class InvalidPage(Exception):
    """An answer that is no page; worth another attempt, its text is kept."""

    def __init__(self, message: str, response: str = "") -> None:
        super().__init__(message)
        self.response = response


@dataclass(frozen=True)
class Limits:
    attempts: int = 3
    calls: int = 60
    backoff: float = 0.0


def is_retryable_status(status: int | None) -> bool:
    """Whether a response of that status (None: no response) deserves another attempt."""
    return status is None or status == 429 or status >= 500


def backoff_seconds(base: float, attempt: int) -> float:
    return base * 2**attempt


ANSWERS = "run_id string, page_no int, attempt int, response string, error string, outcome string"


def call_parser(granted: DataFrame, parser: PageParser, limits: Limits, check: Callable[[str], None] | None = None) -> DataFrame:
    """granted: run_id, page_no, image, raw_text, attempt. One call a row: response, error, outcome (ok, retry or failed).

    check raises InvalidPage for an answer that won't do.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for run_id, page_no, image, raw, attempt in b[["run_id", "page_no", "image", "raw_text", "attempt"]].itertuples(index=False, name=None):
                again = "failed" if attempt >= limits.attempts else "retry"
                try:
                    answer = parser(image, raw or "", page_no)
                    if check:
                        check(answer)
                    out.append((run_id, page_no, attempt, answer, None, "ok"))
                except InvalidPage as e:
                    out.append((run_id, page_no, attempt, e.response, str(e)[:1000], again))
                except Retryable as e:
                    out.append((run_id, page_no, attempt, None, str(e)[:1000], again))
                except Exception as e:  # anything else is final for the page
                    out.append((run_id, page_no, attempt, None, f"{type(e).__name__}: {e}"[:1000], "failed"))
            yield pd.DataFrame(out, columns=["run_id", "page_no", "attempt", "response", "error", "outcome"])

    return granted.mapInPandas(run, ANSWERS)


def open_pages(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages that have no final answer among answers (of this request), with the number of their next attempt."""
    asked = answers.filter("outcome <> 'budget'").groupBy("run_id", "page_no").agg(F.max("attempt").alias("_asked"), F.bool_or(F.col("outcome") != "retry").alias("_done"))
    df = pages.join(asked, ["run_id", "page_no"], "left").filter(~F.coalesce("_done", F.lit(False)))
    return df.withColumn("attempt", (F.coalesce("_asked", F.lit(0)) + 1).cast("int")).drop("_asked", "_done")


def grant(pages: DataFrame, made: DataFrame, limits: Limits) -> DataFrame:
    """The open pages that get a call in this round: the first of each run, as many as calls are left to it.

    made: all calls so far, those of earlier requests too. Only as many pages of a run as its whole budget meet to be numbered.
    """
    used = made.filter("outcome <> 'budget'").groupBy("run_id").agg(F.count(F.lit(1)).alias("_used"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("page_no"))
    first = pages.withColumn("_place", place).filter(F.col("_place") <= limits.calls)
    return first.join(used, "run_id", "left").filter(F.col("_place") <= limits.calls - F.coalesce("_used", F.lit(0))).drop("_place", "_used")


def call_in_rounds(pages: DataFrame, made: DataFrame, parser: PageParser, limits: Limits, path: str, check: Callable[[str], None] | None = None) -> DataFrame:
    """Answers for pages (run_id, page_no, image, raw_text) within each run's budget of calls really made.

    A round gives every open page, in page order, one call while its run has calls left, and is written to path before the
    next one is dealt; so pages that need no second attempt leave their calls to others, and there are no more rounds than
    attempts. Pages that get no answer for want of calls end with a row of outcome budget. Rounds that are at path already
    count: a request that was cut off goes on where it stood (calls of a round that wasn't written are made again).
    """
    spark = pages.sparkSession
    answers = lambda: spark.read.schema(ANSWERS).parquet(path)
    spark.createDataFrame([], ANSWERS).write.mode("append").parquet(path)
    for attempt in range(limits.attempts):
        so_far = answers()
        todo = open_pages(pages, so_far).filter(F.col("attempt") <= limits.attempts)
        todo = grant(todo, made.select(*so_far.columns).unionByName(so_far), limits)
        if attempt and so_far.filter("outcome = 'retry'").isEmpty():
            break
        if attempt and limits.backoff:
            time.sleep(backoff_seconds(limits.backoff, attempt - 1))
        call_parser(todo, parser, limits, check).write.mode("append").parquet(path)
    told = answers()
    left = open_pages(pages, told).join(told.filter("outcome = 'budget'").select("run_id", "page_no"), ["run_id", "page_no"], "left_anti")
    short = left.select("run_id", F.col("page_no").cast("int").alias("page_no"), "attempt", F.lit(None).cast("string").alias("response"), F.lit("call budget").alias("error"), F.lit("budget").alias("outcome"))
    short.write.mode("append").parquet(path)
    return answers()


def calls_made(answers: DataFrame) -> DataFrame:
    return answers.filter("outcome <> 'budget'").groupBy("run_id").agg(F.countDistinct("page_no", "attempt").alias("model_calls"))


def final_answers(answers: DataFrame) -> DataFrame:
    """The last attempt of each page."""
    last = F.row_number().over(Window.partitionBy("run_id", "page_no").orderBy(F.desc("attempt")))
    return answers.withColumn("_n", last).filter("_n = 1").drop("_n")


def extract(documents: DataFrame, extractor: Extractor) -> DataFrame:
    """documents: document_id, text. The extractor's nodes and edges with their places, one row a document."""
    schema = "document_id string, nodes array<struct<kind:string,title:string,content:string,evidence_quote:string>>, edges array<struct<source_title:string,target_title:string,relation:string,evidence_quote:string>>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pick = lambda x, keys: {k: None if x.get(k) is None else str(x[k]) for k in keys}
        for b in batches:
            out = []
            for doc, text in zip(b["document_id"], b["text"], strict=True):
                try:
                    found = extractor(text)
                    found = json.loads(found) if isinstance(found, str) else found
                    nodes = [pick(x, ("kind", "title", "content", "evidence_quote")) for x in found.get("nodes") or []]
                    edges = [pick(x, ("source_title", "target_title", "relation", "evidence_quote")) for x in found.get("edges") or []]
                    out.append((doc, nodes, edges, None))
                except Exception as e:
                    out.append((doc, None, None, f"{type(e).__name__}: {e}"[:1000]))
            yield pd.DataFrame(out, columns=["document_id", "nodes", "edges", "error"])

    return documents.select("document_id", "text").mapInPandas(run, schema)
