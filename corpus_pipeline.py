"""A corpus pipeline: five stages over documents, each calling one operator, each written as Parquet and read again.

Defined results, of every stage: a null text is an empty one; null ids, languages and sources are values of their own;
repeated rows are documents of their own; texts are taken whole, however long; an empty table gives an empty one; extra
columns are handed on, but for those that the last stage names itself (ids, n_tokens, nbest), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import jaccard_join, mixing, quality_rules, sentencepieces, toxicity
from pagelathe.llm.common import load, new_path
from pagelathe.llm.queries import LINES, MIX, domain_column, piece_model, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon finds likelier toxic than not go; null and empty texts stay."""
    return toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).filter("score < 0.5").select("row.*")


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are depleted without their host's common lines, go; so do those lines of the others."""
    return quality_rules.clean_good(docs, **LINES)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join stays: of ties (equal ids) one row; documents without words are linked with none."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each domain, language and source to its share of the tokens; a document appears once for each epoch that takes it."""
    return mixing.repeat_rows(mixing.mix_documents(docs, domain_column(), MIX))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its token ids and its best segmentations."""
    new = ("ids", "n_tokens", "nbest")
    out = sentencepieces.encode(docs, piece_model(), n=4)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in new], *[F.col("encoded")[c].alias(c) for c in new])


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("jaccard_join", drop_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: Toxicity is learned and segmentations are searched, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
