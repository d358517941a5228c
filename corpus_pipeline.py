"""A corpus pipeline of five stages, each over all that its predecessor kept.

Every stage but the last takes and returns the columns of documents: quality rules drop rejected documents, the n-gram
Jaccard join keeps one document of each similarity class, PII replaces personal data, mixing repeats or drops documents
towards its sources' targets, and SentencePiece turns texts into ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import deduplicated
from tidemark.llm.pii import sanitise
from tidemark.llm.quality_rules import filter_quality
from tidemark.llm.sentencepiece_codec import encode
from tidemark.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise(docs, length="n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, name = encode(docs, check=False)
    ids = F.col(name)["ids"]
    return found.select("doc_id", "lang", "source", F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_tokens"), ids.alias("ids"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("private data", private), ("mixing", mixed), ("sentencepiece", encoded)]

#: No SQL: votes are fitted by expectation-maximisation and ids come from a vocabulary file; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
