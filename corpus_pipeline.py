"""Corpus pipeline over ``documents``: quality, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the
last return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder and reads it again for the next one, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import jaccard_join, line_dedup, packing, quality
from folioflow.llm.common import Scratch, staging, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; the labels are those of the tables."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so does a document that consists of them. n_chars follows the text."""
    cleaned = line_dedup.line_dedup(docs)
    left = cleaned.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents, packed."""
    return packing.documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", pack),
]
#: No stage but line dedup and packing's cutting could be put in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with staging():  # what a stage leaves behind goes when its result is written
            docs = scratch.put(stage(spark, docs, sf_dir), name)
    return docs
