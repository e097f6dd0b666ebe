"""The stages of the corpus pipeline; all but packing take and return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard, packing, quality, secrets
from scriptorium.llm.common import table
from scriptorium.llm.registry import BYTE_BPE


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier does not reject (score >= 0.3)."""
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), most=4000)
    return quality.scored(docs, model, "__score").where(F.col("__score") >= 0.3).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return jaccard.distinct_documents(docs, threshold=0.8)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return secrets.without_secrets(docs, secrets.corpus_model(docs, table(spark, sf_dir, "labels")))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 1024 tokens."""
    return packing.packed(docs, BYTE_BPE, size=1024, end_id=2)
