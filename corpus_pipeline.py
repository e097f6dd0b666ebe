"""From raw documents to packed training sequences; every stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import stages
from scriptorium.llm.common import written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", stages.good_quality),
    ("n-gram Jaccard join", stages.one_of_each),
    ("secret scans", stages.secrets_masked),
    ("best-fit packing", stages.sequences),
]

#: Models, similarity joins and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "documents")
    return STAGES[-1][1](spark, docs, sf_dir)
