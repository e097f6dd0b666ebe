"""The queries of this subpackage: one per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import chat, embedding_dedup, jaccard, licenses, packing, quality, secrets, token_counts, topk, word_bpe
from scriptorium.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), BYTE_BPE, size=1024, end_id=2)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.quality_model(docs, table(spark, sf_dir, "labels"), most=4000)
    return quality.judged(docs, model, threshold=0.3)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_probe(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.rendered(chat.events_of(rows)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(table(spark, sf_dir, "documents"), BYTE_BPE)
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"), threshold=0.8)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(table(spark, sf_dir, "documents"), threshold=0.8)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.encoded_digests(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.corpus_model(docs, table(spark, sf_dir, "labels"))
    return secrets.span_report(secrets.scanned_secrets(docs, model))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_exact_top_k, op3_quality_classifier, op4_embedding_dedup, op5_chat_formatting, op6_token_counts, op7_ngram_jaccard_join, op8_license_scans, op9_bpe_codec, op10_secret_scans]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
