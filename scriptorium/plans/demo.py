"""The texts that the queries run on: the documents, with phrases put in by rule.

The tables hold invented words, so almost no lexical rule would fire on them.  One
expression, the same in any SQL, adds to each text what its id calls for; every
document takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BR, TAB = "chr(10)", "chr(9)"
TEXT = f"""CASE doc_id % 7
WHEN 0 THEN 'Furthermore, it is important to note that teams often leverage robust tools; a myriad of options exist. ' || text
WHEN 1 THEN text || {BR} || {BR} || 'References' || {BR} || 'Moreover, this study delves into a plethora of sources (Smith, 2020).'
WHEN 2 THEN 'Abstract' || {BR} || 'This study aims to contribute evidence on cost. It turns out that cost matters recently.' || {BR} || '4. Results' || {BR} || text
WHEN 3 THEN text || {BR} || 'Scores rose by 140% in 2021 (Lee, 2019). Studies show that cost is often lower, and beta = 1.2 was always clearly reported by us all.'
WHEN 4 THEN text || {BR} || 'Site' || {TAB} || '12' || {TAB} || '30'
WHEN 5 THEN text || {BR} || 'Scores vary — a point worth stating — across sites; some rose; some fell. Scores vary again across sites here. Scores vary again across many years. Not only cost is seen but also time.'
ELSE text END"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.expr(TEXT).alias("text"))


#: Doubles of a labelled row, in any SQL, for the queries of the calibration operators.
FEATURES = {
    "length_k": "n_chars / 1000.0e0",
    "lines_n": "cast(length(text) - length(replace(text, chr(10), '')) AS double)",
    "stops_share": "(length(text) - length(replace(text, '.', ''))) * 100.0e0 / greatest(1, n_chars)",
    "marks_share": "(length(text) - length(replace(replace(replace(text, '*', ''), '#', ''), '|', ''))) * 100.0e0 / greatest(1, n_chars)",
}
#: A fixed logistic model over them.
WEIGHTS = {"length_k": 0.05, "lines_n": 0.02, "stops_share": 0.4, "marks_share": -0.9}
BIAS = 0.3


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label (quality), lang, source, and the features, of every labelled document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    columns = [F.expr(x).alias(k) for k, x in FEATURES.items()]
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "lang", "source", *columns)


def model() -> dict:
    names = list(FEATURES)
    return {"model_type": "logistic", "feature_names": names, "means": dict.fromkeys(names, 1.0), "scales": dict.fromkeys(names, 2.0), "weights": WEIGHTS, "bias": BIAS}
