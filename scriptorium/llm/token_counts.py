"""Token counts: an exact histogram of encoded lengths, and suffix sums over it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.byte_bpe import loaded
from scriptorium.llm.common import written

#: Lengths are summed in blocks of so many, so that no task sees all lengths of a corpus.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """n_tokens (long) of every row's whole text, without added tokens; null and empty texts have 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(vocabulary)
        for batch in batches:
            found = [len(encode(x.as_py() or "")) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens -> n_docs, from one n_tokens per document; partial counts are made before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each encoded length L that occurs, what a context limit of L tokens means.

    Columns: n_tokens (L), n_docs (documents of just that length), docs_at_least and
    tokens_at_least (documents of L tokens or more, and their tokens), total_docs,
    total_tokens, truncated_tokens (all tokens that remain when every document is cut
    to L) and quantile (the share of documents of at most L tokens).  Between two
    lengths that occur, the truncated total is linear in the limit, so these rows
    answer every limit exactly (see `truncated_total`).  An empty histogram gives no rows.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    # Two branches read the histogram; it is small, and what it is made of is not.
    h = written(histogram, "histogram").withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum(tokens).alias("b_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("b_docs").over(everything).alias("total_docs"),
        F.sum("b_tokens").over(everything).alias("total_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.join(blocks, "block")
        .withColumn("docs_at_least", F.col("docs_above") + F.sum("n_docs").over(down))
        .withColumn("tokens_at_least", F.col("tokens_above") + F.sum(tokens).over(down))
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            "total_docs",
            "total_tokens",
            (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
            ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        )
    )


def truncated_total(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """limits(context_limit long) -> context_limit, truncated_tokens: tokens left when every document is cut to the limit.

    The documents longer than a limit are those of the next greater length that occurs, which a window over
    lengths and limits finds; of rows there are as many as lengths and limits differ.
    """
    lengths = sums.select(F.col("n_tokens").alias("at"), F.lit(False).alias("asked"), "docs_at_least", "tokens_at_least", "total_tokens")
    none = F.lit(None).cast("long")
    asked = limits.select("context_limit").distinct()
    both = lengths.unionByName(asked.select(F.col("context_limit").alias("at"), F.lit(True).alias("asked"), *[none.alias(c) for c in lengths.columns[2:]]))
    after = Window.orderBy("at", F.col("asked").desc()).rowsBetween(1, Window.unboundedFollowing)
    every = Window.orderBy("at", F.col("asked").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    longer = F.first(F.when(~F.col("asked") & (F.col("docs_at_least") > 0), F.struct("at", "docs_at_least", "tokens_at_least")), ignorenulls=True).over(after)
    found = both.select("at", "asked", longer.alias("x"), F.max("total_tokens").over(every).alias("total")).where("asked")
    return found.select(
        F.col("at").alias("context_limit"),
        F.coalesce(F.col("total") - F.col("x.tokens_at_least") + F.col("at") * F.col("x.docs_at_least"), "total", F.lit(0)).alias("truncated_tokens"),
    )
