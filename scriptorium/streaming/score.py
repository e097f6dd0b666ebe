"""Documents scored as they arrive.  Scoring looks at one document at a time, so a stream has no state to keep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.sources.scratch import scratch
from scriptorium.operators import ensemble, signals

SCHEMA = "doc_id long, text string"


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of documents that arrive under `path`."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def sentence_risks(docs: DataFrame) -> DataFrame:
    """Each row's text taken as one sentence and scored by itself: stateless, in batches or streams."""
    return signals.scored_sentences(docs)


def score_stream(
    docs: DataFrame, out: str, checkpoint: str, as_of_year: int, sink: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Document scores of every micro-batch, appended as Parquet under `out` by batch; replayed batches overwrite themselves."""

    def write(batch: DataFrame, n: int) -> None:
        with scratch():
            scores = ensemble.document_scores(batch, as_of_year)
            if sink:
                sink(scores, n)
            else:
                scores.write.mode("overwrite").parquet(f"{out}/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
