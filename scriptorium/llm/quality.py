"""Quality classifier: supervised subword embeddings.

Every word, pair of words (also: of equal words, whichever) and run of 3 to 5 characters within a word (with its
boundaries) is hashed to a learned vector; a document is the mean of its vectors,
and a softmax over two outputs scores it.  Trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.vectext import Hashed, mixed, portions, white_space

BUCKETS = 1 << 17


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of some texts; white space only bounds words, letter case counts.

    Every text has one feature of its own that all share, so an empty one has a vector too.
    """
    h = Hashed(texts)
    inside = ~white_space()
    a, b = h.words(inside)
    text = h.text_of(a)
    word = h.spans(a, b)
    found, of = [mixed(np.full(len(texts), np.uint64(7))), word], [np.arange(len(texts)), text]
    if len(word) > 1:
        same = text[1:] == text[:-1]
        found.append(mixed(word[:-1] * np.uint64(3) + word[1:])[same])
        of.append(text[1:][same])
        again = (word[1:] == word[:-1]) & same  # the pair's pattern, whatever the word
        found.append(mixed(np.full(again.sum(), np.uint64(11))))
        of.append(text[1:][again])
    blank = ~inside[h.codes]
    gaps = np.concatenate([[0], np.cumsum(blank)])
    owner = np.full(len(h.codes), -1, np.int64)
    owner[h.starts[h.ends > h.starts]] = np.flatnonzero(h.ends > h.starts)
    owner = np.maximum.accumulate(owner)
    for n in (3, 4, 5):
        at = np.arange(len(h.codes) - n + 1)
        at = at[gaps[at + n - 1] == gaps[at + 1]]  # no white space but at the two ends
        found.append(h.spans(at, at + n))
        of.append(owner[at + 1])  # white space as in a space: the code of other white space hashes differently, which is harmless
    return (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int32), np.concatenate(of)


@dataclass
class Model:
    """The trained output for each bucket: what its vector adds to the log-odds of label 1, and a bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each whole text.  The output is linear in the mean, so vectors are applied to it once."""
        out = np.zeros(len(texts))
        i = 0
        for part in portions(iter(texts)):
            bucket, text = features(part)
            n = np.bincount(text, minlength=len(part))
            out[i : i + len(part)] = np.bincount(text, self.weight[bucket], minlength=len(part)) / n
            i += len(part)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -50, 50)))


def trained(texts: list[str], labels: list[int], width: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> Model:
    """Stochastic gradient descent over single documents, with a rate that falls to 0; the same for the same rows in order.

    Classes weigh alike in all.  Without rows of both classes the score is the share of label 1 (1 without rows).
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 30.0 if not len(y) or y[0] else -30.0)
    rng = np.random.default_rng(seed)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for part in portions(iter(texts)):
        bucket, text = features(part)
        key, count = np.unique(text.astype(np.int64) * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(key // BUCKETS, np.arange(1, len(part)))
        for k, c in zip(np.split(key % BUCKETS, cuts), np.split(count, cuts), strict=True):
            bags.append((k.astype(np.int32), (c / c.sum()).astype(np.float32)))
    vectors = rng.uniform(-1 / width, 1 / width, (BUCKETS, width)).astype(np.float32)
    out = np.zeros((2, width), np.float32)
    bias = np.zeros(2, np.float32)
    weigh = len(y) / (2 * np.bincount(y, minlength=2))
    steps, done = epochs * len(y), 0
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            bucket, share = bags[i]
            hidden = share @ vectors[bucket]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= rate * weigh[y[i]] * (1 - done / steps)
            back = p @ out
            out -= p[:, None] * hidden
            bias -= 0.1 * p
            vectors[bucket] -= share[:, None] * (back * np.float32(min(len(bucket), 50)))  # buckets of a bag are distinct; a mean gives each little
            done += 1
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether crc32(doc_id as text) mod `folds` is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, label, text of at most `most` labelled rows outside the held-out fold, chosen by a hash of their ids.

    Rows with a null id or label take no part; of several labels of an id the greatest counts.
    The ids are chosen first, so that only their texts are moved.
    """
    one = F.col(label).cast("int")
    usable = labels.where(F.col("doc_id").isNotNull() & one.isin(0, 1) & ~held_out()).select("doc_id", one.alias("label"))
    chosen = usable.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """`docs` with the score of each whole text; null text is empty.  A column of that name is replaced."""
    docs = docs.drop(score)
    weight, bias = docs.sparkSession.sparkContext.broadcast(model.weight), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weight.value, bias)
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column("__text")]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(own.scores(texts), pa.float64())], [*names, score])

    names = docs.columns
    fields = docs.schema.add(score, "double")
    return docs.select("*", F.col("text").cast("string").alias("__text")).mapInArrow(run, fields)


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000) -> Model:
    """Trained in one task, on at most `most` rows in the order of their ids; see `training_rows`.  Only weights reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            labels += batch.column("label").to_pylist()
        model = trained(texts, labels)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    rows = training_rows(docs, labels, label, most).repartition(1).sortWithinPartitions("doc_id")
    found = rows.mapInArrow(run, "weight binary, bias double").collect()
    if not found:  # Spark leaves out tasks over tables that it knows to be empty
        return trained([], [])
    return Model(np.frombuffer(found[0]["weight"], np.float32), found[0]["bias"])


def judged(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold)."""
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
