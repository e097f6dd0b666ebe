"""Exact top-k search by a uniform threshold in three phases.

The components of the vectors are split into m lists that are stored and read apart,
so a list knows only partial scores.  First, every block of a list hands in its k best
partial scores of a query; the full scores of just those candidates are resolved, and the
k-th best is a safe cutoff.  With the cutoff sent back, a candidate can reach it only if
one of its partial scores reaches an m-th of it, so each list hands in the entries
that do, unless the rest of the candidate, as long as it is, cannot make up for what
lacks.  What a list did not hand in is below an m-th, which bounds every
score from above; the scores that all lists handed in raise the cutoff, and only
candidates whose bound still reaches it have their full scores resolved.

Partial scores may be negative, so a sum of some of them bounds nothing from below: that is
why the first cutoff is made of full scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import written
from scriptorium.llm.vectors import LAST, numbered, usable

KEYS = ["dim", "list", "qb", "cb"]
PAIR = ["q_rid", "q_ord", "c_rid", "c_ord"]
#: So many times k of what the blocks of a list hand in are resolved for the first cutoff.
DEEPER = 16
FOUND = "q_rid long, q_ord long, c_rid long, c_ord long, list int, part long"
#: Queries whose partial scores are in memory at once, against a block of candidates.
CHUNK = 256


class Phases(NamedTuple):
    """ranked: the result; entries: candidates that a list handed in for the cutoff; opened: those whose full scores were resolved after that."""

    ranked: DataFrame
    entries: DataFrame
    opened: DataFrame


def partial_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, exact (modulo 2^64 beyond the range of a long)."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if most < 2**53 else np.int64
    return (q.astype(kind) @ c.T.astype(kind)).astype(np.int64)


def _meet(asks: DataFrame, candidates: DataFrame, c_blocks: int, q_blocks: int, chosen) -> DataFrame:
    """Lists of blocks of queries and of candidates, cell by cell; `chosen` says which entries a list hands in."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(6)]
        if len(q) and len(c):
            held, c_ord, c_rid = np.stack(c["codes"].to_numpy()), c["ord"].to_numpy(), c["rid"].to_numpy()
            for at in range(0, len(q), CHUNK):
                some = q.iloc[at : at + CHUNK]
                q_ord, q_rid = some["ord"].to_numpy(), some["rid"].to_numpy()
                part = partial_scores(np.stack(some["codes"].to_numpy()), held)
                i, j = chosen(some, c, part, q_ord[:, None] != c_ord[None, :])
                for column, x in zip(columns, (q_rid[i], q_ord[i], c_rid[j], c_ord[j], some["list"].to_numpy()[i], part[i, j]), strict=True):
                    column.append(x)
        return pd.DataFrame({f.split()[0]: np.concatenate(x) for f, x in zip(FOUND.split(", "), columns, strict=True)})

    def over(df: DataFrame, name: str, blocks: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias(name)
        return df.select(*[F.col(x).alias(x) for x in df.columns], every)  # own names, also to Spark

    return over(asks, "cb", c_blocks).groupBy(*KEYS).cogroup(over(candidates, "qb", q_blocks).groupBy(*KEYS)).applyInPandas(run, FOUND)


def _resolved(pairs: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """`pairs` with the full scores, from the whole vectors of just these rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            score = [int(np.dot(x.astype(np.int64), y.astype(np.int64))) for x, y in zip(b["q_codes"], b["c_codes"], strict=True)]
            yield b[PAIR].assign(score=np.array(score, np.int64))

    q = queries.select(F.col("rid").alias("q_rid"), F.col("codes").alias("q_codes"))
    c = candidates.select(F.col("rid").alias("c_rid"), F.col("codes").alias("c_codes"))
    both = pairs.select(*PAIR).join(c, "c_rid").join(q, "q_rid").select(*PAIR, "q_codes", "c_codes")
    return both.mapInPandas(run, "q_rid long, q_ord long, c_rid long, c_ord long, score long")


def _lists(df: DataFrame, lists: int, *more: str) -> DataFrame:
    """A row for each list of a vector: its components there, and the length of all others, rounded up."""

    def one(i: int) -> F.Column:
        a, b = (F.floor(F.col("dim") * x / lists).cast("int") for x in (i, i + 1))
        others = F.concat(F.slice("codes", F.lit(1), a), F.slice("codes", b + 1, F.col("dim") - b))
        rest = F.sqrt(F.aggregate(others, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) * (1 + 1e-9)
        return F.struct(F.lit(i).alias("list"), F.slice("codes", a + 1, b - a).alias("codes"), rest.alias("rest"))

    return df.select("rid", "ord", "dim", *more, F.explode(F.array(*map(one, range(lists)))).alias("x")).select(
        "rid", "ord", "dim", *more, "x.list", "x.codes", "x.rest"
    )


def phases(embeddings: DataFrame, every: int, k: int, scale: int, lists: int, q_block: int, c_block: int) -> Phases:
    codes = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))
    ready = numbered(embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), codes.alias("codes")))
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("asks")
    rows = written(ready.select("rid", F.coalesce("vec_id", F.lit(LAST)).alias("ord"), asks, F.size("codes").alias("dim"), "codes"), "codes")
    size = F.greatest(F.array_max("codes"), -F.array_min("codes"))
    n, asked, most = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(size)).first()
    if (most or 0) < 1 << 31:
        rows = rows.withColumn("codes", F.col("codes").cast("array<int>"))
    q_blocks, c_blocks = max(1, math.ceil(asked / q_block)), max(1, math.ceil(n / c_block))
    queries = rows.where("asks").select("rid", "ord", "dim", "codes")

    # Of equal vectors, only the k best of k + 1 ids can be among any k best; a common vector is not compared more often than that.
    same = Window.partitionBy("h", "codes")
    few = (
        rows.withColumn("h", F.xxhash64("codes"))
        .withColumn("nth", F.dense_rank().over(same.orderBy("ord")))
        .where(F.col("nth") <= k + 1)
        .withColumn("again", F.row_number().over(Window.partitionBy("h", "codes", "ord").orderBy("rid")))
        .where(F.col("again") <= k)
    )
    candidates = written(few.select("rid", "ord", "dim", "codes"), "candidates")

    def block(blocks: int, name: str) -> F.Column:
        return F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int").alias(name)

    held = _lists(candidates, lists).select("*", block(c_blocks, "cb"))

    def best(q: pd.DataFrame, c: pd.DataFrame, part: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranked = np.where(other, part, np.iinfo(np.int64).min)
        top = np.argpartition(ranked, -min(k, ranked.shape[1]), axis=1)[:, -k:]
        taken = np.zeros(part.shape, bool)
        np.put_along_axis(taken, top, True, axis=1)
        return np.nonzero(taken & other)

    def sufficient(q: pd.DataFrame, c: pd.DataFrame, part: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cutoff = q["cutoff"].to_numpy()[:, None]
        least = cutoff - 1 - 1e-9 * np.abs(cutoff)  # whatever is rounded
        bound = part + q["rest"].to_numpy()[:, None] * c["rest"].to_numpy()[None, :]
        return np.nonzero((part >= -(-cutoff // lists)) & (bound >= least) & other)

    by_score = Window.partitionBy("q_rid").orderBy(F.desc("score"), "c_ord", "c_rid")
    of_list = Window.partitionBy("q_rid", "list").orderBy(F.desc("part"), "c_ord", "c_rid")
    asks = _lists(queries, lists).select("*", block(q_blocks, "qb"))
    local = _meet(asks, held, c_blocks, q_blocks, best).withColumn("place", F.row_number().over(of_list)).where(F.col("place") <= DEEPER * k)
    first = _resolved(local.select(*PAIR).distinct(), queries, candidates)
    cutoffs = first.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select(F.col("q_rid").alias("rid"), F.col("score").alias("cutoff"))
    lowest = F.lit(-(1 << 62)).cast("long")  # of queries with fewer than k candidates
    asking = written(queries.join(cutoffs, "rid", "left").withColumn("cutoff", F.coalesce("cutoff", lowest)), "cutoffs")

    found = _meet(_lists(asking, lists, "cutoff").select("*", block(q_blocks, "qb")), held, c_blocks, q_blocks, sufficient)
    summed = found.groupBy(*PAIR).agg(F.sum("part").alias("score"), F.count(F.lit(1)).cast("int").alias("seen"))
    entries = written(summed, "entries")
    whole = entries.where(F.col("seen") == lists)
    kth = whole.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("q_rid", F.col("score").alias("kth"))
    known = asking.select(F.col("rid").alias("q_rid"), "cutoff").join(kth, "q_rid", "left").select("q_rid", "cutoff", F.greatest("cutoff", "kth").alias("refined"))
    bound = F.col("score") + (F.lit(lists) - F.col("seen")) * (F.ceil(F.col("cutoff") / lists) - 1)
    able = written(entries.join(known, "q_rid").where(bound >= F.col("refined") - 1 - F.abs("refined") * 1e-9), "able")
    opened = able.where(F.col("seen") < lists)
    scores = able.where(F.col("seen") == lists).select(*PAIR, "score").unionByName(_resolved(opened, asking, candidates))
    ranked = scores.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    out = ranked.select(F.col("q_ord").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.nullif("c_ord", F.lit(LAST)).alias("vec_id"), "score")
    return Phases(out, entries, opened)


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, lists: int = 2, q_block: int = 1024, c_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query, all if there are fewer.

    Queries are the rows whose vec_id is divisible by `every`, candidates all rows of
    other ids; the score is the inner product of floor(scale * x) of both.  Ties go to
    the smaller id, null ids last.  Vectors that are null or hold null or non-finite
    components take no part; vectors of unequal length are not compared.  Repeated
    rows are rows of their own, also as queries.  Exact while scores fit a long.
    """
    return phases(embeddings, every, k, scale, lists, q_block, c_block).ranked
