"""Connected components of a table of links, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import dropped, written


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes, the smallest node reachable by the links a[i] - b[i]."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _with_least(pairs: DataFrame, n: int) -> DataFrame:
    """pairs(u, v) with m, the smallest v of the u.

    What a node's neighbours have in common is joined in two ways, so that no hub fills a task: nodes of more than a
    thousandth of all n pairs, of which there are at most a thousand, are broadcast; the others are shuffled.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    most = max(1000, n // 500)  # of up to 2 n pairs
    hubs = F.broadcast(least.where(F.col("degree") > most).select("u", "m"))
    others = pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("degree") <= most).select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(others)


def components(links: DataFrame) -> DataFrame:
    """links(u, v), of any type that orders -> node, component: the smallest node reachable, for every node of a link.

    Each round ties all neighbours of a node to the smallest of them, first the larger
    ones, then the smaller ones, until every node hangs on the root of its tree.
    Links from a node to itself and repeated links do no harm; without links there are no rows.
    The edges of a round are deleted once those of the next are written.
    """

    def state(e: DataFrame) -> tuple[int, int]:
        """How many edges there are, and nodes that keep them from being stars."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first())

    def large(e: DataFrame, n: int) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return _with_least(both, n).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        # no hubs here: a node has no more smaller neighbours than it had links to smaller ones
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        tied = down.join(down.groupBy("u").agg(F.min("v").alias("m")), "u")
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        return tied.select(F.explode(pairs).alias("e")).select("e.*").where("u <> v").distinct()

    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    n, loose = state(edges)
    while loose:
        new = written(small(large(edges, n)), "edges")
        n, loose = state(new)
        dropped(edges)
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
