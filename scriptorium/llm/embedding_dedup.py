"""Embedding near-dedup: Int8 quantised tile products with rigorous error bounds.

A unit vector u is s * q + e with q in int8 and an error e whose norm is known, so
u . v differs from s_u s_v (q_u . q_v) by at most |s_u q_u| |e_v| + |e_u|.  Codes, scales
and norms are made once, and only they travel to the tiles.  Pairs that the bounds
settle, either way, are counted there; the vectors of the pairs in between, and only
they, are fetched for the same tiles and computed in double precision.

Equal vectors of a label are one class with a weight.  Classes of a label are dealt
into tiles at random and tiles meet in pairs, so a hot label is spread over many
tasks and no task holds more than two tiles; links are counted, never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import over_groups, written
from scriptorium.llm.graph import components, local_roots
from scriptorium.llm.vectors import LAST, usable

#: Pairs that are computed in full precision at once.
CHUNK = 1 << 15
NODE = "ord long, h1 long, h2 long"


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes of unit vectors, their scales, the norms of what the codes stand for, and the norms of the errors."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    shown = codes * scale[:, None]
    return codes, scale, np.linalg.norm(shown, axis=1), np.linalg.norm(units - shown, axis=1)


def _with_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        made = []
        for v in b["embedding"]:
            unit = np.asarray(v, np.float64)[None, :]
            codes, *numbers = quantised(unit / np.linalg.norm(unit))
            made.append((codes[0].tobytes(), *(float(x[0]) for x in numbers)))
        yield b.assign(**{n: [m[i] for m in made] for i, n in enumerate(("codes", "scale", "size", "error"))})


def settled(g: pd.DataFrame, left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (from left x right) that the int8 bounds cannot rule out, and whether they settle that the pair links."""
    codes = np.frombuffer(b"".join(g["codes"]), np.int8).reshape(len(g), -1)
    scale, size, error = (g[c].to_numpy() for c in ("scale", "size", "error"))
    exact = np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which the integer products are exact
    other = codes[right].astype(exact).T
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        about = (codes[rows].astype(exact) @ other) * scale[rows, None] * scale[None, right]
        slack = size[rows, None] * error[None, right] + error[rows, None] + 1e-9
        i, j = np.nonzero(about + slack >= threshold)
        yield rows[i], right[j], (about - slack)[i, j] >= threshold


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
    own, a, b = g["own"].to_numpy(), g["a"].iloc[0], g["b"].iloc[0]
    return np.flatnonzero(own == a), np.flatnonzero(own == b), a == b


def _counted(g: pd.DataFrame, i: np.ndarray, j: np.ndarray, asked: np.ndarray) -> pd.DataFrame | None:
    """Links of each class in a cell, weighed by the other's rows, the smallest class reached, and whether doubles are asked for."""
    w = g["weight"].to_numpy()
    links = (np.bincount(i, w[j], len(g)) + np.bincount(j, w[i], len(g))).astype(np.int64)
    root = local_roots(len(g), i, j)
    at = (links > 0) | asked
    keys = {c: g[c].to_numpy()[at] for c in ("label", "dim", "a", "b", "own")}
    node = {c: g[c].to_numpy() for c in ("ord", "h1", "h2")}
    reached = {f"r_{c}": x[root[at]] for c, x in node.items()}
    return pd.DataFrame({**keys, **{c: x[at] for c, x in node.items()}, "n": links[at], **reached, "asked": asked[at]}) if at.any() else None


CELL = "label string, dim int, a int, b int, own int, " + NODE
COUNTED = CELL + ", n long, r_ord long, r_h1 long, r_h2 long, asked boolean"


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings(vec_id, embedding, label).

    Two rows link if their labels are equal and not null, their vectors are equally
    long, and the cosine is at least `threshold`.  Null, zero and non-finite vectors
    link with nothing.  Repeated rows are vectors of their own.  component_id is the
    smallest vec_id reachable (a null id comes last), kept whether it is the row's own.
    """
    v = F.col("embedding").cast("array<double>")
    label = F.col("label").cast("string")
    fine = F.col("label").isNotNull() & usable(F.col("embedding")) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    named = embeddings.select(F.col("vec_id").cast("long"), label.alias("label"), F.when(fine, v).alias("embedding"))
    rows = written(
        named.select(
            "vec_id", F.coalesce("vec_id", F.lit(LAST)).alias("ord"), F.when(F.col("embedding").isNotNull(), F.col("label")).alias("label"), "embedding",
            F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")).alias("h1"),
            F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit(1), "embedding", "label")).alias("h2"),
        ),
        "vectors",
    )
    classes = rows.where("embedding IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("ord").alias("ord"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    numbers = "codes binary, scale double, size double, error double"
    schema = f"{NODE}, weight long, label string, dim int, embedding array<double>, {numbers}"
    ready = classes.select("ord", "h1", "h2", "weight", "label", F.size("embedding").cast("int").alias("dim"), "embedding")
    coded = written(ready.mapInPandas(_with_codes, schema), "codes")
    tiles = written(coded.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tiles")
    travels = ["ord", "h1", "h2", "weight", "codes", "scale", "size", "error"]
    dealt = (
        coded.select("label", "dim", *travels)
        .join(tiles, ["label", "dim"])
        .withColumn("own", F.pmod(F.xxhash64("h1", "h2"), F.col("tiles")).cast("int"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("label", "dim", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), "own", *travels)
    )
    cell = ["label", "dim", "a", "b"]

    def by_bounds(g: pd.DataFrame) -> pd.DataFrame | None:
        """What int8 settles; classes with a pair that it does not ask for their doubles."""
        g = g.sort_values(["ord", "h1", "h2"], ignore_index=True)
        left, right, alone = _sides(g)
        asked, sure = np.zeros(len(g), bool), [(np.zeros(0, np.int64),) * 2]
        for i, j, links in settled(g, left, right, threshold):
            once = i < j if alone else i != j
            sure.append((i[once & links], j[once & links]))
            asked[i[once & ~links]] = asked[j[once & ~links]] = True
        return _counted(g, *(np.concatenate(x) for x in zip(*sure, strict=True)), asked)

    def by_doubles(g: pd.DataFrame) -> pd.DataFrame | None:
        """The pairs that the bounds leave open, in double precision."""
        g = g.sort_values(["ord", "h1", "h2"], ignore_index=True)
        left, right, alone = _sides(g)
        vectors = np.stack(g["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(vectors, axis=1)
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j, links in settled(g, left, right, threshold):
            open_ = ~links & (i < j if alone else i != j)
            i, j = i[open_], j[open_]
            for c in range(0, len(i), CHUNK):
                p, q = i[c : c + CHUNK], j[c : c + CHUNK]
                near = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norms[p] * norms[q]) >= threshold
                found.append((p[near], q[near]))
        return _counted(g, *(np.concatenate(x) for x in zip(*found, strict=True)), np.zeros(len(g), bool))

    first = written(over_groups(dealt, cell, [], by_bounds, COUNTED), "bounds")
    wanted = first.where("asked").select(*cell, "own", "ord", "h1", "h2")
    fetched = wanted.join(coded.select(*travels, "embedding"), ["ord", "h1", "h2"]).select(*cell, "own", *travels, "embedding")
    second = over_groups(fetched, cell, [], by_doubles, COUNTED)
    met = written(first.unionByName(second).where("n > 0").select("ord", "h1", "h2", "n", "r_ord", "r_h1", "r_h2"), "links")
    counts = met.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    node = F.struct("ord", "h1", "h2").alias("u")
    of = components(met.select(node, F.struct(F.col("r_ord").alias("ord"), F.col("r_h1").alias("h1"), F.col("r_h2").alias("h2")).alias("v")))
    of = of.select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("component.ord").alias("first"))
    known = coded.select("h1", "h2", "weight", F.col("ord").alias("least")).join(counts, ["h1", "h2"], "left").join(of, ["h1", "h2"], "left")
    component = F.nullif(F.coalesce("first", "least", "ord"), F.lit(LAST))
    n_links = F.coalesce(F.coalesce("n", F.lit(0)) + F.col("weight") - 1, F.lit(0)).cast("long")
    return (
        rows.select("vec_id", "ord", "h1", "h2")
        .join(known, ["h1", "h2"], "left")
        .select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    )
