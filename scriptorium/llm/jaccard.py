"""N-gram Jaccard join: a MinHash LSH forest with exact verification.

A document is the set of its runs of five words (letters, digits and underscores,
in lower case); one with one to four words has the one run of them all, and one
without words that is not empty has itself.  Texts of equal sets are one class, and
only one of each class goes on.

Each of a number of trees has eight minimum hashes of a class; sorted, they are a prefix trie,
and a class matches its neighbours in the sorting as far as their longest common
prefix reaches.  Classes that share all eight are candidates first.  Then matched prefixes
are shortened, two hashes at a time, each only if the run of classes that it then leads
to is not connected yet, and down to the depth at which a pair right at the
threshold is found with the target recall.

Candidates whose signatures agree far too seldom for the threshold are let go; the
rest are verified exactly.  They are not listed in pairs: a run hands on a tree
of links, the classes it connects are brought together once with their sets, in
tiles of bounded size, and every pair among them is counted there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.columns import row_keys
from scriptorium.llm.common import dropped, over_groups, small_enough, written
from scriptorium.llm.graph import components, local_roots
from scriptorium.llm.vectext import Hashed, mixed, portions, word_characters
from scriptorium.llm.vectors import LAST

WORDS = 5
#: Minimum hashes of a tree are kept in 16 bits each, four to a long.
TREES, DEPTH = 24, 8
#: So many hashes a prefix is shortened by at a time.
SHORTER = 2
#: Signatures may agree this much less often than the threshold says (over five standard deviations of all 192 hashes).
MARGIN = 0.16
#: Members of a run, and classes and their shingles, that meet in a task: at most two tiles.
BUCKET_TILE, SET_TILE, SHINGLE_TILE = 1024, 512, 400_000


def shortest(threshold: float, recall: float, trees: int = TREES) -> int:
    """The depth, from the full one down, at which `trees` tries find a pair at the threshold with `recall`."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def shingle_sets(texts: list[str], size: int = WORDS) -> list[np.ndarray]:
    """Sorted hashes of the distinct runs of `size` words of each text; of fewer words, one run of them all; without words, the whole text, if not empty."""
    out: list[np.ndarray] = []
    at = 0
    for part in portions(t.lower() for t in texts):
        h = Hashed(part)
        a, b = h.words(word_characters())
        word, text = h.spans(a, b), h.text_of(a)
        first = np.searchsorted(text, np.arange(len(part) + 1))
        run = np.zeros(max(0, len(word) - size + 1), np.uint64)
        for k in range(size):
            run = mixed(run * np.uint64(31) + word[k : k + len(run)])
        for i, j, text in zip(first[:-1], first[1:], texts[at : at + len(part)], strict=True):
            if j - i >= size:
                out.append(np.unique(run[i : j - size + 1]))
            elif j > i:
                one = np.uint64(j - i)
                for w in word[i:j]:
                    one = mixed(one * np.uint64(31) + w)
                out.append(np.array([one], np.uint64))
            else:
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                out.append(np.frombuffer(digest if text else b"", np.uint64))
        at += len(part)
    return out


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The minimum of the set under each of the hash functions; the set must not be empty."""
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):  # long texts in bounded memory
        least = np.minimum(least, (high[at : at + 1024, None] * multipliers[None, :]).min(axis=0))
    return least


def multipliers(n: int) -> np.ndarray:
    return (mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def classes_of(docs: DataFrame, trees: int = TREES, size: int = WORDS) -> DataFrame:
    """k1, k2 (of the row), ord (its id, null last), c1, c2 (of its set; null if empty), n, hi, lo (of each tree's hashes the first and the last four), bytes (a byte of each hash)."""
    schema = "k1 long, k2 long, ord long, c1 long, c2 long, n int, hi array<long>, lo array<long>, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = multipliers(trees * DEPTH)
        places = np.array([48, 32, 16, 0], np.uint64)
        for batch in batches:
            rows: list[tuple] = []
            for s in shingle_sets([x.as_py() or "" for x in batch.column("text")], size):
                if not len(s):
                    rows.append((None, None, 0, None, None, None))
                    continue
                least = mixed(signature(s, functions).astype(np.uint64))
                packed = ((least >> np.uint64(48)).reshape(trees, 2, 4) << places).sum(axis=2).view(np.int64)
                c = np.array([mixed(s + np.uint64(1)).sum(), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()]).view(np.int64)
                rows.append((int(c[0]), int(c[1]), len(s), packed[:, 0], packed[:, 1], (least >> np.uint64(56)).astype(np.uint8).tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(3)] + made, [f.split()[0] for f in schema.split(", ")])

    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord")
    return docs.select(*row_keys(), ord_, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def common_prefix(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """How many hashes, from the first on, each row shares with the next one."""

    def leading(x: np.ndarray) -> np.ndarray:
        return sum((x < np.uint64(1 << b)).astype(np.int32) for b in (48, 32, 16, 0))

    first = leading((hi[1:] ^ hi[:-1]).view(np.uint64))
    return np.where(first == 4, 4 + leading((lo[1:] ^ lo[:-1]).view(np.uint64)), first)


def tries(reps: DataFrame, floor: int) -> DataFrame:
    """tree, hi, lo, ord, c1, deep: the sorted tries, without classes whose longest match is below `floor`.

    deep: the longest common prefix with a neighbour.  The tries are sorted by ranges, so a prefix that many
    classes share is spread over tasks; a neighbour beyond the end of a range counts as a full match,
    which makes a row stay that may have none.
    """
    names = ["tree", "hi", "lo", "ord", "c1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        before = DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(n).to_numpy() for n in names]
            if last is not None:
                rows = [np.concatenate(x) for x in zip(last, rows, strict=True)]
            shared = np.where(rows[0][1:] == rows[0][:-1], common_prefix(rows[1], rows[2]), 0)
            prefixes = np.concatenate([[before], shared])
            deep = np.maximum(prefixes[:-1], shared)
            at = deep >= floor
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:-1][at]) for x in rows), pa.array(deep[at].astype(np.int32))], [*names, "deep"])
            last, before = [x[-1:] for x in rows], prefixes[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([*map(pa.array, last), pa.array(np.array([DEPTH], np.int32))], [*names, "deep"])

    spread = reps.select(F.posexplode(F.arrays_zip("hi", "lo")).alias("tree", "x"), "ord", "c1").select("tree", "x.hi", "x.lo", "ord", "c1")
    return spread.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(run, "tree int, hi long, lo long, ord long, c1 long, deep int")


def prefix(depth: int) -> list[F.Column]:
    """The first `depth` hashes of a tree, as two longs."""
    hi = F.shiftrightunsigned("hi", 16 * (4 - depth)) if depth < 4 else F.col("hi")
    lo = F.shiftrightunsigned("lo", 16 * (DEPTH - depth)) if depth > 4 else F.lit(0).cast("long")
    return [hi.alias("p1"), lo.alias("p2")]


def run_links(members: DataFrame, reps: DataFrame, least_share: float) -> DataFrame:
    """u, v: components so far that pairs of likely enough signatures in a run connect, each tied to the smallest.

    members(tree, p1, p2, tiles, ord, c1, f_ord, f_c1): a run has tree, p1 and p2 in common, and is dealt
    into `tiles`; f_ord and f_c1 name the component that the class is of.
    """
    run = ["tree", "p1", "p2", "a", "b"]
    dealt = (
        members.join(reps.select("ord", "c1", "bytes"), ["ord", "c1"])
        .withColumn("own", F.pmod(F.xxhash64("ord", "c1"), F.col("tiles")).cast("int"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("tree", "p1", "p2", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), "f_ord", "f_c1", "bytes")
    )
    # equal bytes are equal minima but for one in 256
    enough = least_share + (1 - least_share) / 256

    def tie(g: pd.DataFrame) -> pd.DataFrame | None:
        n = len(g)
        if n < 2:
            return None
        order = np.lexsort((g["f_c1"].to_numpy(), g["f_ord"].to_numpy()))
        sig = np.frombuffer(b"".join(g["bytes"]), np.uint8).reshape(n, -1)[order]
        o, c = g["f_ord"].to_numpy()[order], g["f_c1"].to_numpy()[order]
        own = np.concatenate([[0], np.cumsum((o[1:] != o[:-1]) | (c[1:] != c[:-1]))])  # the smallest component comes first
        first = np.searchsorted(own, np.arange(own[-1] + 1))
        waiting, links, todo = np.arange(n), [], []
        while len(waiting):
            if not todo:
                todo, waiting = [waiting[0]], waiting[1:]
            x = todo.pop()
            near = (sig[waiting] == sig[x]).sum(axis=1) >= enough * sig.shape[1]
            links += [(own[x], own[y]) for y in waiting[near] if own[x] != own[y]]
            todo += list(waiting[near])
            waiting = waiting[~near]
        if not links:
            return None
        root = local_roots(len(first), *np.array(links).T)
        moved = np.flatnonzero(root != np.arange(len(first)))
        i, j = first[moved], first[root[moved]]
        return pd.DataFrame({"u_ord": o[i], "u_c1": c[i], "v_ord": o[j], "v_c1": c[j]})

    tied = over_groups(dealt, run, [], tie, "u_ord long, u_c1 long, v_ord long, v_c1 long")
    u = F.struct(F.col("u_ord").alias("ord"), F.col("u_c1").alias("c1")).alias("u")
    return tied.select(u, F.struct(F.col("v_ord").alias("ord"), F.col("v_c1").alias("c1")).alias("v")).distinct()


def candidates(reps: DataFrame, threshold: float, recall: float, trees: int = TREES) -> DataFrame:
    """node, component: of the classes, those that candidate pairs connect, by the smallest of each component.

    Goes through depths of the forest, from the full one down to that of the target recall.  A run of classes that share a
    prefix is looked at only if it holds classes of more than one component so far: what it would add otherwise is verified anyway.
    """
    floor = shortest(threshold, recall, trees)
    forest = written(tries(reps, floor), "tries")
    found = written(components(reps.select(F.struct("ord", "c1").alias("u"), F.struct("ord", "c1").alias("v")).limit(0)), "found")
    for depth in (*range(DEPTH, floor, -SHORTER), floor):
        known = found.select(F.col("node.ord").alias("ord"), F.col("node.c1").alias("c1"), F.col("component.ord").alias("f_ord"), F.col("component.c1").alias("f_c1"))
        matched = forest.where(F.col("deep") >= depth).select("tree", *prefix(depth), "ord", "c1").join(known, ["ord", "c1"], "left")
        matched = matched.withColumns({"f_c1": F.when(F.col("f_ord").isNull(), F.col("c1")).otherwise(F.col("f_c1")), "f_ord": F.coalesce("f_ord", "ord")})
        label = F.xxhash64("f_ord", "f_c1")
        runs = matched.groupBy("tree", "p1", "p2").agg(F.ceil(F.count(F.lit(1)) / BUCKET_TILE).cast("int").alias("tiles"), F.min(label).alias("x"), F.max(label).alias("y"))
        members = matched.join(runs.where("x <> y").select("tree", "p1", "p2", "tiles"), ["tree", "p1", "p2"])
        links = written(run_links(members, reps, threshold - MARGIN), "links")
        if not links.isEmpty():
            new = components(links).select(F.col("node").alias("component"), F.col("component").alias("moved"))
            before = found.join(new, "component", "left").select("node", F.coalesce("moved", "component").alias("component"))
            alone = new.join(found.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("moved").alias("component"))
            old, found = found, written(before.unionByName(alone), "found")
            dropped(old)
        dropped(links)
    dropped(forest)
    return found


def shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes each of left shares with each of right."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code, times = np.unique(every, return_inverse=True, return_counts=True)
    often = times[code] > 1  # what only one set holds is shared with none
    column = np.cumsum(times > 1) - 1
    code, owner = column[code[often]], owner[often]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [start, start + width])
        held = []
        for side, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, width), np.float32)
            at = place[side, owner[a:b]]
            m[at[at >= 0], code[a:b][at >= 0] - start] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out


def verified(docs: DataFrame, groups: DataFrame, threshold: float, size: int = WORDS) -> DataFrame:
    """ord, c1, n, r_ord, r_c1: for a class and a tile, the weight of the classes it links with there, and the smallest class reached.

    groups: k1, k2 (of a row of the class), ord, c1, n (shingles), weight, group.  Each group's classes meet in tiles.
    """
    fill = F.greatest(F.count(F.lit(1)) / SET_TILE, F.sum(F.col("n").cast("long")) / SHINGLE_TILE)
    sized = groups.groupBy("group").agg(F.ceil(fill).cast("int").alias("tiles"))
    wanted = small_enough(groups.select("k1", "k2", "ord", "c1", "weight", "group"))
    texts = docs.select(*row_keys(), F.col("text").cast("string").alias("text")).join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets([x.as_py() or "" for x in batch.column("text")], size)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), sets], [*kept, "set"])

    kept = ["ord", "c1", "weight", "g_ord", "g_c1"]
    flat = texts.select("text", "ord", "c1", "weight", F.col("group.ord").alias("g_ord"), F.col("group.c1").alias("g_c1"))
    hashed = flat.mapInArrow(sets_of, "ord long, c1 long, weight long, g_ord long, g_c1 long, set binary")
    tiles = sized.select(F.col("group.ord").alias("g_ord"), F.col("group.c1").alias("g_c1"), "tiles")
    dealt = (
        hashed.join(tiles, ["g_ord", "g_c1"])
        .withColumn("own", F.pmod(F.xxhash64("ord", "c1"), F.col("tiles")).cast("int"))
        .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("g_ord", "g_c1", F.least("own", "met").alias("a"), F.greatest("own", "met").alias("b"), "own", "ord", "c1", "weight", "set")
    )

    def meet(g: pd.DataFrame) -> pd.DataFrame | None:
        if len(g) < 2:
            return None
        g = g.sort_values(["ord", "c1"], ignore_index=True)
        own, a, b = g["own"].to_numpy(), g["a"].iloc[0], g["b"].iloc[0]
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        if not len(left) or not len(right):
            return None
        sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
        lengths = np.array([len(s) for s in sets])
        both = shared_counts(sets, left, right).astype(np.int64)
        i, j = np.nonzero(both >= threshold * (lengths[left][:, None] + lengths[right][None, :] - both) - 1e-9)
        i, j = left[i], right[j]
        once = i < j if a == b else i != j
        i, j = i[once], j[once]
        if not len(i):
            return None
        w, n = g["weight"].to_numpy(), len(g)
        links = np.bincount(i, w[j], n) + np.bincount(j, w[i], n)
        root = local_roots(n, i, j)
        at = links > 0
        o, c = g["ord"].to_numpy(), g["c1"].to_numpy()
        return pd.DataFrame({"ord": o[at], "c1": c[at], "n": links[at].astype(np.int64), "r_ord": o[root[at]], "r_c1": c[root[at]]})

    return over_groups(dealt, ["g_ord", "g_c1", "a", "b"], [], meet, "ord long, c1 long, n long, r_ord long, r_c1 long")


def near_copies(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99999, size: int = WORDS, trees: int = TREES) -> DataFrame:
    """k1, k2, ord, c1, c2, weight, n_links, first: every row of docs(doc_id, text) with the links of its class.

    k1 and k2 are `row_keys` of the row.  weight: rows of the class; n_links: other rows whose
    Jaccard similarity is at least `threshold`, those of the class included; first (struct
    ord, k1, k2): the first row, by id, of all that links reach.  Rows without words link with
    those of the same text; null and empty texts link with nothing.  Repeated rows are rows of their own.
    """
    docs = docs.select("doc_id", "text")
    rows = written(classes_of(docs, trees, size), "rows")
    whole = rows.where("c1 IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("n", "hi", "lo", "bytes")]
    reps = whole.groupBy("c1", "c2").agg(F.min(F.struct("ord", "k1", "k2")).alias("row"), F.count(F.lit(1)).alias("weight"), *first)
    reps = written(reps.select("c1", "c2", "row", F.col("row.ord").alias("ord"), "weight", "n", "hi", "lo", "bytes"), "classes")
    near = candidates(reps, threshold, recall, trees)
    groups = near.select(F.col("node.ord").alias("ord"), F.col("node.c1").alias("c1"), F.col("component").alias("group")).join(
        reps.select("ord", "c1", "n", "weight", F.col("row.k1").alias("k1"), F.col("row.k2").alias("k2")), ["ord", "c1"]
    )
    met = written(verified(docs, written(groups, "groups"), threshold, size), "links")
    counts = met.groupBy("ord", "c1").agg(F.sum("n").alias("n"))
    of = components(met.select(F.struct("ord", "c1").alias("u"), F.struct(F.col("r_ord").alias("ord"), F.col("r_c1").alias("c1")).alias("v")))
    of = of.select(F.col("node.ord").alias("ord"), F.col("node.c1").alias("c1"), F.col("component.ord").alias("f_ord"), F.col("component.c1").alias("f_c1"))
    heads = reps.select(F.col("ord").alias("f_ord"), F.col("c1").alias("f_c1"), F.col("row").alias("first"))
    linked = counts.join(of, ["ord", "c1"]).join(heads, ["f_ord", "f_c1"])
    known = reps.select("c1", "c2", "ord", "weight", "row").join(linked.select("ord", "c1", "n", "first"), ["ord", "c1"], "left")
    per_class = known.select("c1", "c2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "row").alias("first"))
    return (
        rows.select("k1", "k2", "ord", "c1", "c2")
        .join(per_class, ["c1", "c2"], "left")
        .select(
            "k1", "k2", "ord", "c1", "c2",
            F.coalesce("weight", F.lit(1)).alias("weight"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.coalesce("first", F.struct("ord", "k1", "k2")).alias("first"),
        )
    )


def joined(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links, kept: for every row, the smallest doc_id that links reach, and the number of other rows it links with.

    A null id comes last; kept says whether the row is the first of its class.
    """
    found = near_copies(docs, threshold)
    first = F.col("first")
    return found.select(
        F.nullif("ord", F.lit(LAST)).alias("doc_id"),
        F.nullif(first["ord"], F.lit(LAST)).alias("class_id"),
        "n_links",
        ((first["k1"] == F.col("k1")) & (first["k2"] == F.col("k2"))).alias("kept"),
    )


def distinct_documents(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`docs` with one row of each class of near copies, the first by id; of rows of one id and text the first by all columns stays.

    What goes, or stands there more than once, is told by keys; texts are shuffled only if those are too many to broadcast.
    """
    found = near_copies(docs, threshold)
    lost = (F.col("first.k1") != F.col("k1")) | (F.col("first.k2") != F.col("k2"))
    marks = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max(lost).alias("lost"))
    marks = written(marks.where("lost OR n > 1").select("k1", "k2", "lost"), "marks")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *row_keys()).join(small_enough(marks), ["k1", "k2"], "left")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.to_json("row")))
    again = keyed.where("NOT lost").withColumn("place", place).where("place = 1")
    return keyed.where("lost IS NULL").select("row.*").unionByName(again.select("row.*"))
