"""Vector and similarity operators against brute force on small fixtures with planted cases."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import embedding_dedup, graph, jaccard, topk

VECTORS = "vec_id long, embedding array<float>, label int, rid string"


def vectors():
    rng = np.random.default_rng(2)
    rows, base = [], rng.normal(size=(12, 16))
    for i in range(600):
        v = base[i % 12] + rng.normal(scale=0.02 + 0.12 * (i % 3), size=16) if i % 2 else rng.normal(size=16)
        rows.append((i, [float(np.float32(x)) for x in v], [0, 0, 0, 1, None][i % 5], "clash"))
    rows[7] = (7, rows[1][1], rows[1][2], None)
    rows += [(600, None, 0, None), (601, [0.0] * 16, 0, None), (602, [float("nan")] * 16, 0, None), (603, [1.0, 2.0], 0, None), (604, [], 0, None),
             (605, [None] + [1.0] * 15, 0, None), (None, rows[1][1], rows[1][2], None), rows[11]]
    return rows


def fine(v):
    return v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v)


def roots(n, links):
    i, j = (np.array(x, int) for x in zip(*links, strict=True)) if links else (np.zeros(0, int),) * 2
    return graph.local_roots(n, i, j)


@pytest.mark.parametrize("tile", [40, 2048])
def test_embedding_dedup(spark, tile):
    rows = sorted(vectors(), key=lambda r: (r[0] is None, r[0] or 0))
    links = []
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[2] is not None and a[2] == b[2] and fine(a[1]) and fine(b[1]) and any(a[1]) and any(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links.append((j, i))
    root, n = roots(len(rows), links), np.bincount([k for p in links for k in p], minlength=len(rows))
    want = sorted(((r[0], int(n[i]), rows[root[i]][0], rows[root[i]][0] == r[0]) for i, r in enumerate(rows)), key=repr)
    got = embedding_dedup.near_duplicates(spark.createDataFrame(vectors(), VECTORS), 0.98, tile)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(links) > 500


@pytest.mark.parametrize("block", [(3, 50), (1024, 8192)])
def test_top_k(spark, block):
    rows = [r for r in vectors() if fine(r[1])]
    codes = [np.floor(1024 * np.array(r[1])).astype(np.int64) for r in rows]
    want = []
    for i, q in enumerate(rows):
        if q[0] is not None and q[0] % 20 == 0:
            order = sorted((j for j in range(len(rows)) if rows[j][0] != q[0]), key=lambda j: (-int(codes[i] @ codes[j]), rows[j][0] is None, rows[j][0] or 0))
            want += [(q[0], k + 1, rows[j][0], int(codes[i] @ codes[j])) for k, j in enumerate(order[:10])]
    got = topk.top_k(spark.createDataFrame(vectors(), VECTORS), 20, 10, q_block=block[0], c_block=block[1])
    assert sorted(map(tuple, got.where("size(array(query_id)) = 1").collect()), key=repr) == sorted(want, key=repr)


def brute_top_k(rows, every, k):
    want = []
    for q, qv in rows:
        if q is not None and q % every == 0:
            order = sorted(((-int(qv @ v), i is None, i or 0, i) for i, v in rows if i != q), key=lambda x: x[:3])
            want += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(order[:k])]
    return sorted(want, key=repr)


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_top_k_under_ties(spark, lists):
    """A third of all rows hold one vector, ids repeat, and scores tie in long runs."""
    rng = np.random.default_rng(5)
    common = [0.5, -0.25, 0.125, 0.75, 0.0, 1.0]
    rows = [(i, common if i % 3 == 0 else [float(x) / 4 for x in rng.integers(-2, 3, 6)]) for i in range(500)]
    rows += [(40, common)] * 15 + [(None, common)] * 3 + [(60, [0.0] * 6)] * 12
    df = spark.createDataFrame([(i, v, None, None) for i, v in rows], VECTORS)
    found = topk.phases(df, 20, 10, 1024, lists, 7, 90)
    codes = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    assert sorted(map(tuple, found.ranked.collect()), key=repr) == brute_top_k(codes, 20, 10)


def test_few_scores_are_resolved(spark):
    """On the table the cutoff leaves few entries, and fewer full scores to resolve."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = topk.phases(df, 100, 10, 1024, 2, 1024, 512)
    rows = [(r["vec_id"], np.floor(1024 * np.array(r["embedding"])).astype(np.int64)) for r in df.collect()]
    pairs = len(rows) * sum(i % 100 == 0 for i, _ in rows)
    assert sorted(map(tuple, found.ranked.collect()), key=repr) == brute_top_k(rows, 100, 10)
    assert found.entries.count() < 0.2 * pairs and found.opened.count() < 0.1 * pairs


def test_dedup_of_a_common_vector(spark):
    """Near copies around the threshold and a vector that a third of the rows hold, in small tiles."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(i, base if i % 3 == 0 else base + rng.normal(scale=0.1 + 0.004 * (i % 100), size=24), 1) for i in range(700)]
    df = spark.createDataFrame([(i, [float(x) for x in v], n, None) for i, v, n in rows], "vec_id long, embedding array<double>, label int, rid string")
    v = np.stack([x[1] for x in rows])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1))
    root, n = graph.local_roots(len(rows), i, j), np.bincount(np.concatenate([i, j]), minlength=len(rows))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, 0.98, 64).collect()}
    assert got == {k: (int(n[k]), int(root[k])) for k in range(len(rows))} and 0 < np.sum(n == 0) < 600


def test_few_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, ""), (3, [0.5, 0.5], 1, ""), (5, [-1.0, 0.0], 1, "")], VECTORS)
    assert [tuple(r) for r in topk.top_k(df, 100, 10).orderBy("rank").collect()] == [(0, 1, 3, 524288), (0, 2, 5, -1048576)]
    empty = spark.createDataFrame([], VECTORS)
    assert topk.top_k(empty).count() == 0 and embedding_dedup.near_duplicates(empty).count() == 0


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_jaccard(spark, sf, monkeypatch):
    monkeypatch.setattr(jaccard, "SET_TILE", 16)
    monkeypatch.setattr(jaccard, "BUCKET_TILE", 16)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    docs = [(r["doc_id"], r["text"], "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = list(rng.choice(words, 120))
    for i in range(80):  # a group of near copies around the threshold
        t = list(base)
        for at in rng.choice(120, i % 5, replace=False):
            t[at] = f"x{i}{at}"
        docs.append((1000 + i, " ".join(t), None))
    docs += [(2000, None, None), (2001, "", None), (2002, " ", None), (2003, "one", None), (2004, "ONE.", None), (2005, "a b", None), (None, " ".join(base), None), docs[3]]
    ordered = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0))
    sets, at, links = [shingles(r[1]) for r in ordered], defaultdict(list), []
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, j in {(a, b) for v in at.values() for b in v for a in v if a < b}:
        n = len(sets[i] & sets[j])
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links.append((i, j))
    root, n = roots(len(ordered), links), np.bincount([k for p in links for k in p], minlength=len(ordered))
    df = spark.createDataFrame(docs, "doc_id long, text string, k1 string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.joined(df).collect()), key=repr)
    assert got == sorted(((r[0], ordered[root[i]][0], int(n[i])) for i, r in enumerate(ordered)), key=repr) and len(links) > 500
    kept = jaccard.distinct_documents(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted({ordered[x][0] for x in root}, key=repr)


def test_jaccard_without_words(spark):
    texts = ["-----", "*** ***", "-----", "\U0001f600\U0001f600", "----", "one two", "-----", "\U0001f600\U0001f600", "", "", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["kept"]) for r in jaccard.joined(df).collect()}
    copies = {0: (0, 2, True), 2: (0, 2, False), 6: (0, 2, False), 3: (3, 1, True), 7: (3, 1, False)}
    assert got == {i: copies.get(i, (i, 0, True)) for i in range(len(texts))}
    assert sorted(r["doc_id"] for r in jaccard.distinct_documents(df).collect()) == [0, 1, 3, 4, 5, 8, 9, 10, 11]


def test_jaccard_empty(spark):
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.joined(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")).count() == 2


def test_depth_reaches_the_recall():
    d = jaccard.shortest(0.8, 0.99999)
    assert 1 - (1 - 0.8**d) ** jaccard.TREES >= 0.99999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES
    assert jaccard.shortest(0.99, 0.99) == jaccard.DEPTH and jaccard.shortest(0.1, 0.999999) == 1


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(1)
    f = jaccard.multipliers(192)
    shares = []
    for i in range(400):
        n = int(rng.integers(5, 400))
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = h[: n + n // 2], h[n // 2 :]
        shares.append((jaccard.signature(a, f) == jaccard.signature(b, f)).mean() - (len(a) + len(b) - len(h)) / len(h))
    assert abs(np.mean(shares)) < 0.01 and np.std(shares) < 0.045


def test_tries_are_sorted_and_matched(spark):
    """Longest matches with neighbours, against all pairs, over several ranges."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        codes = rng.integers(0, 2, (2, 8))
        packed = [[int(sum(int(x) << (48 - 16 * k) for k, x in enumerate(half))) for half in (c[:4], c[4:])] for c in codes]
        rows.append((i, i * 7, [p[0] for p in packed], [p[1] for p in packed], codes))
    df = spark.createDataFrame([r[:4] for r in rows], "ord long, c1 long, hi array<long>, lo array<long>")
    got = {(r["tree"], r["ord"]): r["deep"] for r in jaccard.tries(df, 1).collect()}
    short = 0
    for t in range(2):
        for a in rows:
            best = max(next((k for k in range(8) if a[4][t][k] != b[4][t][k]), 8) for b in rows if b is not a)
            deep = got.get((t, a[0]), 0)
            assert deep == best or deep == 8  # 8: at the end of a range
            short += deep != best
    assert short <= 16


def test_recall_on_the_table(spark):
    """All pairs of the table that share a shingle, counted; the join loses next to none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: r[0])
    sets, at, shared = [shingles(t) for _, t in rows], defaultdict(list), defaultdict(int)
    for i, s in enumerate(sets):
        for x in s:
            at[x].append(i)
    for v in at.values():
        for p, i in enumerate(v):
            for j in v[:p]:
                shared[j, i] += 1
    links = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9]
    want = sum(map(len, (links, links)))
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in jaccard.joined(docs).collect()}
    assert 0.99 * want <= sum(n for n, _ in got.values()) <= want and want > 100
    root = roots(len(rows), links)
    assert sum(got[r[0]][1] == rows[root[i]][0] for i, r in enumerate(rows)) >= 0.99 * len(rows)


def test_repeated_rows_keep_their_order(spark):
    df = spark.createDataFrame([(1, "one two", "b"), (1, "one two", "a"), (2, "three", None), (2, "three", None), (3, "one two", "0")], "doc_id long, text string, __place string")
    assert sorted(map(tuple, jaccard.distinct_documents(df).collect())) == [(1, "one two", "a"), (2, "three", None)]


def test_components_with_hubs(spark, monkeypatch):
    """Hubs with thousands of neighbours, on both ends of the order."""
    edges = [(0, i) for i in range(1, 3000)] + [(9000, i) for i in range(3000, 6000)] + [(7000, 7001), (7001, 2999)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in (*range(3000), 7000, 7001)} | {i: 3000 for i in (*range(3000, 6000), 9000)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).select(F.col("node")).count() == 0
