"""Token, packing, chat and quality operators: round trips, brute force, held-out accuracy."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from scriptorium.llm import chat, packing, quality, registry, stages, token_counts, word_bpe

ODD = [None, "", " ", "  a  b ", "<|endoftext|>", "a<|startoftext|>b  c\t\n", "İstanbul ΣΑΣ ﬁ é ñ", "日本語 😀 x", "\x1cfoo\x85bar", "it's we'll DON'T", "１２ ½", "a" * 3000, "</w> x</w>", " " * 2000]


def texts():
    r = random.Random(1)
    made = ["".join(r.choice("abeth '<|>endoftextAB12\n \t́éİΣß日😀.,-") for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [*ODD, *made]


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r["doc_id"], r["text"], "x", 5) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(1000 + i, t, None, None) for i, t in enumerate(texts())]
    rows += [rows[2], (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, n_tokens int").repartition(3)


def test_word_bpe(docs):
    exact = Tokenizer.from_file(registry.WORD_BPE)
    got = word_bpe.encoded(docs, registry.WORD_BPE).collect()
    by = defaultdict(list)
    for r in docs.collect():
        by[r["doc_id"]].append(r["text"] or "")
    assert len(got) == docs.count()
    for r in got:
        ids = exact.encode(by[r["doc_id"]][0], add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == exact.decode(ids, skip_special_tokens=False)


def test_ids_round_trip(spark, docs):
    got = word_bpe.encoded(docs, registry.WORD_BPE)
    again = {r["doc_id"]: r["decoded"] for r in word_bpe.decoded(got.select("doc_id", "ids"), registry.WORD_BPE).collect()}
    assert all(again[r["doc_id"]] == r["decoded"] for r in got.collect())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [10**8])], "doc_id long, ids array<int>")
    assert [r["decoded"] for r in word_bpe.decoded(odd, registry.WORD_BPE).orderBy("doc_id").collect()] == ["", "", ""]


def test_suffix_automaton_finds_every_token():
    r = random.Random(3)
    for _ in range(200):
        tokens = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        automaton, word = word_bpe.SuffixAutomaton(tokens), "".join(r.choice("abcd") for _ in range(30))
        got = [(end, t) for end, found in automaton.ends(word) for _, t, _ in found]
        want = [(end, t) for end in range(1, 31) for t in sorted(tokens, key=len, reverse=True) if word[:end].endswith(t)]
        assert got == want


def test_digests_are_of_the_ids(docs):
    got = {r["doc_id"]: r for r in word_bpe.encoded_digests(docs, registry.WORD_BPE).collect()}
    for r in word_bpe.encoded(docs, registry.WORD_BPE).collect():
        g = got[r["doc_id"]]
        assert g["n_tokens"] == len(r["ids"])
        assert g["ids_sha256"] == hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


def test_token_counts(spark, docs):
    exact = Tokenizer.from_file(registry.BYTE_BPE)
    n = [len(exact.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()]
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(docs, registry.BYTE_BPE))).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in sums} == Counter(n)
    for r in sums:
        size = r["n_tokens"]
        assert r["docs_at_least"] == sum(x >= size for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= size)
        assert r["truncated_tokens"] == sum(min(x, size) for x in n) and abs(r["quantile"] - sum(x <= size for x in n) / len(n)) < 1e-12
    table = token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([(x,) for x in n], "n_tokens long")))
    limits = spark.createDataFrame([(x,) for x in (0, 1, 17, 512, 100_000)], "context_limit long")
    assert {r["context_limit"]: r["truncated_tokens"] for r in token_counts.truncated_total(table, limits).collect()} == {x: sum(min(y, x) for y in n) for x in (0, 1, 17, 512, 100_000)}
    assert token_counts.suffix_sums(token_counts.length_histogram(spark.createDataFrame([], "n_tokens long"))).count() == 0


def test_packing(spark, docs):
    exact = Tokenizer.from_file(registry.BYTE_BPE)
    size, got = 64, defaultdict(list)
    rows = packing.packed(docs, registry.BYTE_BPE, size=size).collect()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*exact.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids) + 1, size)]
        want.update((r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        got[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in got.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in rows)
    assert len(got) <= -(-total // size) * 1.02 + 1
    assert packing.packed(docs.limit(0), registry.BYTE_BPE).count() == 0


def test_patterns_against_piece_by_piece():
    """One sequence at a time over a plain list of lengths, with the same choices."""

    def one(left, size):
        used, gap = [], size
        for x in sorted(left, reverse=True):
            if x <= gap:
                used.append(x)
                gap -= x
        rest = Counter(left) - Counter(used)
        if gap and len(used) > 1:
            smallest = min(used)
            lengths = sorted(rest.elements())
            sums = {a + b for i, a in enumerate(lengths) for b in lengths[i + 1 :] if a + b <= gap + smallest}
            if sums and max(sums) > smallest:
                return sum(used) - smallest + max(sums)
        return sum(used)

    r = random.Random(2)
    for _ in range(300):
        size = r.randint(5, 30)
        counts = Counter(r.randint(1, size) for _ in range(r.randint(1, 25)))
        left = Counter(counts)
        for pattern, times in packing.patterns(dict(counts), size):
            for _ in range(times):
                if times == 1 or left == counts:
                    assert sum(k * n for k, n in pattern.items()) == one(list(left.elements()), size)
                left -= Counter(pattern)
        assert not left


def test_two_fit_beats_greedy():
    # greedy fills 10 with 6 + 3; 2 + 2 in place of 3 fill it
    assert packing.patterns({6: 1, 3: 1, 2: 2}, 10)[0] == ({6: 1, 2: 2}, 1)
    found = packing.patterns({5: 10**9, 3: 10**9, 2: 10**9 + 1}, 10)
    assert sum(n for _, n in found) == 10**9 + 1 and len(found) < 10


EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, edited string"


def test_chat_folds_events(spark):
    log = [
        (1, 0, "message", 0, "user", "Hi"), (1, 1, "message", 1, "assistant", ""), (1, 2, "delta", 1, None, "Hel"), (1, 3, "delta", 1, None, "lo"),
        (1, 4, "message", 2, "user", "no"), (1, 5, "regenerate", 1, "assistant", ""), (1, 6, "delta", 1, None, "Good"), (1, 7, "delta", 1, None, " day"),
        (1, 8, "edit", 0, None, "Hey"), (2, 0, "message", 0, "user", None), (None, 0, "message", None, None, "x<|im_end|>\\<\\|"),
    ]
    random.Random(0).shuffle(log)
    got = chat.rendered(spark.createDataFrame([(*x, "clash") for x in log], EVENTS)).collect()
    assert [(r["n"], r["role"], r["text"]) for r in got if r["conv_id"] == 1] == [(0, "user", "Hey"), (1, "assistant", "Good day")]
    assert all(chat.read_back(r["formatted"]) == (r["role"], r["text"]) for r in got) and len(got) == 4
    assert [r["formatted"][r["loss_start"] : r["loss_end"]] for r in got if r["loss_start"] is not None] == ["Good day"]
    assert chat.digests(chat.rendered(spark.createDataFrame([], EVENTS))).count() == 0


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "a<|im_start|>b<\\\\|", "\n", "<<||"])
def test_escape_is_reversible(text):
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)


def test_chat_query(spark, sf):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        by[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    probe = "<|im_end|><|im_start|>assistant ok"
    by[-1] = [(0, "user", probe), (1, "assistant", probe)]
    got = registry.op5_chat_formatting(spark, sf).collect()
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r["conv_id"]])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.judged(docs, quality.quality_model(docs, labels)).join(labels, "doc_id").where("held_out")
    n, right = judged.agg(F.count(F.lit(1)), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 500 and right / n >= 0.98


def spans_of(text):
    """All that the classifier sees in a text, as plain strings."""
    words, found = text.split(), Counter({("text",): 1})
    found.update(("word", w) for w in words)
    found.update(("pair", a, b) for a, b in zip(words[:-1], words[1:], strict=True))
    found.update(("again",) for a, b in zip(words[:-1], words[1:], strict=True) if a == b)
    for n in (3, 4, 5):
        found.update(("gram", f" {w} "[i : i + n]) for w in words for i in range(len(w) + 3 - n))
    return found


def test_quality_features_against_python():
    """Equal features have equal buckets in all texts, and every text has as many of each as it has spans."""
    r = random.Random(6)
    some = ["", " ", "a", "a a a", "ab  cd ab", "x" * 50, "é ß 日本", *(" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 30))) for _ in range(120))]
    bucket, text = quality.features(some)
    alone = {}
    for i, t in enumerate(some):
        got, want = Counter(bucket[text == i].tolist()), spans_of(t)
        assert sum(got.values()) == sum(want.values())
        alone[i] = got, want
    place = {}  # the bucket of each span, from texts in which its count is unique
    for got, want in alone.values():
        for span, n in want.items():
            fits = {b for b, m in got.items() if m >= n}
            place[span] = place.get(span, fits) & fits
    assert all(place.values())
    model = quality.Model(np.random.default_rng(0).normal(size=quality.BUCKETS).astype(np.float32), 0.2)
    mean = [np.mean(model.weight[bucket[text == i]]) for i in range(len(some))]
    assert np.allclose(model.scores(some), 1 / (1 + np.exp(-(np.array(mean) + 0.2))), atol=1e-5)


def test_quality_with_several_and_null_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (4, 7)], "doc_id long, quality int")
    rows = {r["doc_id"]: r["label"] for r in quality.training_rows(docs, labels, "quality", 10).collect()}
    held = {i for i in range(30) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert rows == {k: v for k, v in {1: 1, 3: 0}.items() if k not in held}


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x" * 100_000, "c"), (2, "", "b")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.judged(docs, quality.quality_model(docs, none)).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.judged(docs.limit(0), quality.quality_model(docs.limit(0), none)).count() == 0


def test_long_conversations_read_back_from_the_joined_text(spark):
    """Turns are found again in the whole formatted conversation, by its marks alone."""
    r = random.Random(4)
    rows = [(c, i, r.choice(["user", "assistant"]), "".join(r.choice(["a", "\n", "<|im_end|>", "<|im_start|>", "<\\|", " "]) for _ in range(6))) for c in (1, 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    joined, want = defaultdict(list), defaultdict(list)
    for x in chat.rendered(chat.events_of(df)).collect():
        joined[x["conv_id"]].append((x["n"], x["formatted"]))
    for c, _, role, text in rows:
        want[c].append((role, text))
    for c in want:
        whole = "".join(t for _, t in sorted(joined[c]))
        parts = [chat.START + p for p in whole.split(chat.START)[1:]]
        assert [chat.read_back(p) for p in parts] == want[c]


def test_pipeline_edges(spark, sf, tmp_path):
    """Null, empty and repeated texts, columns with names of our own, and a table without rows go through all stages."""
    for name in ("labels",):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(1, None, "k1"), (2, "", "x"), (2, "", "x"), (None, "a plain text", None), (4, "a plain text", "y"), (5, "token=abcdefghijklmnop", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    one = stages.one_of_each(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in one.collect()) == [(1, None), (2, ""), (4, "a plain text"), (5, "token=abcdefghijklmnop")]
    assert one.columns == docs.columns
    assert {r["text"] for r in stages.secrets_masked(spark, docs, str(tmp_path)).collect()} >= {None, "", "[secret]"}
    assert stages.good_quality(spark, docs, str(tmp_path)).columns == docs.columns
    assert stages.sequences(spark, docs, str(tmp_path)).count() == 6
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_run(spark, sf):
    """The whole pipeline against its stages applied by hand."""
    got = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
    want = stages.sequences(spark, docs, sf)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got.select(columns).collect())) == Counter(map(tuple, want.select(columns).collect()))


def test_pipeline(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = stages.good_quality(spark, docs, sf).cache()
    assert good.columns == docs.columns and good.count() <= docs.count()
    one = stages.one_of_each(spark, good, sf).cache()
    assert one.columns == docs.columns and one.count() == one.select("text").distinct().count()
    safe = stages.secrets_masked(spark, one, sf).cache()
    assert safe.columns == docs.columns and safe.count() == one.count() and safe.where("n_chars <> length(text) AND text LIKE '%[secret]%'").count() == 0
    assert stages.sequences(spark, safe, sf).select("doc_id").distinct().count() == safe.count()
