"""Rewriting, calibration, documents, corpus and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import batches, calibration, edits, rewrite
from scriptorium.plans import demo, queries
from scriptorium.sources import corpus, documents, docx
from scriptorium.streaming import score


def test_rewrite_keeps_evidence(spark):
    text = (
        "It is important to note that the results obtained are clear (Smith, 2020). Moreover, we conducted an analysis of 42 sites in New York in order to delve into costs.\n"
        "References\nSmith, J. (2020). In order to see."
    )
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rewrite.rewritten(df, "balanced", ["New York"]).collect()}
    assert got[1]["applied"] and "in order to delve" not in got[1]["text"] and "(Smith, 2020)" in got[1]["text"]
    assert got[1]["text"].endswith("References\nSmith, J. (2020). In order to see.")
    assert got[1]["score_after"] >= got[1]["score_before"] and not got[2]["applied"] and got[3]["text"] == ""
    assert not any(r["applied"] for r in rewrite.rewritten(df, "off").collect())


def test_edits_need_both_halves():
    assert edits.flatten("It is not only cheap but also fast.") == "It is cheap and fast."
    assert edits.flatten("It is not only cheap.") == "It is not only cheap."
    assert edits.vary_studies("The study is one. The study is two. The study is three.") == "The study is one. The analysis is two. It is three."
    assert edits.protected("TITLE HERE") and edits.protected("a\tb") and not edits.protected("This was a plain sentence.")


def test_external_editor_is_gated(spark):
    b = spark.createDataFrame([(1, 0, "We saw 5 cats.", False), (1, 1, "We saw 6 cats.", False), (1, 2, "References", True)], "doc_id long, batch int, text string, protected boolean")

    def model(t):
        if "6" in t:
            raise RuntimeError("down")
        return t.replace("saw", "met")

    got = {r["batch"]: r for r in rewrite.rewritten_by(b, model).collect()}
    assert got[0]["accepted"] and got[0]["revised"] == "We met 5 cats."
    assert not got[1]["accepted"] and "down" in got[1]["error"] and got[1]["revised"] == "We saw 6 cats." and not got[2]["accepted"]


def test_batches():
    text = "\n".join(f"{i}.1 Heading {i}\n" + "word " * 460 + "end." for i in range(1, 86)) + "\nReferences\nSmith 2020"
    got = batches.packed(text)
    assert 8 <= len(got) <= 12 and all(x[2] <= 5000 for x in got) and got[-1][1]


def test_markers(spark):
    p = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, index int, text string")
    prompt = batches.marked(p)
    assert [(r["index"], r["text"]) for r in batches.unmarked(prompt, p).orderBy("index").collect()] == [(0, "a"), (1, "b")]
    assert batches.unmarked(prompt.withColumn("prompt", F.replace("prompt", F.lit("P:1"), F.lit("P:7"))), p).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, i % 2, *map(float, rng.normal(i % 2, 1, 5))) for i in range(200)]
    return spark.createDataFrame(data, "id long, label int, " + ", ".join(f"f{i} double" for i in range(5)))


def test_training_and_prediction_agree(spark, rows):
    names = [f"f{i}" for i in range(5)]
    got = rows.orderBy("id").collect()
    x, y = np.array([[r[n] for n in names] for r in got]), np.array([r["label"] for r in got])
    for fit in calibration.FITTERS.values():
        model = fit(x, y, names)
        p = [r["probability"] for r in calibration.predicted(rows, model).orderBy("id").collect()]
        assert np.allclose(p, calibration.probabilities(x, model), atol=1e-9)
    best = calibration.train_best(rows, names)
    assert best["test_metrics"]["roc_auc"] > 0.8 and len(best["feature_names"]) == 5
    with pytest.raises(ValueError):
        calibration.train_best(rows.limit(20), names)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.1)], "label int, probability double")
    assert calibration.roc_auc(df).first()["roc_auc"] == 0.875
    m = calibration.metrics(np.array([1, 1, 0, 0]), np.array([0.9, 0.6, 0.6, 0.1]))
    one = calibration.classification_metrics(df).first()
    assert m["roc_auc"] == 0.875 and all(one[k] == m[k] for k in ("tp", "fp", "accuracy", "precision", "recall", "f1"))
    assert calibration.threshold_under(np.array([1, 1, 0, 0]), np.array([0.9, 0.6, 0.6, 0.1]), 0.0)[0] == 0.9


def test_percentages_follow_the_rounded_probability(spark, monkeypatch):
    want = {1: 0.7250003131126389, 2: 0.6749995740761668, 3: 0.4999997}
    rows = [(i, 1, (math.log(p / (1 - p)) - demo.BIAS) * 2 / demo.WEIGHTS["length_k"] + 1) for i, p in want.items()]
    ones = [f"1.0D AS {k}" for k in demo.FEATURES if k != "length_k"]
    table = spark.createDataFrame(rows, "id long, label int, length_k double").selectExpr("*", *ones)
    monkeypatch.setattr(demo, "labelled", lambda spark, sf: table)
    got = {r["id"]: (r["probability"], r["percentage"], r["predicted"]) for r in queries.logistic_predict(spark, "").collect()}
    assert got == {1: (0.725, 72, 1), 2: (0.675, 68, 1), 3: (0.5, 50, 1)}


def test_word_documents(spark, tmp_path):
    content = docx.clean_document("# Title\n\nHello & there.\n\nReferences\n\nSmith")
    (tmp_path / "a.docx").write_bytes(content)
    (tmp_path / "b.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "c.xyz").write_bytes(b"?")
    got = {r["path"].rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["text"] == "Title\n\nHello & there.\n\nReferences\n\nSmith" and got["b.txt"]["text"] == "café" and "unsupported" in got["c.xyz"]["error"]
    new = spark.createDataFrame([(got["a.docx"]["path"], 1, "Hi <you>.")], "path string, index int, text string")
    out = documents.patched_documents(spark, str(tmp_path), new).first()
    assert out["passed"] and docx.rendered(docx.inspect(bytes(out["content"]))).startswith("Title\n\nHi <you>.")
    bad = new.withColumn("index", F.lit(3))
    assert "locked" in documents.patched_documents(spark, str(tmp_path), bad).first()["error"]
    assert documents.illegal_replacements(bad, documents.read_structure(spark, str(tmp_path))).count() == 1


def test_corpus(spark, tmp_path):
    path = str(tmp_path / "corpus")
    raw = spark.createDataFrame([("word " * 50, "human_edited", {"A ": "50.123", "b": "x", "c": "300"})], "text string, provenance string, external_scores map<string,string>")
    corpus.append(raw, path)
    got = corpus.read_corpus(spark, path).collect()
    assert len(got) == 1 and got[0]["label"] == 0 and got[0]["external_scores"] == {"a": 50.12} and got[0]["word_count"] == 50
    with open(path + "/bad.json", "w") as f:
        f.write('{"text": "x", "label": 5}\n{oops\n')
    assert corpus.read_corpus(spark, path).count() == 1
    assert {r["grouping"] for r in corpus.status(corpus.read_corpus(spark, path)).collect()} == {"all", *corpus.GROUPS}


def test_registry(tmp_path):
    r = corpus.Registry(str(tmp_path))
    a, b = r.register({"model_type": "logistic", "n": 1}), r.register({"model_type": "logistic", "n": 2})
    assert r.active()["n"] == 2 and r.rollback()["n"] == 1 and r.status()["previous"] == b and r.promote(b)["n"] == 2 and r.status()["previous"] == a
    with pytest.raises(ValueError):
        r.promote("none")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "Moreover, staff leverage robust tools."), (2, "It was plain.")], score.SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = score.read_stream(spark, str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(lambda b, n: seen.extend(score.sentence_risks(b).collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["doc_id"]: r["own_risk"] for r in seen} == {r["doc_id"]: r["own_risk"] for r in score.sentence_risks(df).collect()}


def test_html(spark):
    from scriptorium.operators import segments, signals

    df = spark.createDataFrame([(1, "Moreover, <b> staff leverage tools.\nIt was & is."), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["html"] for r in documents.coloured_html(df, signals.scored_segments(segments.sentences(df))).collect()}
    assert "&lt;b&gt;" in got[1] and "<br>" in got[1] and 'signal-A"' in got[1] and got[2] == ""


def test_guided_rewrite_follows_the_families(spark):
    from scriptorium.operators import segments, signals

    text = "Furthermore, it is important to note that teams often leverage a myriad of tools in 2020. It was plain. Moreover, the results are clear to all of us here today."
    df = spark.createDataFrame([(1, text), (2, "It was plain here for all.")], "doc_id long, text string")
    zeros = [f"{int(k in 'AF')} AS {k}" for k in "ABCDEFGHI"] + [f"0 AS {m}" for m in rewrite.METRIC_FAMILIES]
    scores = spark.range(1, 3).selectExpr("id AS doc_id", *zeros)
    got = {r["doc_id"]: r for r in rewrite.rewritten_guided(df, scores, signals.scored_segments(segments.sentences(df))).collect()}
    assert got[1]["applied"] and got[1]["text"].startswith("Teams often leverage many tools in 2020.") and not got[2]["applied"]


def test_masks_do_not_run_out():
    text = " ".join(f"{i}" for i in range(10_000, 16_500))
    masked = edits.Masked(text, [])
    assert not any(c.isdigit() for c in masked.text) and masked.restored(masked.text) == text
    marks = [edits.private(i) for i in (0, 6399, 6400, 6400 + edits.PLANE - 1, 6400 + edits.PLANE, 200_000)]
    masked.kept = {m: f"<{i}>" for i, m in enumerate(marks)}
    assert masked.restored("".join(marks)) == "<0><1><2><3><4><5>"


def test_marks_are_not_in_the_text():
    text = "The \ue000 sign costs 42 and \U000f0000 costs 43 in NASA."
    masked = edits.Masked(text, ["sign"])
    assert "42" not in masked.text and masked.restored(masked.text) == text
    assert edits.Masked("a1 " * 3 + "\ue000\ue001", []).restored("\ue000\ue001") == "\ue000\ue001"


def test_batches_of_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one two."), (None, "three."), (1, "a b."), (1, "a b."), (2, None), (3, "")], "doc_id long, text string")
    got = batches.batches(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "one two."), (0, "three."), (1, "a b."), (1, "a b.")]
