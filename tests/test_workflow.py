"""Editing runs, paragraph groups, calibrated scores, training from a corpus, registered functions."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import registered
from scriptorium.operators import ensemble, rewrite, style, training, workflow
from scriptorium.operators import segments as seg
from scriptorium.sources import corpus, documents, docx

WORDY = (
    "It is important to note that the results obtained are clear (Smith, 2020). Moreover, we conducted an analysis of 42 sites in New York in order to delve into costs.\n"
    "References\nSmith, J. (2020). In order to see."
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, WORDY, "x"), (None, None, "y"), (1, "Plain words were read here.", "z")], "doc_id long, text string, rid string")


def test_edited_documents(docs):
    got = workflow.edited_documents(docs, 2026, "local", terms=["New York"]).collect()
    assert len(got) == 3
    one = next(r for r in got if "Smith" in r["text"])
    assert one["changed"] and one["actual_editor"] == "local" and one["certificate"]["passed"] and one["naturalness_after"] >= one["naturalness_before"]
    assert [m["key"] for m in one["signal_map"]] == list("ABCDEFGHI") and all(m["change"] == m["after"] - m["before"] for m in one["signal_map"])
    assert sorted(r["text"] for r in got if not r["changed"]) == ["", "Plain words were read here."]
    with pytest.raises(ValueError):
        workflow.edited_documents(docs, 2026, "none")


def test_a_model_is_needed(spark):
    df = spark.createDataFrame([(1, WORDY)], "doc_id long, text string")
    one = workflow.edited_documents(df, 2026, "model", terms=["New York"]).first()
    assert one["actual_editor"] == "local_fallback" and one["reason"] == "no model" and one["changed"]


def test_paragraph_groups(spark, tmp_path):
    lead = "It is important to note that "
    rows = [(1, 0, lead + "we met 5 cats and their many owners at the old market in town."), (1, 1, "We met 6 dogs in the park."), (None, 0, lead + "they left in 1999."), (1, 2, None)]
    p = spark.createDataFrame(rows, "doc_id long, index int, text string")
    log = str(tmp_path / "calls")

    def model(t):
        with open(log, "a") as f:
            f.write("call\n")
        return t.replace(lead + "we", "We").replace("1999", "2001")

    got = {(r["doc_id"], r["index"]): r for r in rewrite.rewritten_paragraphs(p, model, limit=0.5).collect()}
    assert len(got) == 4 and got[1, 0]["revised"].startswith("We met 5 cats") and got[1, 0]["accepted"]
    assert not got[None, 0]["accepted"] and "numbers changed" in got[None, 0]["issues"] and got[None, 0]["revised"] == rows[2][2]
    assert got[1, 1]["revised"] == rows[1][2] and got[1, 2]["revised"] == ""
    with open(log) as f:
        assert len(f.readlines()) == 2  # one group a document; what needs no edit is not sent
    lost = rewrite.rewritten_paragraphs(p, lambda t: "no markers").collect()
    assert not any(r["accepted"] for r in lost) and {r["error"] for r in lost} == {None, "the markers of the answer differ"}


def test_needs_edit_and_variation(spark):
    names = ["generic_phrase_hits", "repeated_sentence_openings", "repeated_paragraph_openings", "long_sentence_count", "overloaded_sentence_count", "repeated_frame_density", "generic_connector_hits"]
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 0, 2), (0, 0, 0, 0, 0, 0, 3), (0, 0, 0, 1, 0, 0, 0)], ", ".join(f"{n} int" for n in names))
    assert [r[0] for r in df.select(style.needs_edit("balanced")).collect()] == [False, True, True]
    assert df.where(style.needs_edit("deep")).count() == 3
    assert style.Variation.configured(spark) == style.Variation()
    try:
        spark.conf.set("scriptorium.variation.lexical", " Moderate ")
        assert style.Variation.configured(spark) == style.Variation(lexical=0.56)
        spark.conf.set("scriptorium.variation.rhythm", "moderate")
        assert style.Variation.configured(spark) == style.Variation.moderate()
    finally:
        spark.conf.unset("scriptorium.variation.lexical")
        spark.conf.unset("scriptorium.variation.rhythm")


def test_eligible_paragraphs(spark):
    rows = [("a", 0, "paragraph", 0, "one two three four five six", True, 6), ("a", 1, "table", 0, "t", False, 0), ("a", 2, "paragraph", 1, "short", True, 1), ("a", 3, "paragraph", 2, "seven eight nine ten eleven twelve", True, 6)]
    df = spark.createDataFrame(rows, "path string, position int, kind string, index int, text string, editable boolean, word_count int")
    got = documents.eligible(df, context=3).orderBy("index").collect()
    assert [(r["index"], r["context_before"], r["context_after"]) for r in got] == [(0, "", "sev"), (2, "six", "")]
    new = spark.createDataFrame([("a", 0, "NEW")], "path string, index int, text string")
    assert documents.whole_texts(df, new).first()["text"] == "NEW\n\nt\n\nshort\n\nseven eight nine ten eleven twelve"


def test_edited_word(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx.clean_document("# Title\n\n" + WORDY.replace("\n", "\n\n")))
    one = workflow.edited_word(spark, str(tmp_path), 2026, "local").first()
    text = docx.rendered(docx.inspect(bytes(one["content"])))
    assert one["structure_kept"] and one["changed_paragraphs"] == 1 and "delve" not in text and "(Smith, 2020)" in text and one["certificate"]["passed"]


def test_calibrated_signal_and_composite(spark):
    names = ["statistical_pct", "forensic_pct"]
    model = {"model_type": "logistic", "feature_names": names, "means": dict.fromkeys(names, 0.0), "scales": dict.fromkeys(names, 1.0), "weights": dict.fromkeys(names, 0.0), "bias": 0.0}
    df = spark.createDataFrame([(1, WORDY), (2, None)], "doc_id long, text string")
    got = ensemble.document_scores(df, 2026, private=True, model=model).collect()
    assert all(r["ai_signal"] == 50 and r["score_source"] == "calibrated" for r in got) and any(r["fallback_signal"] != 50 for r in got)
    for r in got:
        assert r["composite_pct"] == round(r["category_pct"] * 0.3 + r["segment_pct"] * 0.4 + r["lexical_pct"] * 0.2 + r["consistency_pct"] * 0.1)


def test_training_from_a_corpus(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 2).cast("int").alias("label"), F.col("source").alias("provenance"), F.col("lang").alias("source_family"),
        F.lit("x").alias("discipline"), F.lit(None).cast("string").alias("document_type"), F.lit("none").alias("editing_level"),
        F.lit(None).cast("map<string,double>").alias("external_scores"), F.size(F.split("text", " ")).alias("word_count"), "text",
    )
    registry, path = corpus.Registry(str(tmp_path / "models")), str(tmp_path / "report.json")
    assert not training.validation_status(path)["available"] and not training.calibration_status(None)["trained"]
    report = training.trained(rows, 2026, registry, path)
    assert report["sample_count"] == rows.count() and report["corpus_fit_metrics"]["value"] == "all"
    assert {r["grouping"] for r in report["by_group"]} <= {*corpus.GROUPS, "word_band"}
    found = training.validation_status(path)
    assert found["available"] and found["model_id"] == registry.status()["active"] and training.calibration_status(registry.active())["trained"]


def test_registered_functions(spark):
    registered.register(spark)
    texts = ["One here. Two there!\r\n\n  (Three) is. [4] is four? yes **Bold** one. **B**", "a\x0bB. C D. Ét", WORDY, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.createOrReplaceTempView("texts")
    names = ["doc_id", "paragraph_index", "sentence_index", "start", "end", "text"]
    got = spark.sql("SELECT doc_id, s.* FROM texts, LATERAL segments(text) s").toDF(*names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, seg.sentences(df).select(*names).collect()))
    one = spark.sql("SELECT rewrite_local('We did it in order to see.', 'balanced') AS x, rewrite_local(CAST(NULL AS STRING), 'deep') AS y").first()
    assert "in order to" not in one["x"] and one["y"] is None
