"""Sentence signals and segmentation on sentences whose scores follow from the rules by hand."""

import time

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import literals
from scriptorium.functions import text as tx
from scriptorium.operators import ensemble, families, paragraphs, preservation, segments, signals, style


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


CASES = [
    ("Moreover, staff leverage robust tools.", 38, 38, ["A", "F"]),
    ("Scores often vary — a point worth stating — across sites.", 41, 41, ["C", "G"]),
    ("It turns out that cost matters.", 40, 40, ["F", "I"]),
    ("Yields improved recently.", 8, 22, ["B"]),
    ("Sales rose 140% in 2021.", 0, 22, ["B"]),
]


def test_sentence_scores(spark):
    got = signals.scored_segments(segments.sentences(docs(spark, [c[0] for c in CASES]))).orderBy("doc_id").collect()
    assert [(r["own_risk"], r["risk"], r["signal_keys"]) for r in got] == [c[1:] for c in CASES]


def test_offsets_sections_and_protection(spark):
    texts = ["Abstract\r\n  This is one. It was two!  Was it three?\n\n4. Results\nThe score was good.\nReferences\nSmith was here in 2020.", None, "", "\n \n"]
    got = segments.sentences(docs(spark, texts)).orderBy("doc_id", "index").collect()
    assert all(texts[0][r["start"] : r["end"]] == r["text"] for r in got)
    assert [r["text"] for r in got][1:4] == ["This is one.", "It was two!", "Was it three?"]
    assert [r["section"] for r in got] == ["abstract"] * 4 + ["results"] * 3 + ["references"] * 2
    assert [r["protected"] for r in got] == [True, False, False, False, True, True, False, True, True]


def test_counts_look_at_the_document(spark):
    text = "The team was here today with all. The team was here now with us. The team was here then with them."
    got = signals.scored_segments(segments.sentences(docs(spark, [text]))).collect()
    assert all("Repeated sentence opening: “the team was”" in r["reasons"] for r in got)


def test_numbers(spark):
    assert one(spark, F.round(tx.variation(F.array(F.lit(4), F.lit(8))), 4)) == 0.3333
    assert one(spark, tx.percentile(F.array(F.lit(10), F.lit(20), F.lit(31)), 0.75)) == 26
    assert one(spark, F.round(tx.type_token_ratio(F.lit("a b a")), 4)) == 0.6667
    for weak, moderate, strong, want in ((4, 0, 0, 3), (2, 0, 0, 2), (0, 1, 0, 2), (0, 2, 0, 3), (0, 0, 1, 3), (1, 0, 0, 1), (0, 0, 0, 0)):
        assert one(spark, tx.severity(F.lit(weak), F.lit(moderate), F.lit(strong))) == want
    for values, want in (((40, 40, 20, 10), 35), ((40, 40, 40, 0), 44)):
        assert one(spark, ensemble.ensemble(ensemble.LAYERS, dict(zip(ensemble.LAYERS, map(F.lit, values), strict=True)))) == want


def test_runs(spark):
    s = F.array(*[F.lit(f"{x} {x} end.") for x in "aabaaa"])
    assert [(r["start"], r["n"]) for r in one(spark, families.longest_runs(s))] == [("a a", 2), ("a a", 3)]


def test_lexical_diversity_is_linear(spark):
    # windows over one long text: the tokens are found once, not once for each window
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(60000)]
    began = time.monotonic()
    assert one(spark, tx.type_token_ratio(F.lit(" ".join(words)))) == 1.0
    assert time.monotonic() - began < 20


def test_deviation_is_linear(spark):
    # the mean is taken once, not once for each value
    began = time.monotonic()
    assert one(spark, F.round(tx.deviation(F.sequence(F.lit(1), F.lit(60000))), 3)) == 17320.508
    assert time.monotonic() - began < 10


def test_needed_texts_stand_in_every_match(spark):
    assert literals.needed(r"\bnot only\b.+?\bbut also\b") in (("not only",), ("but also",))
    assert literals.needed(r"\b(?:it has been found that|research suggests)\b") == ("it has been found that", "research suggests")
    assert literals.needed(r"\b\w+ed\b") is None and literals.needed(r"(?:abc|\d)x?") is None
    for text in ("Neverthele\u017f\u017f, it \u0130s important to note", "ta\u212aen together", "\u0131n today's world", None, ""):
        for p in (r"\bit is important to note\b", r"\btaken together\b", r"\bin today's world\b", r"neverthele(?:ss)"):
            t = F.lit(text).cast("string")
            assert one(spark, tx.has(t, p)) == one(spark, t.rlike(tx.rx(p)))
            assert one(spark, tx.hits(t, p)) == one(spark, F.regexp_count(t, F.lit(tx.rx(p))))


def test_overlap_is_half_open(spark):
    lines = spark.createDataFrame([(1, 0, 10)], "doc_id long, start int, end int")
    for a, b, n in ((10, 20, 0), (9, 20, 1)):
        assert signals.overlapping_lines(lines, spark.createDataFrame([(1, a, b)], "doc_id long, start int, end int")).count() == n


@pytest.mark.parametrize(
    ("a", "b", "why"),
    [
        ("It does not establish this.", "It does establish this.", ["claim_qualifiers changed", "word count changed"]),
        ("A 5% rise in 2020 (Lee, 2020).", "A 5% rise in 2020 (Lee, 2020).", []),
        ("See NASA data.", "See nasa data.", ["acronyms changed"]),
        ("We may go home.", "We can go home.", ["claim_qualifiers changed"]),
    ],
)
def test_gate(spark, a, b, why):
    assert one(spark, preservation.broken(F.lit(a), F.lit(b), 0.06)) == why


def test_terms_and_certificate(spark):
    terms = F.array(F.lit("alpha beta"))
    assert one(spark, preservation.broken(F.lit("An alpha beta test."), F.lit("An alpha gamma test."), 0.5, terms)) == ["protected term changed: alpha beta"]
    assert one(spark, preservation.certificate(F.lit("In 2020."), F.lit("In 2021.")))["passed"] is False


FORMULAIC = (
    "Furthermore, it is important to note that teams often leverage a myriad of tools. Moreover, this highlights the importance of a comprehensive view. "
    "Additionally, it is clear that the results typically facilitate a nuanced reading. Furthermore, research suggests that institutions generally utilize such tools. "
) * 3
PLAIN = "We sampled forty wells near the river in May. Two were dry. The pump at the north end failed twice, so its readings were dropped from the table. Costs fell. "


def test_scores_order_texts(spark):
    got = {r["doc_id"]: r for r in ensemble.document_scores(docs(spark, [FORMULAIC, PLAIN * 3, None, ""]), 2026, private=True).collect()}
    assert len(got) == 4
    assert got[0]["ai_signal"] > got[1]["ai_signal"] and got[0]["A"] == 3 and got[0]["F"] == 3
    assert all(r["ai_signal"] + r["human_like"] == 100 for r in got.values())
    assert got[2]["ai_signal"] == got[3]["ai_signal"] == 0 and got[2]["decision_status"] == "Indeterminate"
    assert set(ensemble.FEATURES) <= set(got[0].asDict())


def test_references_do_not_change_prose(spark):
    long = PLAIN * 8
    got = ensemble.document_scores(docs(spark, [long, long + "\nReferences\nFurthermore, it is important to note (Smith, 2020)."]), 2026).orderBy("doc_id").collect()
    assert [r["ai_signal"] for r in got][0] == [r["ai_signal"] for r in got][1]


def test_every_paragraph_is_scored(spark):
    line = "The wells were sampled in May and again in June by two teams who wrote down each reading with care. Nothing was lost."
    prose = segments.prose_text(segments.sentences(docs(spark, ["\n".join([line] * 135)])))
    assert paragraphs.segment_scores(prose).count() == 135


def test_style_of_edges(spark):
    got = style.style_report(docs(spark, [None, "", "One.", "References\nOnly a tail here."])).orderBy("doc_id").collect()
    assert [r["paragraph_count"] for r in got] == [0, 0, 0, 0] and all(0 <= r["naturalness_score"] <= 100 for r in got)
