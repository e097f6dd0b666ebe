"""Edits are measured and gated where they are made, and agree with the columns of the gate."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import evidence
from scriptorium.operators import ensemble, measures, preservation, rewrite, workflow
from scriptorium.plans import demo

WORDY = "It is important to note that the results obtained are clear (Smith, 2020). Moreover, we conducted an analysis of 42 sites in New York in order to delve into costs."
PLAIN = "Plain words were read here."
ODD = [
    ("1. Title here\r\nA cost of 1,200.5 and 30% in 2021a.\r2) item two is here\x85| a | b |\x85x\ty", "2. Title here\rA cost of 1,200.5 and 30% in 2021.\r\n2) item two is here | a | b | x y"),
    ("References\x0bSmith (2020) x² = 3 [see] $$a\n= b$$ a@b.org doi: 10.1234/x", "  # References\nSmith (2020) x³ = 3 [saw] $$a = b$$ a@b.orgs doi:10.1234/x"),
    ("We may not go. It isn’t so and must never aim to be NASA_X.", "We might go. It is so and should never aims to be NASA_Y."), ("", "x"), ("a b c", "a b c"), (" | a\n", "| a |"),
]


@pytest.fixture(scope="module")
def pairs(spark, sf):
    other = F.replace(F.replace(F.col("text"), F.lit("20"), F.lit("19")), F.lit(" a"), F.lit("\n A"))
    docs = demo.documents(spark, sf).where("text IS NOT NULL").select(F.col("text").alias("a"), other.alias("b"))
    return docs.union(spark.createDataFrame(ODD, "a string, b string"))


def test_the_gate_agrees(pairs):
    terms = F.array(F.lit("New York"), F.lit("a"))
    rows = pairs.select("a", "b", preservation.broken(F.col("a"), F.col("b"), 0.06, terms).alias("want")).collect()
    assert any(r["want"] for r in rows) and not all(r["want"] for r in rows)
    for r in rows:
        assert evidence.broken(evidence.Evidence(r["a"]), evidence.Evidence(r["b"]), 0.06, ["New York", "a"]) == r["want"], r["a"][:80]


def test_the_certificate_agrees(pairs):
    terms = F.array(F.lit("New York"))
    got = pairs.select(preservation.certificate(F.col("a"), F.col("b"), terms).alias("x"), measures.certificate(F.col("a"), F.col("b"), terms).alias("y"))
    assert [r for r in got.collect() if r["x"] != r["y"]] == []


def steps(df):
    return re.findall(r"(?m)^[\s+\-:]*(\w+)", df._jdf.queryExecution().optimizedPlan().toString())


def test_local_edits_need_no_join(spark):
    """sources, candidates, their reports and their issues were joined, each read by itself."""
    docs = spark.createDataFrame([(1, WORDY), (1, PLAIN), (None, None), (2, "  ")], "doc_id long, text string")
    out = rewrite.rewritten(docs, "deep")
    assert not {"Join", "Window", "Aggregate"} & set(steps(out))
    got = {r["text"]: r for r in out.collect()}
    assert len(got) == 4 and got[PLAIN]["applied"] is False and got[PLAIN]["applied_level"] == "deep" and got[""]["applied_level"] is None
    assert any(r["applied"] and r["score_after"] >= r["score_before"] and "delve" not in t for t, r in got.items())


def test_guided_edits_take_the_ranges_of_the_scores(spark):
    """sentences were scored a second time for the ranges."""
    docs = spark.createDataFrame([(1, WORDY + "\n" + PLAIN), (2, PLAIN)], "doc_id long, text string")
    scores = ensemble.document_scores(docs, 2026, private=True)
    got = {r["doc_id"]: r for r in rewrite.rewritten_guided(docs, scores, mode="deep").collect()}
    assert got[1]["applied"] and got[1]["text"].endswith(PLAIN) and not got[2]["applied"]


@pytest.mark.parametrize("run", [workflow.edited_documents, workflow.robustness])
def test_only_what_changed_is_scored_again(spark, monkeypatch, run):
    """all texts were scored anew after each edit."""
    scored, real = [], ensemble.document_scores

    def counted(docs, *args, **more):
        scored.append(docs.count())
        return real(docs, *args, **more)

    monkeypatch.setattr(ensemble, "document_scores", counted)
    docs = spark.createDataFrame([(1, WORDY), (2, PLAIN), (3, None), (1, PLAIN)], "doc_id long, text string")
    assert len(run(docs, 2026).collect()) == 4
    assert scored[0] == 4 and scored[1:] and max(scored[1:]) == 1
