"""One reading of a text measures what the columns of the operators measure."""

import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import scan
from scriptorium.functions import text as tx
from scriptorium.operators import ensemble, paragraphs, signals, style
from scriptorium.operators import segments as seg
from scriptorium.plans import demo

ODD = [
    "One here. Two there!\r\n\r\n  (Three) is it. [4] is four? yes **Bold** one.\x0b\x1cIt is clear that ſtudies ſhow a cost.\x85 Cleaŕ words are a‍b here and are there.",
    "Methods\nThis study, it is said, is old (Lee, 2019). This study is new; it is (Ng, 2020) — so they say — (Oh, 2021).\nReferences\nThey were read.",
    "Key factors are İt and ıt. Not only red but\nalso blue is seen. Furthermore, teams often leverage tools. Furthermore, it is. Furthermore, they are.",
    "1.1 Title here\nTable 1. Costs\na\tb\n12 34 56 78 90 12 are.\nNotes on x² are ½ done‿here and are kept apart.\n\n\xa0What is red, why is it red, how is it red?",
    "Appendix A\nAll of it is left out here.", "\x85 　", "", None,
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    return demo.documents(spark, sf).union(odd)


@pytest.fixture(scope="module")
def read(texts):
    return {r["doc_id"]: scan.Text(r["text"] or "") for r in texts.collect()}


def test_sentences_and_risks_agree(texts, read):
    want = {}
    for r in signals.scored_segments(seg.sentences(texts)).where("NOT protected").orderBy("doc_id", "index").collect():
        want.setdefault(r["doc_id"], []).append((r["paragraph_index"], r["sentence_index"], r["section"], r["start"], r["end"], r["risk"]))
    for doc_id, one in read.items():
        found = one.segments()
        risks = one.risks(found, scan.Rules(scan.folded(one.text)))
        got = [(p, i, section, at, at + len(s), risk) for (p, i, section, at, s), risk in zip(found, risks, strict=True)]
        assert got == want.get(doc_id, []), doc_id


def test_paragraphs_agree(texts, read):
    prose = seg.prose_text(seg.sentences(texts)).localCheckpoint()
    names = ("segment_count", "segment_mean", "segment_p75", "segment_p90", "flagged_segments")
    want = {r["doc_id"]: r for r in paragraphs.segment_distribution(paragraphs.segment_scores(prose)).collect()}
    assert len(want) > 100
    for r in prose.collect():
        one = scan.Text(r["text"])
        rules = scan.Rules(scan.folded(scan.GAP.sub(" ", one.text)))
        got = one.paragraphs(one.prose(one.text)[1], rules)
        assert got == {k: want[r["doc_id"]][k] for k in names}, r["doc_id"]


def test_a_text_is_read_once(texts):
    """F3, F4, F8: the scores took joins of six branches, each with patterns over all texts."""
    names = ["statistical_pct", "forensic_pct"]
    model = {"model_type": "logistic", "feature_names": names, "means": dict.fromkeys(names, 0.0), "scales": dict.fromkeys(names, 1.0), "weights": dict.fromkeys(names, 0.0), "bias": 0.0}
    for scores in (
        ensemble.document_scores(texts, 2026), ensemble.document_scores(texts, 2026, private=True).select("doc_id", *ensemble.FEATURES),
        ensemble.document_scores(texts, 2026, private=True, model=model),
    ):
        steps = re.findall(r"(?m)^[\s+\-:]*(\w+)", scores._jdf.queryExecution().optimizedPlan().toString())
        assert not {"Join", "Window", "Aggregate", "Sort"} & set(steps) and steps.count("ArrowEvalPython") == 1


def test_a_text_without_prose_has_no_layers(spark):
    docs = spark.createDataFrame([(1, "References\nSmith is here."), (2, None)], "doc_id long, text string")
    for r in ensemble.document_scores(docs, 2026, private=True).collect():
        assert [r[k] for k in (*ensemble.LAYERS, "ai_signal", "perplexity_proxy", "section_other_mean")] == [0] * 7 and r["decision_status"] == "Indeterminate"


def test_flagged_ranges(texts):
    want = signals.scored_segments(seg.sentences(texts)).where("NOT protected AND risk >= 25").select("doc_id", "start", "end")
    got = ensemble.document_scores(texts, 2026, private=True).select("doc_id", F.inline("flagged_at"))
    assert got.count() > 10 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


PLAIN = "The hen sat by one barn (so it did); the cat, the dog, the cow sat there. Red was put there by the men at noon. "


def test_sentences_without_a_literal_meet_no_pattern(monkeypatch):
    """F4, F8: every pattern of a document was looked for in each of its sentences."""
    tried, worded = [], scan.Text.worded
    monkeypatch.setattr(scan.Text, "worded", lambda self, s, rules: tried.append(s) or worded(self, s, rules))
    (one,) = scan.documents([PLAIN * 20 + "Furthermore, teams often leverage tools."])
    assert tried == ["Furthermore, teams often leverage tools."] and one["assessed_sentences"] == 41


def test_what_is_left_out_changes_no_measure(texts, monkeypatch):
    """F4, F8: the same measures where no sentence is known to be without literals, and with less or more at once."""
    every = [r["text"] for r in texts.collect()] + [PLAIN * 3 + "A\x1cB is red. Teams  often\tsee\x1d\nus all."]
    got = scan.documents(every)
    without = scan.documents(every, naturalness=False)
    assert [{k: v for k, v in x.items() if k != "own_style"} for x in got] == without and all("own_style" in x for x in got)
    monkeypatch.setattr(scan, "MOST_AT_ONCE", 1)
    assert scan.documents(every) == got
    monkeypatch.setattr(scan, "_cold", lambda each: set())
    assert scan.documents(every) == got
    assert not any(c in x for x in scan.LITERALS for c in ".!?\n")


def test_naturalness_is_measured_where_it_is_wanted(texts):
    """F4, F8: the style of the whole text was measured for queries that do not show it."""
    scores, less = (ensemble.document_scores(texts, 2026, private=True, naturalness=x) for x in (True, False))
    assert set(scores.columns) - set(less.columns) == {"naturalness_score"}
    assert "own_style" not in less._jdf.queryExecution().optimizedPlan().toString()
    shown = [k for k in less.columns if k != "flagged_at"]
    assert less.select(*shown).exceptAll(scores.select(*shown)).count() == 0


def test_context_is_measured_where_it_is_wanted(texts, monkeypatch):
    """the risk of each sentence within its document was measured for scores that are not made of it."""
    every = ["", "References\nSmith is here."] + [r["text"] for r in texts.limit(60).collect()]
    want = scan.documents(every, naturalness=False)
    monkeypatch.setattr(scan.Text, "risks", None)
    assert scan.documents(every, naturalness=False, context=False) == [{k: v for k, v in x.items() if k not in ("sections", "flagged_at")} for x in want]


def test_scores_without_context(texts):
    """the other columns stay; a model that takes a feature of sections has them measured."""
    some = texts.where("doc_id < 40")
    scores, less = (ensemble.document_scores(some, 2026, private=True, naturalness=False, context=x) for x in (True, False))
    assert set(scores.columns) - set(less.columns) == {"flagged_at"} | ensemble.SECTION_FEATURES
    assert less.exceptAll(scores.select(*less.columns)).count() == 0
    names = ["section_other_mean", "statistical_pct"]
    model = {"model_type": "logistic", "feature_names": names, "means": {}, "scales": {}, "weights": dict.fromkeys(names, 0.1), "bias": -1.0}
    with_context, without = (ensemble.document_scores(some, 2026, private=True, model=model, naturalness=False, context=x).select("doc_id", "ai_signal") for x in (True, False))
    assert with_context.exceptAll(without).count() == 0


def test_repeated_runs_of_many_different_words(monkeypatch):
    """runs are numbers now; they are dealt anew where those would grow too large."""
    words = [5, 6, 7, 8] * 4 + [1, 2] * 3
    stock = [False] * 9
    few = scan._repeated_units(scan.np.array(words), scan.np.array(stock))
    many = scan._repeated_units(scan.np.array(words), scan.np.array(stock + [False] * 3_000_000))
    assert few == many > 0


SLIPS = [
    "It is teh cost.The rate is red .  Is it? Yes, it is:: so.\n, It is so ; it was.\nHe is İ.ſet and was here. They were seperate. \n\n  DEFINATELY it is occured!",
    "A cost is p =\n2.5 and is high. It is p < 1 and may be β = -1.5. It is Ϸp > -0.2 here. A rate was rho = 0.4 and ϐ=1.01 too. It is r\x0b=\u30003 now.",
    "It was 250% in 1999. It is 99.5% and was x120% or .300% then, but 1000.5% is. Studies show it is so. Research shows (Lee, 2019) it is. Experts agree it is (so).",
    "It was recently seen in 1987. Nowadays it was not. The latest is 1901a and is 2099.", "It is today's cost and is emerging. It is contemporary. It is 2050 that is meant.",
    "Clearly it is always so. None of it was ever so, as all is never certainly proved. It proves all is obviously so.", "It was recently here in 1999 and 2001.",
    "It is so. " * 90, "It is so. They were there by noon. " * 120 + "\nReferences\nIt is teh end .",
]


def in_columns(segments, year):
    """The fingerprint as it was made before: by joins over sentences and words."""
    prose, own, c, t = seg.prose_text(segments), segments.where("NOT protected"), F.col, style.Variation()
    named = own.select("doc_id", style.syntactic_signature(c("text")).alias("x")).groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"))
    repeated = F.when((c("x") != "other") & (c("n") >= 3), c("n")).otherwise(0)
    claims = own.groupBy("doc_id").agg(F.count_if(tx.has(c("text"), lx.UNSUPPORTED) & ~tx.has(c("text"), lx.CITATION)).alias("unsupported"))
    blocks = F.filter(F.transform(F.split("text", r"(?U)\n\s*\n"), tx.strip), lambda p: p != "")
    density = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(style.content_density(c("text")))).alias("s"))
    density = prose.select("doc_id", F.transform(blocks, style.content_density).alias("p")).join(density, "doc_id")
    joined = (
        prose.join(style.style_report(prose), "doc_id")
        .join(style.top_token_share(prose).drop("n_words"), "doc_id", "left")
        .join(style.ngram_repetition(prose).select("doc_id", "ngram_pct"), "doc_id", "left")
        .join(density.select("doc_id", style.evenness(F.size("s"), tx.variation(c("s")), F.size("p"), tx.variation(c("p"))).alias("semantic_pct")), "doc_id", "left")
        .join(named.groupBy("doc_id").agg((F.sum(repeated) / F.sum("n")).alias("syntax_share")), "doc_id", "left")
        .join(claims, "doc_id", "left").na.fill(0)
    )
    total, typos = tx.n_words(c("text")), tx.hits(c("text"), lx.TYPO)
    metrics = style.weighted_metrics(t, tx.hits(c("text"), lx.TRANSITION_WORDS)) | {
        "typo_absence": F.when(typos > 0, F.greatest(F.lit(0), 25 - typos * 4)).otherwise(F.when(total < 250, 0).when(total < 800, 55).otherwise(75)),
        "temporal_awareness": style.temporal_score(c("text"), year), "hallucination_patterns": style.implausibility(c("text"), c("unsupported")),
    }
    return joined.select("doc_id", *[v.cast("int").alias(k) for k, v in metrics.items()])


def test_fingerprints_agree(spark, texts):
    """all but the statistical percentage is as the joins made it, without prose there is no row."""
    docs = texts.union(spark.createDataFrame([(-100 - i, t) for i, t in enumerate(SLIPS)], "doc_id long, text string"))
    got = style.fingerprint(docs, 2026).localCheckpoint()
    names = ["doc_id", *(k for keys in style.GROUPS.values() for k in keys)]
    want = in_columns(seg.sentences(docs), 2026).select(*names).localCheckpoint()
    assert want.count() > 100 and want.exceptAll(got.select(*names)).count() == 0 and got.select(*names).exceptAll(want).count() == 0
    slips = {r["doc_id"]: r for r in got.where("doc_id <= -100").collect()}
    assert len(slips) == len(SLIPS) and all(len({r[k] for r in slips.values()}) > 2 for k in ("typo_absence", "temporal_awareness", "hallucination_patterns"))
    assert all(r["primary_pct"] == round((r["perplexity_proxy"] + r["burstiness"] + r["token_distribution_proxy"]) / 3) for r in got.collect())


def test_typos_are_counted_by_sentence(texts, read):
    """the typos of sentences and of what parts them are those of the prose."""
    every = [r["text"] for r in texts.collect()] + SLIPS
    for one, segments, _ in scan._read(every, typos=True):
        if segments:
            assert scan._fingerprint(one, segments, {})["typos"] == len(scan.TYPO.findall(scan._prose(one, segments)))


def test_a_fingerprint_takes_one_reading(texts):
    """it took joins of seven branches, each with patterns over all texts; 1 GB failed by time."""
    plan = style.fingerprint(texts, 2026)._jdf.queryExecution().optimizedPlan().toString()
    steps = re.findall(r"(?m)^[\s+\-:]*(\w+)", plan)
    assert not {"Join", "Window", "Aggregate", "Sort"} & set(steps) and steps.count("ArrowEvalPython") == 1


def test_digits_of_other_scripts_are_read():
    """a year or value in other digits than ASCII ones ended the query, as they were cast."""
    ((found,),) = scan.fingerprints(["It is in 20٢٣ that it was so. It is p = ٣ here."])
    assert (found["latest"], found["p_values"]) == (2023, 1)
