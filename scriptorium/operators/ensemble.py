"""From documents to one explained, abstaining score each.

The score describes writing style.  It is no proof of authorship, and it abstains
where its layers disagree or the text is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx
from scriptorium.operators import calibration, families, measures, paragraphs, style

SCHEMA_VERSION = "1-prose-coverage"
LAYERS = {"category_pct": 0.25, "statistical_pct": 0.35, "segment_pct": 0.30, "consistency_pct": 0.10}
#: With a language model's curvature as a fifth layer.
LAYERS_WITH_CURVATURE = {"category_pct": 0.20, "statistical_pct": 0.30, "segment_pct": 0.25, "consistency_pct": 0.10, "curvature_pct": 0.15}
REFERENCE_FEATURES = ("perplexity", "surprisal_mean", "surprisal_std", "low_surprisal_share", "curvature_abs_mean", "curvature_std", "curvature_regular_share")
FEATURES = (
    "forensic_pct", "statistical_pct", "paragraph_pct", "regularity_pct", *list(style.FINGERPRINT), "segment_p90", "flagged_segment_ratio",
    *(f"reference_{x}" for x in REFERENCE_FEATURES), *(f"section_{s}_mean" for s in lx.PROFILE_SECTIONS), "section_score_spread",
)
SECTION_FEATURES = frozenset((*(f"section_{s}_mean" for s in lx.PROFILE_SECTIONS), "section_score_spread"))


def ensemble(layers: dict[str, float], values: dict[str, Column] | None = None) -> Column:
    """The weighted layers, and 8 more if three of them reach 35, 4 if two do; 0 to 100."""
    cols = values or {k: F.col(k) for k in layers}
    base = F.bround(sum((cols[k] * w for k, w in layers.items()), F.lit(0.0)), 0).cast("int")
    high = tx.count_true(cols[k] >= 35 for k in layers)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + F.when(high >= 3, 8).when(high >= 2, 4).otherwise(0)))


def composite(category: Column, segment: Column, lexical: Column, consistency: Column) -> Column:
    """The percentage by itself, before any fingerprint: 30 % categories, 40 % segments, 20 % lexical, 10 % consistency; 0 to 100."""
    return tx.percent(category * 0.30 + segment * 0.40 + lexical * 0.20 + consistency * 0.10)


def decision(signal: Column, layers: list[Column], words: Column, sentences: Column) -> Column:
    """"Indeterminate" near the middle, where layers are 50 apart, and under 80 words or three sentences."""
    spread = F.greatest(*layers) - F.least(*layers)
    return (
        F.when((words < 80) | (sentences < 3) | signal.between(40, 60) | ((spread >= 50) & signal.between(20, 80)), "Indeterminate")
        .otherwise("Result available")
    )


def _sections() -> dict[str, Column]:
    """The mean risk of each section, 0 of one that the text lacks, and how far those that it has are apart."""
    means = F.transform("sections", lambda s: F.struct(s["section"].alias("section"), F.round(s["total"] / s["n"], 2).alias("mean")))
    by_name = F.map_from_entries(F.col("means"))
    each = {f"section_{k}_mean": F.coalesce(F.try_element_at(by_name, F.lit(k)), F.lit(0.0)) for k in lx.PROFILE_SECTIONS}
    all_means = F.transform("means", lambda m: m["mean"])
    spread = F.when(F.size("means") >= 2, F.round(F.array_max(all_means) - F.array_min(all_means), 2)).otherwise(0.0)
    return {"means": means} | each | {"section_score_spread": spread}


def _measured(docs: DataFrame, naturalness: bool, context: bool) -> DataFrame:
    """One row per document: what the layers, the fingerprint, the families and the features are made of, in columns by name; one reading of each text."""
    measure = measures.document(naturalness, context)
    m, c = F.col("m"), F.col
    # dealt out anew, as a file of a few MB may hold work for an hour
    rows = docs.repartition("doc_id").select("doc_id", measure(F.col("text")).alias("m"))
    wide = rows.select(
        "doc_id", m["style"].isNotNull().alias("has_prose"), *[m[k].alias(k) for k in ("total_words", "assessed_words", "assessed_sentences", "assessed_paragraphs", *("sections", "flagged_at") * context)],
        F.greatest(F.lit(0), m["total_words"] - m["assessed_words"]).alias("excluded_words"), *style.report_of(m["style"])[1:],
        *[style.report_of(m["own_style"])[0].alias("naturalness_score")] * naturalness, "m.families.*", "m.paragraphs.*", "m.distribution.*",
    )
    if context:
        sections = _sections()
        wide = wide.withColumn("means", sections.pop("means")).withColumns(sections)
    return wide.withColumns(
        {
            "segment_pct": F.when(c("has_prose"), paragraphs.risk_of(c("segment_mean"), c("segment_p75"), c("segment_p90"))),
            "ngram_pct": style.ngram_share(c("repeated_units"), c("n_words")),
            "semantic_pct": style.evenness(c("sn"), c("density_s_cv"), c("pn"), c("density_p_cv")),
        }
    )


def document_scores(
    docs: DataFrame, as_of_year: int, reference_lm: DataFrame | None = None, private: bool = False, model: dict | None = None, naturalness: bool = True,
    context: bool = True,
) -> DataFrame:
    """One row per document with prose: doc_id, ai_signal, human_like, level, decision_status, confidence, layers, coverage.

    With a calibrated `model` (of `calibration`, made for FEATURES) its percentage is the signal in
    place of the weighted layers, which stay as fallback_signal.  With `private` also naturalness
    (which measures the whole text too; unless `naturalness` is False), families, the features for calibration, composite_pct, fallback_signal, score_source and the ranges
    of flagged sentences (flagged_at); without `context` these ranges and the features of sections, which no other column
    is made of, are not measured, unless the model takes such a feature.  Documents without prose (null and empty texts too) get a signal of 0 and "Indeterminate".
    reference_lm(doc_id, the reference features, curvature_pct) is optional; without it those features are 0.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    context = private and context or model is not None and not SECTION_FEATURES.isdisjoint(model["feature_names"])
    measured = _measured(docs, private and naturalness, context)
    has_prose = F.col("has_prose")  # without prose all layers are 0
    prints = {k: F.when(has_prose, v.cast("int")) for k, v in style.weighted_metrics(style.Variation(), F.col("transitions")).items()}
    joined = families.judged(measured.withColumns(prints).withColumn("statistical_pct", F.when(has_prose, style.statistical())))
    layers = LAYERS
    if reference_lm is not None:
        layers = LAYERS_WITH_CURVATURE
        joined = joined.join(reference_lm, "doc_id", "left")
    joined = joined.na.fill(0).na.fill({"confidence": "Low", "verdict": "Human"}).withColumn("fallback_signal", ensemble(layers))
    joined = _with_signal(joined, model, reference_lm is not None)
    status = decision(F.col("ai_signal"), [F.col(k) for k in layers], F.col("assessed_words"), F.col("assessed_sentences"))
    short = (F.col("assessed_words") < 80) | (F.col("assessed_sentences") < 3)
    out = joined.withColumn("decision_status", status).withColumns(
        {
            "human_like": 100 - F.col("ai_signal"),
            "level": tx.level(F.col("ai_signal")),
            "confidence": F.when(short, "Low")
            .when((F.col("decision_status") == "Indeterminate") & (F.col("confidence") == "High"), "Medium")
            .otherwise(F.col("confidence")),
        }
    )
    public = [
        "doc_id", "ai_signal", "human_like", "level", "decision_status", "confidence", *layers, "lexical_pct", "total_words", "assessed_words",
        "excluded_words", "assessed_sentences", "assessed_paragraphs", "segment_count",
    ]
    if not private:
        return out.select(*public)
    whole = composite(*[F.col(k) for k in ("category_pct", "segment_pct", "lexical_pct", "consistency_pct")]).alias("composite_pct")
    scored = [*public, *["flagged_at"] * context, *["naturalness_score"] * naturalness, *lx.FAMILY_WEIGHTS, "J", "verdict", whole, "fallback_signal", "score_source"]
    return out.select(*scored, *features_of(out, reference_lm is not None))


def _with_signal(rows: DataFrame, model: dict | None, with_reference: bool) -> DataFrame:
    """`rows` with ai_signal and score_source: of the model where there is one, else of the layers."""
    if model is None:
        return rows.withColumns({"ai_signal": F.col("fallback_signal"), "score_source": F.lit("ensemble")})
    names = [k for k in FEATURES if k != "statistical_pct" and (k not in SECTION_FEATURES or "means" in rows.columns)]
    features = [x for k, x in zip(names, features_of(rows, with_reference), strict=True) if k not in rows.columns]
    judged = calibration.predicted(rows.select("*", *features), model)
    return judged.select(*rows.columns, F.col("percentage").cast("int").alias("ai_signal"), F.lit("calibrated").alias("score_source"))


def features_of(scores: DataFrame, with_reference: bool) -> list[Column]:
    """The feature columns, in the order of FEATURES; all doubles."""
    c = F.col
    ratio = F.bround(c("flagged_segments") / F.greatest(F.lit(1), c("segment_count")) * 100, 4)
    named = {"forensic_pct": c("category_pct"), "paragraph_pct": c("segment_pct"), "regularity_pct": c("consistency_pct"), "flagged_segment_ratio": ratio}
    for x in REFERENCE_FEATURES:
        share = x.endswith("_share")
        named[f"reference_{x}"] = (c(x) * (100 if share else 1)) if with_reference else F.lit(0.0)
    taken = {"statistical_pct"}  # already among the public columns
    if "means" not in scores.columns:  # sections were not measured
        taken |= SECTION_FEATURES
    return [named.get(k, c(k)).cast("double").alias(k) for k in FEATURES if k not in taken]


def reference_features(tokens: DataFrame, low: float = 1.5) -> DataFrame:
    """doc_id and the reference features, from tokens(doc_id, surprisal array<double>), as any causal language model gives them.

    Curvature is the second difference of surprisal; it is regular up to half its mean size, or a quarter.
    Texts of fewer than three tokens have no row.
    """
    s, c = F.col("surprisal"), F.col
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("longest"))

    def follow(acc: Column, x: Column) -> Column:
        run = F.when(x <= low, acc["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["longest"], run).alias("longest"))

    def differences(x: str) -> Column:
        return F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.size(x) - 1), lambda b, a: b - a)

    out = tokens.where(F.size("surprisal") >= 3).withColumn("d1", differences("surprisal")).withColumn("d2", differences("d1"))
    out = out.withColumns({"mean": tx.mean(s), "size": tx.mean(F.transform("d2", F.abs))})
    regular = F.size(F.filter("d2", lambda x: F.abs(x) <= F.greatest(F.lit(0.25), c("size") * 0.5))) / F.size("d2")

    def quantile(q: float) -> Column:
        v, at = F.sort_array(s), (F.size(s) - 1) * F.lit(q)
        a, b = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return F.round(a + (b - a) * (at - F.floor(at)), 4)

    return out.select(
        "doc_id", F.round(F.exp(F.least(F.lit(20.0), c("mean"))), 4).alias("perplexity"), F.round("mean", 4).alias("surprisal_mean"),
        F.round(tx.deviation(s), 4).alias("surprisal_std"), quantile(0.1).alias("surprisal_p10"), quantile(0.5).alias("surprisal_p50"),
        quantile(0.9).alias("surprisal_p90"), F.round(F.size(F.filter(s, lambda x: x <= low)) / F.size(s), 4).alias("low_surprisal_share"),
        F.aggregate(s, zero, follow, lambda acc: acc["longest"]).alias("longest_low_run"), F.round("size", 4).alias("curvature_abs_mean"),
        F.round(tx.deviation(c("d2")), 4).alias("curvature_std"), F.round(regular, 4).alias("curvature_regular_share"),
        tx.percent(regular * 100).alias("curvature_pct"),
    )
