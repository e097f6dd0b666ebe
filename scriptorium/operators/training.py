"""Models from a labelled corpus: features, training, evaluation by group, the validation report, and what is installed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators import calibration, ensemble
from scriptorium.sources import corpus
from scriptorium.sources.scratch import stored


def feature_rows(samples: DataFrame, as_of_year: int) -> DataFrame:
    """Samples (of corpus.read_corpus; ids must be unique) without text, with word_band and the features of their text."""
    scores = ensemble.document_scores(samples.select(F.col("id").alias("doc_id"), "text"), as_of_year, private=True)
    features = scores.select(F.col("doc_id").alias("id"), *ensemble.FEATURES)
    return samples.withColumn("word_band", corpus.word_band(F.col("word_count"))).drop("text").join(features, "id")


def evaluated(rows: DataFrame, model: dict, groups: Sequence[str]) -> DataFrame:
    """grouping, value, metrics, roc_auc of rows(label, features, groups): all rows at the model's threshold, and at 0.5 every
    value of each group with four rows or more and both labels.  Null values are "unknown"; empty rows give no rows.
    """
    judged = calibration.predicted(rows, model).select("label", "probability", *[F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias(g) for g in groups])
    keys = ["grouping", "value"]
    whole = judged.select("label", "probability", F.lit("all").alias("grouping"), F.lit("all").alias("value"))
    pairs = F.array(*[F.struct(F.lit(g).alias("grouping"), F.col(g).alias("value")) for g in groups])
    each = judged.select("label", "probability", F.inline(pairs))
    overall = calibration.classification_metrics(whole, float(model.get("decision_threshold") or 0.5), keys).join(calibration.roc_auc(whole, keys), keys)
    by_group = calibration.classification_metrics(each, 0.5, keys).join(calibration.roc_auc(each, keys), keys)
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    return overall.unionByName(by_group.where((F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") >= 4) & both))


def trained(samples: DataFrame, as_of_year: int, registry: corpus.Registry, report_path: str, ceiling: float = 0.05, seed: int = 42) -> dict:
    """Trains on a corpus, registers the model, writes the validation report and returns it.

    The headline figures are of the locked test part; those by group are of the whole corpus and only describe it.
    """
    rows = stored(feature_rows(samples, as_of_year))
    model = calibration.train_best(rows, ensemble.FEATURES, ceiling, seed)
    model |= {"trained_at": datetime.now(UTC).isoformat(), "feature_schema_version": ensemble.SCHEMA_VERSION}
    name = registry.register(model)
    table = [r.asDict() for r in evaluated(rows, model, (*corpus.GROUPS, "word_band")).orderBy("grouping", "value").collect()]
    report = {
        "generated_at": model["trained_at"], "model_id": name, "selected_model": model["model_type"], "sample_count": model["sample_count"],
        "overall": model["test_metrics"], "validation_threshold_metrics": model["validation_metrics"], "candidate_metrics": model["candidate_metrics"],
        "decision_threshold": model["decision_threshold"], "max_human_fpr": model["max_human_fpr"],
        "split": {"train": model["train_count"], "validation": model["validation_count"], "locked_test": model["locked_test_count"]},
        "corpus_fit_metrics": next((r for r in table if r["grouping"] == "all"), {}), "by_group": [r for r in table if r["grouping"] != "all"],
        "external_disagreement": corpus.disagreement(samples).first().asDict(),
        "feature_importance": [r.asDict() for r in calibration.feature_importance(samples.sparkSession, model).collect()],
    }
    with open(report_path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, sort_keys=True)
    return report


def validation_status(report_path: str) -> dict:
    """The last report, with "available"; why not, where there is none."""
    try:
        with open(report_path, encoding="utf-8") as f:
            found = json.load(f)
    except FileNotFoundError:
        return {"available": False, "message": "no validation report was made yet"}
    except (OSError, json.JSONDecodeError):
        return {"available": False, "message": "the validation report cannot be read"}
    return {"available": True} | found


def calibration_status(model: dict | None) -> dict:
    """What a model is; "trained" is false where there is none, or one for other features."""
    if not model or model.get("feature_schema_version") != ensemble.SCHEMA_VERSION:
        return {"trained": False, "mode": "uncalibrated", "sample_count": 0}
    shown = ("model_type", "sample_count", "positive_count", "negative_count", "validation_metrics", "candidate_metrics", "trained_at")
    return {"trained": True, "mode": "calibrated", "feature_count": len(model["feature_names"])} | {k: model.get(k) for k in shown}
