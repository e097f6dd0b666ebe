"""The labelled corpus as JSON lines, and the registry of models."""

from __future__ import annotations

import json
import os
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

#: Where texts come from; all but the first two are label 1.
PROVENANCE = (
    "human_original", "human_edited", "gpt_generated", "claude_generated", "gemini_generated", "other_ai_generated", "ai_human_edited",
    "human_ai_edited", "engine1_output", "engine2_output", "engine3_output",
)
#: Other tools that rewrite text, whatever their name.
OTHER_TOOL = "^other_[a-z]+_output$"
SCHEMA = (
    "id string, created_at timestamp, label int, provenance string, source_family string, discipline string, document_type string, "
    "editing_level string, external_scores map<string, double>, notes string, word_count int, text string"
)
GROUPS = ("provenance", "source_family", "discipline", "document_type", "editing_level")


def read_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Samples with text and a label of 0 or 1.  Bad lines are left out, or an error if `strict`."""
    if strict:
        rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
        ok = F.col("label").isin(0, 1) & (tx.strip(F.coalesce("text", F.lit(""))) != "")
        return rows.withColumn("label", F.when(ok, F.col("label")).otherwise(F.raise_error(F.lit("a sample lacks text or a label")).cast("int")))
    rows = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where(F.col("_bad").isNull() & F.col("label").isin(0, 1) & (tx.strip(F.col("text")) != "")).drop("_bad")


def label_of(provenance: Column) -> Column:
    return F.when(provenance.isin(*PROVENANCE[:2]), 0).otherwise(1)


def sanitised_scores(scores: Column) -> Column:
    """map<string, double> of the scores (map<string, string>) that are numbers from 0 to 100; keys in lower case, two places."""
    numbers = F.transform_values(scores, lambda _, v: v.try_cast("double"))
    kept = F.map_filter(numbers, lambda _, v: v.between(0, 100))
    return F.transform_values(F.transform_keys(kept, lambda k, _: F.lower(tx.strip(k))), lambda _, v: F.round(v, 2))


def word_band(words: Column) -> Column:
    return F.when(words < 250, "<250").when(words <= 1000, "250-1000").otherwise(">1000")


def samples(raw: DataFrame) -> DataFrame:
    """Validated samples of raw(text, provenance and, optionally, the other columns), ready to append.

    Texts of under 40 words and unknown provenance are errors; the rest is trimmed to its limits.
    """
    text = tx.strip(F.col("text"))
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    bad = ~(F.col("provenance").isin(*PROVENANCE) | F.col("provenance").rlike(OTHER_TOOL)) | (words < 40)

    def cut(name: str, other: str, most: int = 80) -> Column:
        value = tx.strip(F.col(name)) if name in raw.columns else F.lit(other)
        return F.substring(F.coalesce(F.nullif(value, F.lit("")), F.lit(other)), 1, most).alias(name)

    scores = sanitised_scores(F.col("external_scores")) if "external_scores" in raw.columns else F.lit(None).cast("map<string, double>")
    return raw.select(
        F.expr("replace(uuid(), '-', '')").alias("id"), F.current_timestamp().alias("created_at"), label_of(F.col("provenance")).alias("label"), "provenance",
        cut("source_family", "unknown"), cut("discipline", "unknown"), cut("document_type", "unknown"), cut("editing_level", "none"),
        scores.alias("external_scores"), cut("notes", "", 500), words.alias("word_count"),
        F.when(bad, F.raise_error(F.lit("a sample needs 40 words and a known provenance")).cast("string")).otherwise(text).alias("text"),
    )


def append(raw: DataFrame, path: str) -> None:
    samples(raw).write.mode("append").json(path)


def status(corpus: DataFrame) -> DataFrame:
    """grouping, value, n, label_0, label_1: all of the corpus and every value of each column of GROUPS, in one pass."""
    named = corpus.select("label", *[F.coalesce(F.nullif(F.col(g), F.lit("")), F.lit("unknown")).alias(g) for g in GROUPS])
    sets = named.groupingSets([*([g] for g in GROUPS), []], *GROUPS)
    counted = sets.agg(
        *[F.grouping(g).alias(f"without_{g}") for g in GROUPS], F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"),
    )
    grouping = F.coalesce(*[F.when(F.col(f"without_{g}") == 0, g) for g in GROUPS], F.lit("all"))
    return counted.select(grouping.alias("grouping"), F.coalesce(*GROUPS, F.lit("all")).alias("value"), "n", "label_0", "label_1")


def disagreement(corpus: DataFrame) -> DataFrame:
    """n_multiple, mean_range, median_range of samples with two external scores or more."""
    values = F.map_values("external_scores")
    spread = corpus.where(F.size(values) >= 2).select((F.array_max(values) - F.array_min(values)).alias("r"))
    return spread.agg(F.count("r").alias("n_multiple"), F.round(F.avg("r"), 2).alias("mean_range"), F.round(F.median("r"), 2).alias("median_range"))


def detector_counts(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.explode(F.map_keys("external_scores")).alias("detector")).groupBy("detector").agg(F.count(F.lit(1)).alias("n"))


class Registry:
    """Models as JSON files in a folder, with the active one, the one before, and at most 25 listed."""

    def __init__(self, folder: str, most: int = 25):
        self.folder, self.most, self.manifest = folder, most, os.path.join(folder, "registry.json")
        os.makedirs(folder, exist_ok=True)

    def status(self) -> dict:
        try:
            with open(self.manifest, encoding="utf-8") as f:
                found = json.load(f)
        except (OSError, json.JSONDecodeError):
            found = None
        return found if isinstance(found, dict) else {"active": None, "previous": None, "models": []}

    def _save(self, manifest: dict) -> None:
        with open(self.manifest, "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=2, sort_keys=True)

    def register(self, model: dict) -> str:
        now = datetime.now(UTC)
        name = f"{now:%Y%m%dT%H%M%SZ}-{model.get('model_type', 'model')}-{uuid.uuid4().hex[:8]}"
        path = os.path.join(self.folder, f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(model, f, indent=2, sort_keys=True)
        m = self.status()
        shown = {k: model.get(k) for k in ("model_type", "sample_count", "test_metrics", "validation_metrics", "decision_threshold", "max_human_fpr")}
        entry = {"id": name, "created_at": now.isoformat(), "path": path} | shown
        self._save({"active": name, "previous": m["active"], "models": [entry, *m["models"]][: self.most]})
        return name

    def model(self, name: str) -> dict:
        entry = next((x for x in self.status()["models"] if x["id"] == name), None)
        if not entry or not os.path.exists(entry["path"]):
            raise ValueError(f"no such model: {name}")
        with open(entry["path"], encoding="utf-8") as f:
            return json.load(f)

    def active(self) -> dict | None:
        name = self.status()["active"]
        return self.model(name) if name else None

    def promote(self, name: str) -> dict:
        found, m = self.model(name), self.status()
        self._save(m | {"active": name, "previous": m["previous"] if m["active"] == name else m["active"]})
        return found

    def rollback(self) -> dict:
        previous = self.status()["previous"]
        if not previous:
            raise ValueError("no previous model")
        return self.promote(previous)
