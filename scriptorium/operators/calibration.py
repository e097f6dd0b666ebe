"""Small transparent classifiers over feature rows: statistics, models, metrics, thresholds, drift.

Rows are id, label (0 or 1) and double features.  Statistics and metrics are
aggregates; training itself works on the bounded set of labelled rows on the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as tx

MIN_SAMPLES, MIN_PER_CLASS, MIN_FEATURES = 40, 20, 4


def feature_stats(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, mean, scale (population deviation, at least 1e-6) in one pass."""
    one = rows.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    each = [F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"), F.greatest(F.lit(1e-6), F.col(f"s{i}")).alias("scale")) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*each)))


def class_stats(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """label, feature, n, mean, variance (population, at least 1e-3): naive Bayes and the centroids."""
    one = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("v", F.var_pop))])
    each = [F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"), F.greatest(F.lit(1e-3), F.col(f"v{i}")).alias("variance")) for i, n in enumerate(names)]
    return one.select("label", "n", F.inline(F.array(*each)))


def standardised(rows: DataFrame, model: dict) -> dict[str, Column]:
    """Features less their means over their scales; a feature that the rows lack counts as 0."""
    out = {}
    for n in model["feature_names"]:
        x = F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0)
        out[n] = (x - model["means"].get(n, 0.0)) / max(1e-9, model["scales"].get(n, 1.0))
    return out


def predicted(rows: DataFrame, model: dict) -> DataFrame:
    """`rows` with probability (of label 1), percentage, logit, contributions (of a logistic model) and predicted."""
    x = standardised(rows, model)
    kind, parts = model["model_type"], {}
    if kind == "logistic":
        parts = {n: x[n] * float(model["weights"].get(n, 0.0)) for n in x}
        logit = sum(parts.values(), F.lit(float(model["bias"])))
    elif kind == "gaussian_nb":
        def log_density(k: str) -> Column:
            c = model["classes"][k]
            out = F.lit(math.log(max(1e-9, c["prior"])))
            for n in x:
                v = max(1e-5, c["variances"][n])
                out = out - 0.5 * (math.log(2 * math.pi * v) + (x[n] - c["means"][n]) * (x[n] - c["means"][n]) / v)
            return out

        logit = log_density("1") - log_density("0")
    else:
        def distance(k: str) -> Column:
            return sum(((x[n] - model["centroids"][k][n]) * (x[n] - model["centroids"][k][n]) for n in x), F.lit(0.0))

        logit = (distance("0") - distance("1")) / max(0.2, model["temperature"])
    threshold = float(model.get("decision_threshold", 0.5))
    p = tx.sigmoid(logit)
    shown = F.create_map(*[c for n, v in parts.items() for c in (F.lit(n), F.round(v, 4))]) if parts else F.lit(None).cast("map<string,double>")
    return rows.withColumn("probability", p).withColumns(
        {
            "percentage": F.bround(F.col("probability") * 100, 0).cast("int"), "logit": F.round(logit, 4), "contributions": shown,
            "predicted": (F.col("probability") >= threshold).cast("int"),
        }
    )


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def roc_auc(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, roc_auc: the share of (1, 0) pairs that the probability orders rightly, ties half.

    Equal probabilities are counted first; ranks run over 1024 ranges of them, so no
    task has to sort a whole class.
    """
    counted = rows.groupBy(*keys, "probability").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    counted = counted.withColumn("part", F.floor(F.col("probability") * 1024))
    parts = counted.groupBy(*keys, "part").agg(F.sum("n").alias("n_part"))
    below = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "part", F.coalesce(F.sum("n_part").over(below), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "part").orderBy("probability").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.join(parts, [*keys, "part"]).withColumn("less", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    wins = F.sum(F.col("p") * (F.col("less") + 0.5 * F.col("n")))
    return ranked.groupBy(*keys).agg(F.round(wins / F.greatest(F.lit(1), F.sum("p") * F.sum("n")), 4).alias("roc_auc"))


def classification_metrics(rows: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """keys, tp, tn, fp, fn and the usual ratios (4 places, empty denominators as 1) of rows(label, probability)."""
    hit, y = F.col("probability") >= threshold, F.col("label") == 1
    one = rows.groupBy(*keys).agg(
        F.count_if(y & hit).alias("tp"), F.count_if(~y & ~hit).alias("tn"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn")
    )
    c = F.col

    def over(a: Column, b: Column) -> Column:
        return a / F.greatest(F.lit(1), b)

    precision, recall = over(c("tp"), c("tp") + c("fp")), over(c("tp"), c("tp") + c("fn"))
    ratios = {
        "accuracy": over(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")), "precision": precision, "recall": recall,
        "specificity": over(c("tn"), c("tn") + c("fp")), "f1": 2 * precision * recall / F.greatest(F.lit(1e-12), precision + recall),
        "false_positive_rate": over(c("fp"), c("fp") + c("tn")), "false_negative_rate": over(c("fn"), c("fn") + c("tp")),
    }
    return one.select(*_keys(keys), "tp", "tn", "fp", "fn", *[F.round(v, 4).alias(k) for k, v in ratios.items()])


def group_metrics(rows: DataFrame, key: str) -> DataFrame:
    """Metrics at 0.5 for every value of a key with four rows or more and both labels; null is "unknown"."""
    named = rows.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit("unknown")))
    metrics = classification_metrics(named, 0.5, [key]).join(roc_auc(named, [key]), key)
    return metrics.where((F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") >= 4) & (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))


def feature_shifts(rows: DataFrame, model: dict) -> DataFrame:
    """feature, recent_mean, training_mean, z_shift: how far the features of recent rows have moved, in training scales."""
    names = model["feature_names"]
    known = [(n, float(model["means"].get(n, 0.0)), max(1e-6, float(model["scales"].get(n, 1.0)))) for n in names]
    one = rows.agg(*[F.avg(F.coalesce(F.col(n).cast("double"), F.lit(0.0))).alias(f"m{i}") for i, n in enumerate(names)])
    each = [
        F.struct(
            F.lit(n).alias("feature"), F.round(F.coalesce(F.col(f"m{i}"), F.lit(0.0)), 4).alias("recent_mean"), F.lit(round(m, 4)).alias("training_mean"),
            F.round(F.abs(F.coalesce(F.col(f"m{i}"), F.lit(0.0)) - m) / s, 3).alias("z_shift"),
        )
        for i, (n, m, s) in enumerate(known)
    ]
    return one.select(F.inline(F.array(*each)))


def drift(rows: DataFrame, model: dict, recent: int = 30) -> DataFrame:
    """drift_index (mean of the ten largest shifts over the newest rows, by created_at and id), status, largest_shifts."""
    newest = rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(10, recent))
    top = feature_shifts(newest, model).orderBy(F.desc("z_shift"), "feature").limit(10)
    index = F.round(F.avg("z_shift"), 3)
    out = top.agg(index.alias("drift_index"), F.sort_array(F.collect_list(F.struct("z_shift", "feature", "recent_mean", "training_mean")), False).alias("largest_shifts"))
    status = F.when(F.col("drift_index") >= 1.25, "retraining recommended").when(F.col("drift_index") >= 0.75, "watch").otherwise("stable")
    return out.withColumn("status", status)


def feature_importance(spark: SparkSession, model: dict, limit: int = 15) -> DataFrame:
    """feature, importance, share (of the importances shown) of the features that weigh most; ties in the model's order."""
    names, kind = model["feature_names"], model["model_type"]
    if kind == "logistic":
        size = {n: abs(model["weights"][n]) for n in names}
    else:
        a, b = (model["classes"][k]["means"] if kind == "gaussian_nb" else model["centroids"][k] for k in "01")
        size = {n: abs(b[n] - a[n]) for n in names}
    rows = spark.createDataFrame([(i, n, float(size[n])) for i, n in enumerate(names)], "i int, feature string, size double")
    top = rows.orderBy(F.desc("size"), "i").limit(max(1, limit))
    total = top.agg(F.sum("size").alias("total"))
    share = F.when(F.col("total") == 0, F.col("size")).otherwise(F.col("size") / F.col("total"))
    return top.join(F.broadcast(total)).select("feature", F.round("size", 6).alias("importance"), F.round(share, 4).alias("share"))


def centroids(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """label, feature, centroid (mean of the standardised feature) and temperature, the mean distance of the two centroids' squares.

    The temperature is the mean absolute difference of a row's squared distances to both
    centroids, at least 0.2; what a nearest-centroid model needs, in two passes over the rows.
    """
    stats = rows.agg(*[f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [((F.col(n) - F.col(f"m{i}")) / F.greatest(F.lit(1e-6), F.col(f"s{i}"))).alias(f"z{i}") for i, n in enumerate(names)]
    scaled = rows.join(F.broadcast(stats)).select("label", *z)
    means = scaled.groupBy("label").agg(*[F.avg(f"z{i}").alias(f"c{i}") for i in range(len(names))])
    both = means.agg(*[F.max(F.when(F.col("label") == y, F.col(f"c{i}"))).alias(f"c{y}_{i}") for i in range(len(names)) for y in (0, 1)])

    def distance(y: int) -> Column:
        return sum(((F.col(f"z{i}") - F.col(f"c{y}_{i}")) * (F.col(f"z{i}") - F.col(f"c{y}_{i}")) for i in range(len(names))), F.lit(0.0))

    heat = scaled.join(F.broadcast(both)).agg(F.greatest(F.lit(0.2), F.avg(F.abs(distance(0) - distance(1)))).alias("temperature"))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("centroid")) for i, n in enumerate(names)]))
    return means.select("label", each).join(F.broadcast(heat))


# --- training on the driver ----------------------------------------------------------


def _prepared(x: np.ndarray, names: list[str]) -> dict:
    return {"feature_names": names, "means": dict(zip(names, x.mean(0).tolist(), strict=True)), "scales": dict(zip(names, np.maximum(1e-6, x.std(0)).tolist(), strict=True))}


def _z(x: np.ndarray, model: dict) -> np.ndarray:
    n = model["feature_names"]
    return (x - [model["means"][k] for k in n]) / [model["scales"][k] for k in n]


def fit_logistic(x: np.ndarray, y: np.ndarray, names: list[str], epochs: int = 1600, rate: float = 0.035, l2: float = 0.012) -> dict:
    """Full-batch gradient descent from the log-odds of the base rate."""
    model = _prepared(x, names)
    z, base = _z(x, model), min(0.98, max(0.02, float(y.mean())))
    w, b = np.zeros(len(names)), math.log(base / (1 - base))
    for _ in range(max(50, epochs)):
        error = 1 / (1 + np.exp(-np.clip(z @ w + b, -60, 60))) - y
        b -= rate * error.mean()
        w -= rate * (z.T @ error / len(y) + l2 * w)
    return model | {"model_type": "logistic", "weights": dict(zip(names, w.tolist(), strict=True)), "bias": float(b)}


def fit_gaussian_nb(x: np.ndarray, y: np.ndarray, names: list[str]) -> dict:
    model = _prepared(x, names)
    z, classes = _z(x, model), {}
    for k in (0, 1):
        own = z[y == k]
        classes[str(k)] = {
            "prior": len(own) / len(z), "means": dict(zip(names, own.mean(0).tolist(), strict=True)),
            "variances": dict(zip(names, np.maximum(1e-3, own.var(0)).tolist(), strict=True)),
        }
    return model | {"model_type": "gaussian_nb", "classes": classes}


def fit_centroids(x: np.ndarray, y: np.ndarray, names: list[str]) -> dict:
    """Nearest centroid; its temperature is the mean squared distance within classes, at least 0.5."""
    model = _prepared(x, names)
    z = _z(x, model)
    centers = [z[y == k].mean(0) for k in (0, 1)]
    within = np.concatenate([((z[y == k] - centers[k]) ** 2).sum(1) for k in (0, 1)])
    return model | {
        "model_type": "nearest_centroid", "temperature": max(0.5, float(within.mean())),
        "centroids": {str(k): dict(zip(names, centers[k].tolist(), strict=True)) for k in (0, 1)},
    }


FITTERS = {"logistic": fit_logistic, "gaussian_nb": fit_gaussian_nb, "nearest_centroid": fit_centroids}


def probabilities(x: np.ndarray, model: dict) -> np.ndarray:
    """The same as `predicted`, for rows on the driver."""
    z, n, kind = _z(x, model), model["feature_names"], model["model_type"]
    if kind == "logistic":
        logit = z @ np.array([model["weights"][k] for k in n]) + model["bias"]
    elif kind == "gaussian_nb":
        def density(c: dict) -> np.ndarray:
            m, v = np.array([c["means"][k] for k in n]), np.maximum(1e-5, [c["variances"][k] for k in n])
            return math.log(max(1e-9, c["prior"])) - 0.5 * (np.log(2 * np.pi * v) + (z - m) ** 2 / v).sum(1)

        logit = density(model["classes"]["1"]) - density(model["classes"]["0"])
    else:
        d = [((z - [model["centroids"][k][name] for name in n]) ** 2).sum(1) for k in "01"]
        logit = (d[0] - d[1]) / max(0.2, model["temperature"])
    return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def metrics(y: np.ndarray, p: np.ndarray, threshold: float = 0.5) -> dict:
    hit, pos = p >= threshold, y == 1
    tp, tn, fp, fn = (int(x.sum()) for x in (hit & pos, ~hit & ~pos, hit & ~pos, ~hit & pos))
    values, at = np.unique(p, return_inverse=True)
    n0 = np.bincount(at, ~pos, len(values))
    less = np.cumsum(n0) - n0
    auc = float((less[at[pos]] + 0.5 * n0[at[pos]]).sum()) / max(1, int(pos.sum()) * int((~pos).sum()))
    precision, recall = tp / max(1, tp + fp), tp / max(1, tp + fn)
    out = {
        "accuracy": (tp + tn) / max(1, len(y)), "precision": precision, "recall": recall, "specificity": tn / max(1, tn + fp),
        "f1": 2 * precision * recall / max(1e-12, precision + recall), "roc_auc": auc, "false_positive_rate": fp / max(1, fp + tn),
        "false_negative_rate": fn / max(1, fn + tp),
    }
    return {k: round(v, 4) for k, v in out.items()} | {"tp": tp, "tn": tn, "fp": fp, "fn": fn}


def threshold_under(y: np.ndarray, p: np.ndarray, ceiling: float) -> tuple[float, dict]:
    """Of the thresholds whose false positive rate keeps to the ceiling, the best by recall, F1, accuracy and height; else 0.5."""
    tried = [(t, metrics(y, p, t)) for t in sorted({0.01, 0.99, *np.clip(np.round(p, 4), 0.01, 0.99).tolist()})]
    fit = [x for x in tried if x[1]["false_positive_rate"] <= ceiling]
    return max(fit, key=lambda x: (x[1]["recall"], x[1]["f1"], x[1]["accuracy"], x[0])) if fit else (0.5, metrics(y, p, 0.5))


def three_way_split(y: np.ndarray, ids: Sequence, seed: int = 42, validation: float = 0.20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers for training, validation and a locked test, by class; rows are ordered by id and then shuffled with the seed."""
    rng, parts = np.random.default_rng(seed), ([], [], [])
    order = np.array(sorted(range(len(y)), key=lambda i: ids[i]))
    test_share = max(0.05, 1 - max(0.50, 1 - validation - 0.20) - validation)
    for k in (0, 1):
        own = rng.permutation(order[y[order] == k])
        n, t, v = len(own), max(4, round(len(own) * test_share)), max(4, round(len(own) * validation))
        while n - t - v < 8 and (t > 3 or v > 3):
            t, v = (t - 1, v) if t >= v and t > 3 else (t, v - 1)
        for part, rows in zip(parts, (own[t + v :], own[t : t + v], own[:t]), strict=True):
            part.extend(rows.tolist())
    return tuple(np.array(x, int) for x in parts)


def train_best(rows: DataFrame, names: Sequence[str], ceiling: float = 0.05, seed: int = 42, most: int = 200_000) -> dict:
    """Fits three families on 60 %, chooses one and a threshold on 20 %, refits, and tests once on the locked 20 %.

    At least 40 rows, 20 of each label, and 4 features that are not 0 throughout.  At most
    `most` labelled rows are used, those of the smallest hashed ids.
    """
    used = rows.where("label IN (0, 1)").orderBy(F.xxhash64("id"), "id").limit(most)
    got = used.select("id", "label", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]).collect()
    y = np.array([r["label"] for r in got])
    if len(y) < MIN_SAMPLES or min((y == k).sum() for k in (0, 1)) < MIN_PER_CLASS:
        raise ValueError("training needs at least 40 rows, 20 of each label")
    x = np.array([[r[n] for n in names] for r in got])
    live = [i for i in range(len(names)) if (x[:, i] != 0).any()]
    if len(live) < MIN_FEATURES:
        raise ValueError("training needs at least 4 features")
    x, kept = x[:, live], [names[i] for i in live]
    train, valid, test = three_way_split(y, [r["id"] for r in got], seed)
    tried = {k: f(x[train], y[train], kept) for k, f in FITTERS.items()}
    scores = {k: metrics(y[valid], probabilities(x[valid], m)) for k, m in tried.items()}
    best = max(scores, key=lambda k: (scores[k]["roc_auc"], scores[k]["f1"], -scores[k]["false_positive_rate"], scores[k]["accuracy"]))
    threshold, chosen = threshold_under(y[valid], probabilities(x[valid], tried[best]), max(0.0, min(0.5, ceiling)))
    both = np.concatenate([train, valid])
    final = FITTERS[best](x[both], y[both], kept)
    return final | {
        "decision_threshold": round(threshold, 6), "candidate_metrics": scores, "validation_metrics": chosen,
        "test_metrics": metrics(y[test], probabilities(x[test], final), threshold), "sample_count": len(y),
        "positive_count": int(y.sum()), "negative_count": int((y == 0).sum()), "train_count": len(train), "validation_count": len(valid),
        "locked_test_count": len(test), "random_seed": seed, "max_human_fpr": ceiling,
    }


def save_model(model: dict, path: str, schema_version: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(model | {"feature_schema_version": schema_version}, f, indent=2, sort_keys=True)


def load_model(path: str, schema_version: str) -> dict | None:
    """The model, or None if there is none or it was made for other features."""
    try:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
    except (OSError, json.JSONDecodeError):
        return None
    fits = isinstance(model, dict) and model.get("feature_schema_version") == schema_version and model.get("model_type") in FITTERS
    return model if fits else None
