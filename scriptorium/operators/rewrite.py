"""Conservative editing of documents behind a gate that protected evidence must pass.

Candidates are made by document in an Arrow UDF, as connectors are counted through a
whole document, and measured there.  Columns judge them: what breaks evidence goes, the
most natural of the rest stays, and never one that is less natural than its source.
The choice looks at the quality of the writing only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx
from scriptorium.operators import batches as batching
from scriptorium.operators import edits, measures, preservation, style
from scriptorium.sources.scratch import stored

LEVELS = {"light": ["light"], "balanced": ["light", "balanced"], "deep": ["light", "balanced", "deep"]}
GUIDED_LEVELS = {"light": ["light"], "balanced": ["balanced", "deep"], "deep": ["deep"]}
#: Metrics of the fingerprint that call for edits of these families from 35 on.
METRIC_FAMILIES = {
    "perplexity_proxy": "A", "token_distribution_proxy": "A", "burstiness": "B", "ngram_frequency": "DI", "uniform_semantic_density": "BI",
    "repetitive_syntactic_structures": "DI", "systemic_transitions": "F", "low_vocabulary_diversity": "A",
}


def _local(levels: list[str]) -> Callable:
    def run(text: str, terms: list[str]) -> list[tuple[str, str]]:
        out, known = [], {}
        for level in levels if text.strip(tx.SPACE) else ():
            seen: Counter = Counter()
            out.append((level, edits.by_line(text, lambda p, seen=seen, level=level: edits.refined(p, seen, level, terms, known))))
        return out

    return measures.edited(run)


def _guided(levels: list[str]) -> Callable:
    def run(text: str, terms: list[str], keys: list[str], flagged: list[dict]) -> list[tuple[str, str]]:
        out = []
        for level in levels if keys and flagged else ():
            seen: Counter = Counter()
            new = edits.by_line(
                text,
                lambda p, seen=seen, level=level: edits.guided(p, seen, set(keys), level, terms),
                lambda s, e: any(x["start"] < e and x["end"] > s for x in flagged),
            )
            out.append((level, new))
        return out

    return measures.edited(run)


def _limit(words: Column, few: int, loose: float, share: int, least: float, most: float) -> Column:
    return F.when(words < few, loose).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), share / words)))


def chosen(edited: DataFrame, never_worse: bool) -> DataFrame:
    """doc_id, text, applied, applied_level, preservation_passed, preservation_issues, score_before, score_after.

    edited(doc_id, text, made), made being what `measures.edited` makes of a text.  A document whose candidates all
    break evidence, or read worse, keeps its text.  Of equal scores the stronger level wins.
    """
    rank = F.create_map(*[x for i, v in enumerate(("light", "balanced", "deep")) for x in (F.lit(v), F.lit(i))])

    def score(style_of: Column) -> Column:
        return style.report_of(style_of)[0]

    standing = F.transform(
        F.filter(F.col("made.candidates"), lambda c: F.size(c["issues"]) == 0),
        lambda c: F.struct(score(c["style"]).alias("score"), F.element_at(rank, c["level"]).alias("rank"), c["level"].alias("level"), c["candidate"].alias("candidate")),
    )
    every = F.flatten(F.transform(F.col("made.candidates"), lambda c: c["issues"]))
    judged = edited.select(
        "doc_id", "text", score(F.col("made.style")).alias("score_before"), F.array_max(standing).alias("best"), (F.size("made.candidates") > 0).alias("tried"),
        F.array_sort(F.array_distinct(every)).alias("issues"),
    )
    take = F.col("best").isNotNull() & (F.lit(not never_worse) | (F.col("best.score") >= F.col("score_before")))
    failed = F.col("tried") & F.col("best").isNull()
    return judged.withColumns({"take": take, "failed": failed}).select(
        "doc_id",
        F.when(F.col("take"), F.col("best.candidate")).otherwise(F.col("text")).alias("text"),
        (F.col("take") & (F.col("best.candidate") != F.col("text"))).alias("applied"),
        F.when(F.col("take"), F.col("best.level")).alias("applied_level"),
        (~F.col("failed")).alias("preservation_passed"),
        F.when(F.col("failed"), F.col("issues")).otherwise(F.array().cast("array<string>")).alias("preservation_issues"),
        "score_before",
        F.when(F.col("take"), F.col("best.score")).otherwise(F.col("score_before")).alias("score_after"),
    )


def _sources(docs: DataFrame, terms: list[str], few: int, loose: float, share: int, least: float, most: float) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.greatest(F.lit(1), tx.n_words_wide(text))
    keep = F.array(*map(F.lit, terms)).cast("array<string>")
    limit = _limit(words, few, loose, share, least, most).alias("change_limit")
    return docs.select("doc_id", text.alias("text"), preservation.protected_terms(keep).alias("terms"), limit)


def rewritten(docs: DataFrame, mode: str = "balanced", terms: list[str] | None = None) -> DataFrame:
    """Local editing, without any look at signals.  Modes: light, balanced, deep, off.  Null texts are empty."""
    sources = _sources(docs, terms or [], 120, 0.60, 90, 0.14, 0.48)
    levels = [] if mode == "off" else LEVELS.get(mode, LEVELS["balanced"])
    # dealt out anew, as a file of a few MB may hold work for an hour; kept, as the choice reads it more than once
    made = sources.repartition(F.xxhash64("text")).withColumn("made", _local(levels)("text", "terms", "change_limit"))
    return chosen(stored(made), never_worse=True)


def guided_families() -> Column:
    """families, of private document scores: active families but E and H, and those that the fingerprint's metrics call for."""
    active = [F.when(F.col(k) > 0, F.lit(k)) for k in lx.FAMILY_WEIGHTS if k not in "EH"]
    metrics = [F.when(F.col(m) >= 35, F.lit(k)) for m, keys in METRIC_FAMILIES.items() for k in keys]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*active, *metrics)))).alias("families")


def rewritten_guided(docs: DataFrame, scores: DataFrame, segments: DataFrame | None = None, mode: str = "deep", terms: list[str] | None = None) -> DataFrame:
    """Editing of just the lines that hold a flagged sentence, by the families that are active.

    scores: private document scores; segments: scored segments, where the scores do not hold the flagged ranges.
    """
    sources = _sources(docs, terms or [], 150, 0.65, 110, 0.18, 0.52)
    if segments is None:  # one use of the scores, as two would read all texts twice
        asked = scores.select("doc_id", guided_families(), F.col("flagged_at").alias("at"))
    else:
        flagged = segments.where("NOT protected AND risk > 0 AND band IN ('low', 'moderate', 'high')").groupBy("doc_id").agg(
            F.sort_array(F.collect_list(F.struct("start", "end"))).alias("at")
        )
        asked = scores.select("doc_id", guided_families()).join(flagged, "doc_id")
    # rows that neither calls for an edit keep their text, as do repeated and null ids that are rows of their own
    each = sources.join(asked, "doc_id", "left")
    run = _guided(GUIDED_LEVELS.get(mode, ["deep"]))
    return chosen(stored(each.withColumn("made", run("text", "terms", "change_limit", "families", "at"))), never_worse=False)


def _asked(model: Callable[[str], str], retries: int) -> Callable:
    """A UDF of the model's answer, or of its last error after `retries` (0 to 3) more attempts."""

    @F.pandas_udf("struct<candidate: string, error: string>")
    def run(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            error = None
            for _ in range(max(0, min(3, retries)) + 1):
                try:
                    rows.append((model(t), None))
                    break
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            else:
                rows.append((None, error))
        return pd.DataFrame(rows, columns=["candidate", "error"])

    return run


def _report(rows: DataFrame, text: str, mode: str) -> DataFrame:
    """rid, score, wanted of the texts of rows(rid, ...); stored, as a filter on `wanted` must not carry the whole report into its condition."""
    report = style.style_report(rows.select(F.col("rid").alias("doc_id"), F.col(text).alias("text")))
    return stored(report.select(F.col("doc_id").alias("rid"), F.col("naturalness_score").alias("score"), style.needs_edit(mode).alias("wanted")))


def _judged(made: DataFrame, limit: Column | float, terms: list[str] | None) -> DataFrame:
    """made(rid, text, candidate, score_before, ...) with issues, score_after and accepted: evidence kept, and no less natural."""
    keep = F.array(*map(F.lit, terms or [])).cast("array<string>")
    gated = stored(made.withColumn("issues", F.when(F.col("candidate").isNotNull(), preservation.broken(F.col("text"), F.col("candidate"), limit, keep))))
    after = _report(gated.where("candidate IS NOT NULL"), "candidate", "deep").select("rid", F.col("score").alias("score_after"))
    ok = F.col("candidate").isNotNull() & (F.size("issues") == 0) & (F.col("score_after") >= F.col("score_before"))
    return gated.join(after, "rid", "left").withColumn("accepted", F.coalesce(ok, F.lit(False)))


def rewritten_by(
    batches: DataFrame, model: Callable[[str], str], retries: int = 2, terms: list[str] | None = None, limit: float = 0.18, mode: str = "deep"
) -> DataFrame:
    """Editing of batches(doc_id, batch, text, protected, ...) by any callable; the source stays where it fails, breaks evidence or reads worse.

    Adds revised, accepted, issues, error, score_before and score_after.  The callable sees only
    batches that are not protected and, but in "deep" mode, have an issue that it can mend.  It
    runs on the executors and must be idempotent, as tasks may be retried.
    """
    rows = stored(batches.withColumn("rid", F.monotonically_increasing_id()))
    before = _report(rows, "text", mode).withColumnRenamed("score", "score_before")
    wanted = rows.where("NOT protected").join(before.where("wanted").drop("wanted"), "rid")
    made = wanted.select("rid", "text", "score_before", _asked(model, retries)("text").alias("r")).select("*", "r.candidate", "r.error").drop("r")
    judged = _judged(stored(made), limit, terms).drop("text", "score_before")
    out = rows.join(before.drop("wanted"), "rid").join(judged, "rid", "left")
    ok = F.coalesce("accepted", F.lit(False))
    return out.select(
        *batches.columns, F.when(ok, F.col("candidate")).otherwise(F.col("text")).alias("revised"), ok.alias("accepted"), "issues", "error",
        "score_before", F.when(ok, F.col("score_after")).otherwise(F.col("score_before")).alias("score_after"),
    )


@F.pandas_udf(ArrayType(IntegerType()))
def _groups(words: pd.Series, most: pd.Series) -> pd.Series:
    def of(counts: list[int], limit: int) -> list[int]:
        out, group, held = [], 0, 0
        for n in counts:
            if held and held + n > limit:
                group, held = group + 1, 0
            out.append(group)
            held += n
        return out

    return pd.Series([of(w, m) for w, m in zip(words, most, strict=True)])


def rewritten_paragraphs(
    paragraphs: DataFrame, model: Callable[[str], str], mode: str = "balanced", retries: int = 2, terms: list[str] | None = None,
    limit: float = 0.18, most: int = 4200,
) -> DataFrame:
    """doc_id, index, text, revised, accepted, issues, error of paragraphs(doc_id, index, text), an index once in a document.

    Paragraphs that call for an edit are sent in groups of up to `most` words (2500 to 5000) of one
    document, between markers.  A group whose answer has other markers fails as a whole; else
    each paragraph passes or keeps its text by itself.  Null texts are empty.
    """
    rows = paragraphs.select("doc_id", F.col("index").cast("int").alias("index"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    words = F.greatest(F.lit(1), F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")))
    wanted = rows.join(_report(rows, "text", mode).withColumnRenamed("score", "score_before"), "rid").where("wanted").drop("wanted")
    wanted = stored(wanted.withColumn("n", words))
    members = wanted.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "rid", "n"))).alias("x"))
    numbers = _groups(F.transform("x", lambda p: p["n"]), F.lit(max(2500, min(5000, most))))
    placed = members.select(F.element_at("x", 1)["rid"].alias("first"), F.inline(F.arrays_zip("x", numbers.alias("group"))))
    keys = placed.select(F.concat_ws(":", "first", "group").alias("key"), "x.rid")
    grouped = stored(wanted.join(keys, "rid"))
    keyed = grouped.select(F.col("key").alias("doc_id"), "index", tx.strip(F.col("text")).alias("text"))
    answers = stored(batching.marked(keyed).select("doc_id", _asked(model, retries)("prompt").alias("r")))
    texts = batching.unmarked(answers.select("doc_id", F.col("r.candidate").alias("prompt")), keyed.select("doc_id", "index"))
    made = (
        grouped.join(texts.select(F.col("doc_id").alias("key"), "index", F.col("text").alias("candidate")), ["key", "index"], "left")
        .join(answers.select(F.col("doc_id").alias("key"), F.col("r.error").alias("error")), "key", "left")
        .withColumn("error", F.coalesce("error", F.when(F.col("candidate").isNull(), F.lit("the markers of the answer differ"))))
    )
    loose = F.when(F.col("n") < 120, F.greatest(F.lit(limit), F.lit(0.35))).otherwise(F.lit(limit))
    judged = _judged(made.select("rid", "text", "candidate", "error", "score_before", loose.alias("loose")), F.col("loose"), terms)
    out = rows.join(judged.select("rid", "candidate", "accepted", "issues", "error"), "rid", "left")
    ok = F.coalesce("accepted", F.lit(False))
    return out.select("doc_id", "index", "text", F.when(ok, F.col("candidate")).otherwise(F.col("text")).alias("revised"), ok.alias("accepted"), "issues", "error")


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """doc_id, key, before, after, change: a full outer map of two long tables; what one lacks is 0."""
    a = before.select("doc_id", key, F.col(value).alias("before"))
    b = after.select("doc_id", key, F.col(value).alias("after"))
    return a.join(b, ["doc_id", key], "full_outer").na.fill(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))
