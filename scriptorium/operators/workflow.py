"""Whole editing runs: choose an editor, edit, score again, and take the edit back where the writing got worse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx
from scriptorium.operators import batches, ensemble, measures, preservation, rewrite, style
from scriptorium.sources import documents
from scriptorium.sources.scratch import stored

EDITORS = ("local", "guided", "model")
WORSE = "taken back, as the text read worse"


def _numbered(docs: DataFrame) -> DataFrame:
    """rid (a row's own, so repeated and null ids stay apart), doc_id, text (null is empty)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return stored(rows.withColumn("rid", F.monotonically_increasing_id()))


def _scores(keyed: DataFrame, as_of_year: int) -> DataFrame:
    return stored(ensemble.document_scores(keyed, as_of_year, private=True))


def _edited(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "text", F.col("applied").alias("changed"))


def _rescored(before: DataFrame, edited: DataFrame, as_of_year: int) -> DataFrame:
    """The scores of edited(doc_id, text, changed); texts that are as before keep their scores."""
    changed = edited.where("changed")
    return stored(before.join(changed.select("doc_id"), "doc_id", "left_anti").unionByName(_scores(changed, as_of_year)))


def _by_model(first: DataFrame, model: Callable[[str], str], mode: str, terms: list[str] | None, limit: float) -> DataFrame:
    """doc_id, text, changed: the batches of first(doc_id, text, changed), edited and joined again."""
    done = rewrite.rewritten_by(batches.batches(first.drop("changed")), model, terms=terms, limit=limit, mode=mode)
    whole = done.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("batch", "revised"))).alias("x"))
    joined = whole.select("doc_id", tx.strip(F.array_join(F.transform("x", lambda b: b["revised"]), "\n\n")).alias("new"))
    both = first.join(joined, "doc_id", "left").withColumn("new", F.coalesce("new", "text"))
    return both.select("doc_id", F.col("new").alias("text"), (F.col("changed") | (F.col("new") != F.col("text"))).alias("changed"))


def _changes(keys: list[str], targeted: Column | None = None) -> Column:
    """array of (key, before, after, change, targeted) from the columns b.<key> and a.<key>."""
    each = []
    for k in keys:
        b, a = F.col(f"b.{k}").cast("double"), F.col(f"a.{k}").cast("double")
        aimed = F.array_contains(targeted, k) if targeted is not None else F.lit(False)
        each.append(F.struct(F.lit(k).alias("key"), b.alias("before"), a.alias("after"), (a - b).alias("change"), aimed.alias("targeted")))
    return F.array(*each)


def edited_documents(
    docs: DataFrame, as_of_year: int, editor: str = "local", mode: str = "balanced", model: Callable[[str], str] | None = None,
    terms: list[str] | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, text, selected_editor, actual_editor, changed, reason, scores before and after, maps, certificate.

    Editors: local; guided (by the signals); model (any callable, behind the local editor, in
    balanced and deep mode; without a callable the local edit stays, "local_fallback").  An edit
    after which naturalness is lower is taken back.  `signal_map` and `statistical_map` hold the
    families and the fingerprint before and after; `targeted` the families that the guided editor
    went for.  Null texts are empty; repeated and null ids are rows of their own.
    """
    if editor not in EDITORS:
        raise ValueError(f"editor must be one of {', '.join(EDITORS)}")
    rows = _numbered(docs)
    keyed = rows.select(F.col("rid").alias("doc_id"), "text")
    before = _scores(keyed, as_of_year)
    no_families = F.array().cast("array<string>")
    targeted, actual, fell_back = keyed.select("doc_id", no_families.alias("targeted")), editor, None
    if editor == "guided":
        first = revised = stored(_edited(rewrite.rewritten_guided(keyed, before, None, mode, terms)))
        targeted = before.select("doc_id", rewrite.guided_families().alias("targeted"))
    else:
        first = revised = stored(_edited(rewrite.rewritten(keyed, mode, terms)))
        if editor == "model" and model is not None and mode in ("balanced", "deep"):
            limit = style.Variation.configured(docs.sparkSession).word_change
            revised = stored(_by_model(first, model, mode, terms, limit))
        elif editor == "model":
            actual, fell_back = "local_fallback", "no model" if model is None else "models edit in balanced and deep mode only"
    after = _rescored(before, revised, as_of_year)
    b, a = F.col("b.naturalness_score"), F.col("a.naturalness_score")
    worse = a < b
    shown = F.when(worse, F.col("rows.text")).otherwise(F.col("new"))
    left = F.when(F.lit(editor == "model") & (F.col("local") != F.col("rows.text")), F.lit("local_fallback")).otherwise("none")
    joined = (
        rows.alias("rows")
        .join(revised.select(F.col("doc_id").alias("rid"), F.col("text").alias("new")), "rid")
        .join(first.select(F.col("doc_id").alias("rid"), F.col("text").alias("local")), "rid")
        .join(targeted.select(F.col("doc_id").alias("rid"), "targeted"), "rid", "left")
        .join(before.alias("b"), F.col("rid") == F.col("b.doc_id"))
        .join(after.alias("a"), F.col("rid") == F.col("a.doc_id"))
    )
    keep = F.array(*map(F.lit, terms or [])).cast("array<string>")

    def kept(k: str) -> Column:
        return F.when(worse, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}"))

    def unless_worse(changes: Column) -> Column:
        same = F.transform(changes, lambda c: c.withField("after", c["before"]).withField("change", F.lit(0.0)))
        return F.when(worse, same).otherwise(changes)

    out = joined.select(
        F.col("rows.doc_id").alias("doc_id"), F.col("rows.text").alias("source"), shown.alias("text"), F.lit(editor).alias("selected_editor"),
        F.when(worse, left).otherwise(F.lit(actual)).alias("actual_editor"),
        F.when(worse, F.lit(WORSE)).otherwise(F.lit(fell_back)).alias("reason"),
        b.alias("naturalness_before"), kept("naturalness_score").alias("naturalness_after"),
        F.col("b.ai_signal").alias("signal_before"), kept("ai_signal").alias("signal_after"), F.coalesce("targeted", no_families).alias("targeted"),
        unless_worse(_changes(list(lx.FAMILY_WEIGHTS), F.col("targeted"))).alias("signal_map"),
        unless_worse(_changes(list(style.FINGERPRINT))).alias("statistical_map"),
    )
    certified = out.withColumn("certificate", measures.certificate(F.col("source"), F.col("text"), preservation.protected_terms(keep)))
    return certified.withColumn("changed", F.col("text") != F.col("source")).drop("source")


def robustness(docs: DataFrame, as_of_year: int, mode: str = "balanced") -> DataFrame:
    """doc_id, before, and for both editors <editor>_changed, _after, _certificate: how steady the signal is under editing.

    It measures the detector.  It promises nothing about other detectors.
    """
    rows = _numbered(docs)
    keyed = rows.select(F.col("rid").alias("doc_id"), "text")
    before = _scores(keyed, as_of_year)
    out = rows.join(before.select(F.col("doc_id").alias("rid"), F.col("ai_signal").alias("before")), "rid")
    for name, made in (("local", rewrite.rewritten(keyed, mode)), ("guided", rewrite.rewritten_guided(keyed, before, None, mode))):
        new = stored(_edited(made))
        scores = _rescored(before, new, as_of_year).select(F.col("doc_id").alias("rid"), F.col("ai_signal").alias(f"{name}_after"))
        out = out.join(new.select(F.col("doc_id").alias("rid"), F.col("text").alias("new")), "rid").join(scores, "rid")
        certified = measures.certificate(F.col("text"), F.col("new")).alias(f"{name}_certificate")
        out = out.select("*", (F.col("new") != F.col("text")).alias(f"{name}_changed"), certified).drop("new")
    return out.drop("rid", "text")


def edited_word(
    spark: SparkSession, path: str, as_of_year: int, editor: str = "local", mode: str = "balanced", model: Callable[[str], str] | None = None,
    terms: list[str] | None = None,
) -> DataFrame:
    """path, content, error, structure_kept, actual_editor, changed_paragraphs, scores before and after, certificate of every Word file.

    Only eligible paragraphs are edited, each behind the gate, and put into the original package.
    A file whose whole text reads worse afterwards keeps all its paragraphs.
    """
    if editor not in EDITORS:
        raise ValueError(f"editor must be one of {', '.join(EDITORS)}")
    structure = stored(documents.read_structure(spark, path))
    items = stored(documents.eligible(structure).withColumn("rid", F.monotonically_increasing_id()))
    keyed, actual = items.select(F.col("rid").alias("doc_id"), "text"), editor
    if editor == "guided":
        made = rewrite.rewritten_guided(keyed, _scores(keyed, as_of_year), None, mode, terms)
    else:
        made = rewrite.rewritten(keyed, mode, terms)
    both = items.join(made.select(F.col("doc_id").alias("rid"), F.col("text").alias("candidate")), "rid")
    n = F.greatest(F.lit(1), F.col("word_count"))
    limit = F.when(n < 120, F.lit(0.60)).otherwise(F.greatest(F.lit(0.14), F.least(F.lit(0.48), 90 / n)))
    keep = preservation.protected_terms(F.array(*map(F.lit, terms or [])).cast("array<string>"))
    ok = F.size(preservation.broken(F.col("text"), F.col("candidate"), limit, keep)) == 0
    edited = stored(both.select("path", "index", "text", F.when(ok, F.col("candidate")).otherwise(F.col("text")).alias("new")))
    if editor == "model" and (model is None or mode == "light"):
        actual = "local_fallback"
    elif editor == "model":
        limit = style.Variation.configured(spark).word_change
        asked = rewrite.rewritten_paragraphs(edited.select(F.col("path").alias("doc_id"), "index", F.col("new").alias("text")), model, mode, terms=terms, limit=limit)
        new = asked.select(F.col("doc_id").alias("path"), "index", F.col("revised").alias("new"))
        edited = stored(edited.drop("new").join(new, ["path", "index"]))
    changes = edited.where(F.col("new") != F.col("text")).select("path", "index", F.col("new").alias("text"))
    old = documents.whole_texts(structure, changes.limit(0)).select(F.col("path").alias("doc_id"), "text")
    new = documents.whole_texts(structure, changes).select(F.col("path").alias("doc_id"), "text")
    before, after = _scores(old, as_of_year), _scores(new, as_of_year)
    short = ("doc_id", "naturalness_score", "ai_signal")
    scores = before.select(*short).alias("b").join(after.select(*short).alias("a"), "doc_id")
    worse = F.col("a.naturalness_score") < F.col("b.naturalness_score")
    judged = scores.select(
        F.col("doc_id").alias("path"), worse.alias("worse"), F.col("b.naturalness_score").alias("naturalness_before"),
        F.when(worse, F.col("b.naturalness_score")).otherwise(F.col("a.naturalness_score")).alias("naturalness_after"),
        F.col("b.ai_signal").alias("signal_before"), F.when(worse, F.col("b.ai_signal")).otherwise(F.col("a.ai_signal")).alias("signal_after"),
    )
    judged = stored(judged)
    taken = stored(changes.join(judged.where("NOT worse").select("path"), "path"))
    final = documents.whole_texts(structure, taken).select("path", F.col("text").alias("new"))
    texts = old.select(F.col("doc_id").alias("path"), "text").join(final, "path")
    certified = texts.select("path", preservation.certificate(F.col("text"), F.col("new"), keep).alias("certificate"))
    files = documents.patched_documents(spark, path, taken).withColumnRenamed("passed", "structure_kept")
    counted = taken.groupBy("path").agg(F.count(F.lit(1)).alias("changed_paragraphs"))
    out = files.join(judged, "path", "left").join(certified, "path", "left").join(counted, "path", "left").na.fill(0, ["changed_paragraphs"])
    return out.withColumn("actual_editor", F.when(F.col("worse"), F.lit("none")).otherwise(F.lit(actual))).drop("worse")
