"""documents(doc_id, text) -> lines, sections, sentences and paragraphs.

doc_id identifies a document.  Lines are spread once by document; sections, sentences
and all later windows over documents reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx

def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def section_of(heading: Column) -> Column:
    clean = F.lower(F.regexp_replace(tx.strip(heading), "(?U)" + lx.SECTION_NUMBER, ""))
    out = F.lit("other")
    for name, starts in reversed(lx.SECTIONS):
        any_of = F.lit(False)
        for s in starts:
            any_of = any_of | clean.startswith(s)
        out = F.when(any_of, name).otherwise(out)
    return out


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, start (offset of the line), line (without its break), paragraph_index (null for a blank line), section.

    The section of a line is that of the last heading at or above it ("other" above the first).
    """
    raw = F.regexp_extract_all("text", F.lit(rf"[^{lx.LINE_BREAK}]*(?:\r\n|[{lx.LINE_BREAK}]|$)"), 0)
    so_far = by_doc().orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    until = by_doc().orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cut = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(raw).alias("line_no", "raw")).where("raw <> ''")
    core = cut.withColumn("line", F.rtrim("raw", F.lit("\r\n"))).withColumn("core", tx.strip(F.col("line")))
    heading = (F.col("core") != "") & tx.has(F.col("core"), lx.SECTION_HEADING) & (tx.n_words(F.col("core")) <= 16)
    return core.withColumn("label", F.when(heading, section_of(F.col("core")))).select(
        "doc_id",
        "line_no",
        F.coalesce(F.sum(F.length("raw")).over(so_far), F.lit(0)).cast("int").alias("start"),
        "line",
        F.when(F.col("core") != "", F.sum((F.col("core") != "").cast("int")).over(until) - 1).cast("int").alias("paragraph_index"),
        F.coalesce(F.last("label", ignorenulls=True).over(until), F.lit("other")).alias("section"),
    )


def structural(sentence: Column) -> Column:
    """Whether a segment is structure rather than prose: tables, headings, captions, forms, addresses, titles."""
    v = tx.strip(sentence)
    untitled = ~tx.has(v, lx.SENTENCE_END) & (tx.n_words(v) <= 20)
    return (
        (v == "")
        | v.contains("\t")
        | v.contains(" | ")
        | v.startswith("|")
        | v.contains("$$")
        | v.contains("```")
        | tx.has(v, r"^\d+(?:\.\d+)*\.?$")
        | tx.has(v, lx.PROTECTED_LINE)
        | tx.has(v, lx.CAPTION)
        | tx.has(v, lx.NUMBERED_HEADING, True)
        | tx.has(v, lx.BARE_HEADING)
        | tx.has(v, lx.FORM_LABEL)
        | tx.has(v, r"\bEmail\s*:\s*\S+@\S+")
        | tx.has(v, r"^\S+@\S+$")
        | (untitled & (tx.has(v, lx.INSTITUTION) | ~tx.has(v, lx.AUXILIARY)))
    )


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, index, paragraph_index, sentence_index, text, start, end, section, protected.

    start and end are offsets into the document's text; a non-blank line is a paragraph.
    """
    ahead = Window.partitionBy("doc_id", "line_no").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    brk = "(?U)" + lx.SENTENCE_BREAK
    body = lines(docs).where("paragraph_index IS NOT NULL").withColumn("body", tx.strip(F.col("line")))
    lead = F.length(F.ltrim("line", F.lit(tx.SPACE)))
    parts = body.select(
        "doc_id", "line_no", "paragraph_index", "section",
        (F.col("start") + F.length("line") - lead).alias("at"),
        F.regexp_extract_all("body", F.lit(brk), 0).alias("gaps"),
        F.posexplode(F.split("body", brk)).alias("sentence_index", "text"),
    )
    gap = F.coalesce(F.length(F.get("gaps", F.col("sentence_index"))), F.lit(0))
    placed = parts.withColumn("step", F.length("text") + gap).withColumn("from", F.coalesce(F.sum("step").over(ahead), F.lit(0)))
    start = (F.col("at") + F.col("from")).cast("int")
    return placed.where(tx.strip(F.col("text")) != "").select(
        "doc_id",
        (F.row_number().over(by_doc().orderBy("line_no", "sentence_index")) - 1).alias("index"),
        "paragraph_index",
        "sentence_index",
        "text",
        start.alias("start"),
        (start + F.length("text")).cast("int").alias("end"),
        "section",
        (structural(F.col("text")) | F.col("section").isin("references", "appendix")).alias("protected"),
    )


def prose_text(segments: DataFrame) -> DataFrame:
    """doc_id, text: unprotected sentences, joined by spaces within and by blank lines between paragraphs."""
    kept = segments.where("NOT protected").groupBy("doc_id", "paragraph_index")
    paragraphs = kept.agg(F.sort_array(F.collect_list(F.struct("sentence_index", tx.strip(F.col("text")).alias("s")))).alias("x"))
    joined = paragraphs.select("doc_id", "paragraph_index", F.array_join(F.transform("x", lambda s: s["s"]), " ").alias("p"))
    whole = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("paragraph_index", "p"))).alias("x"))
    return whole.select("doc_id", F.array_join(F.transform("x", lambda p: p["p"]), "\n\n").alias("text"))


def sentence_stats(segments: DataFrame) -> DataFrame:
    """doc_id, sentences, words, cv (variation of words a sentence, 6 places), p90 of words a sentence."""
    n = tx.n_words(F.col("text"))
    return segments.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sentences"), F.sum(n).alias("words"), F.round(F.stddev_pop(n) / F.nullif(F.avg(n), F.lit(0.0)), 6).alias("cv"),
        F.round(F.percentile(n, F.lit(0.9)), 6).alias("p90"),
    )


def by_document(segments: DataFrame) -> DataFrame:
    """doc_id, at (index of each unprotected sentence, in order), sentences."""
    kept = segments.where("NOT protected").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", "text"))).alias("x"))
    return kept.select("doc_id", F.transform("x", lambda s: s["index"]).alias("at"), F.transform("x", lambda s: s["text"]).alias("sentences"))


def coverage(docs: DataFrame, segments: DataFrame) -> DataFrame:
    """doc_id, total_words, assessed_words, excluded_words, assessed_sentences, assessed_paragraphs."""
    per_doc = segments.where("NOT protected").groupBy("doc_id").agg(
        F.sum(tx.n_words(F.col("text"))).alias("assessed_words"),
        F.count(F.lit(1)).alias("assessed_sentences"),
        F.countDistinct("paragraph_index").alias("assessed_paragraphs"),
    )
    total = docs.select("doc_id", tx.n_words(F.coalesce("text", F.lit(""))).cast("long").alias("total_words"))
    both = total.join(per_doc, "doc_id", "left").na.fill(0)
    return both.select(
        "doc_id", "total_words", "assessed_words", F.greatest(F.lit(0), F.col("total_words") - F.col("assessed_words")).alias("excluded_words"),
        "assessed_sentences", "assessed_paragraphs",
    )


def prose_sentence(sentence: Column) -> Column:
    """Whether a sentence counts for rhythm: six words or more, no caption, heading or form, not mostly numbers."""

    def numeric(parts: Column) -> Column:
        n = F.size(F.filter(parts, lambda t: F.btrim(t, F.lit("(),;:")).rlike(lx.NUMERIC_TOKEN)))
        return n / F.greatest(F.size(parts), F.lit(1)) >= 0.45

    def prose(s: Column) -> Column:
        parts = F.filter(F.split(s, " "), lambda t: t != "")
        return (
            (tx.n_words(s) >= 6)
            & ~tx.has(s, lx.CAPTION_STRICT)
            & ~tx.has(s, lx.NUMBERED_TITLE, True)
            & ~tx.has(s, lx.FORM_START)
            & ~tx.bound(parts, numeric)
        )

    return tx.bound(tx.squeezed(sentence), prose)


def _skipped(line: Column, clean: Column, line_no: Column) -> Column:
    def of(low: Column) -> Column:
        title = (line_no < 15) & ~tx.has(clean, r"[.!?]$") & (tx.n_words(clean) <= 30)
        return (
            (clean == "") | line.contains("\t") | line.contains(" | ") | tx.has(clean, lx.CAPTION, low=low) | tx.has(clean, lx.NUMBERED_HEADING, True)
            | tx.has(clean, lx.BARE_HEADING, low=low) | tx.has(clean, lx.FORM_LABEL, low=low) | title
        )

    return tx.bound(tx.folded(clean), of)


def prose_sentences(text: Column) -> Column:
    """array: the prose sentences of a text, line by line; where there are none, those of the text as a whole."""
    numbered = F.transform(tx.lines(text), lambda line, i: F.struct(line.alias("line"), tx.squeezed(line).alias("clean"), i.alias("i")))
    kept = F.filter(numbered, lambda x: ~_skipped(x["line"], x["clean"], x["i"]))
    by_line = F.filter(F.flatten(F.transform(kept, lambda x: tx.sentences(x["clean"]))), prose_sentence)
    return tx.bound(by_line, lambda own: F.when(F.size(own) > 0, own).otherwise(F.filter(tx.sentences(text), prose_sentence)))


def joined_units(marked: Column) -> Column:
    """array of units from array<struct<kind, clean, n, ends>>: kind 0 breaks, 1 stands alone, 2 is joined to its like.

    A run of joined lines is a unit when a line ends a sentence and the run has 12 words, or when it breaks; units of
    fewer than 6 words go.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), empty.alias("held"), F.lit(0).alias("n"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["n"] >= 6, F.concat(acc["out"], F.array(F.array_join(acc["held"], " ")))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        held, n = F.concat(acc["held"], F.array(x["clean"])), (acc["n"] + x["n"])
        full = x["ends"] & (n >= 12)
        return (
            F.when(x["kind"] == 0, F.struct(flushed(acc).alias("out"), empty.alias("held"), F.lit(0).alias("n")))
            .when(x["kind"] == 1, F.struct(F.concat(flushed(acc), F.array(x["clean"])).alias("out"), empty.alias("held"), F.lit(0).alias("n")))
            .when(full, F.struct(F.concat(acc["out"], F.array(F.array_join(held, " "))).alias("out"), empty.alias("held"), F.lit(0).alias("n")))
            .otherwise(F.struct(acc["out"].alias("out"), held.alias("held"), n.alias("n")))
        )

    return F.aggregate(marked, start, step, flushed)


def prose_paragraphs(text: Column) -> Column:
    """array: paragraph-like units of prose; where there are none, what stands between blank lines."""

    def mark(line: Column, i: Column) -> Column:
        def of(clean: Column, n: Column) -> Column:
            kind = F.when(_skipped(line, clean, i), 0).when(n >= 18, 1).otherwise(2)
            return F.struct(kind.alias("kind"), clean.alias("clean"), n.alias("n"), tx.has(clean, lx.SENTENCE_END).alias("ends"))

        return tx.bound(tx.squeezed(line), lambda clean: tx.bound(tx.n_words(clean), lambda n: of(clean, n)))

    blocks = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), tx.strip), lambda p: p != "")
    return tx.bound(joined_units(F.transform(tx.lines(text), mark)), lambda units: F.when(F.size(units) > 0, units).otherwise(blocks))
