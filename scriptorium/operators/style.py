"""Style of whole texts: naturalness with its measures, and the statistical fingerprint."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx
from scriptorium.operators import measures


@dataclass(frozen=True)
class Variation:
    """Targets of variation; the defaults are the high level, `moderate()` the other."""

    lexical: float = 0.64
    sentence_cv: float = 0.50
    paragraph_cv: float = 0.42
    short_share: float = 0.10
    long_share: float = 0.14
    word_change: float = 0.18

    @staticmethod
    def moderate() -> Variation:
        return Variation(0.56, 0.38, 0.30, 0.06, 0.09, 0.10)

    @staticmethod
    def configured(spark: SparkSession) -> Variation:
        """By the settings scriptorium.variation.lexical and .rhythm ("moderate" or "high", which is also what others mean) and .word_change.

        Unless it is set, the limit of changed words is the high one where either level is high.
        """
        high = {k: (spark.conf.get(f"scriptorium.variation.{k}", "high") or "").strip().lower() != "moderate" for k in ("lexical", "rhythm")}
        of = {k: Variation() if v else Variation.moderate() for k, v in high.items()}
        words = Variation() if any(high.values()) else Variation.moderate()
        change = float(spark.conf.get("scriptorium.variation.word_change", "") or words.word_change)
        return replace(of["rhythm"], lexical=of["lexical"].lexical, word_change=change)


def needs_edit(mode: str) -> Column:
    """Whether a text of a style_report calls for an editor: all do in "deep" mode, else those with an issue that an editor can mend."""
    issues = (
        "generic_phrase_hits", "repeated_sentence_openings", "repeated_paragraph_openings", "long_sentence_count", "overloaded_sentence_count",
        "repeated_frame_density",
    )
    return F.lit(True) if mode == "deep" else (F.greatest(*map(F.col, issues)) > 0) | (F.col("generic_connector_hits") > 2)


def style_report(docs: DataFrame, targets: Variation | None = None) -> DataFrame:
    """doc_id and the measures of each text, with naturalness_score (100 less penalties).  Null text is empty."""
    measured = docs.select("doc_id", measures.style(F.coalesce(F.col("text"), F.lit(""))).alias("measured"))
    return measured.select("doc_id", *report_of(F.col("measured"), targets))


def report_of(m: Column, targets: Variation | None = None) -> list[Column]:
    """The columns of a style report, from the measures of `measures.STYLE`."""
    t = targets or Variation()
    n, blocks_n = F.greatest(m["n_lengths"], F.lit(1)), m["n_blocks"]
    short, long = m["short"] / n, m["long"] / n
    many, blocks = m["n_lengths"] >= 8, blocks_n >= 4
    even = (m["n_lengths"] >= 6) & (m["s_sd"] < 5)
    even_blocks = blocks & (m["p_sd"] < 18)

    def most(limit_: int, value: Column) -> Column:
        return F.least(F.lit(limit_), value.cast("int"))

    def gap(target: float, value: Column, by: int, limit_: int, when: Column | bool) -> Column:
        return F.when(F.lit(when) & (value < target), most(limit_, F.bround((F.lit(target) - value) * by, 0))).otherwise(0)

    penalty = (
        most(24, m["generic_phrase_hits"] * 4) + most(14, m["repeated_sentence_openings"] * 2) + most(14, m["repeated_paragraph_openings"] * 3)
        + most(10, F.greatest(F.lit(0), m["generic_connector_hits"] - 2) * 2) + most(14, m["long_sentence_count"])
        + most(12, m["overloaded_sentence_count"] * 2) + most(8, m["very_short_sentence_count"] * 2) + most(12, m["repeated_frame_density"])
        + F.when(even, 7).otherwise(0) + F.when(even_blocks, 5).otherwise(0) + gap(t.lexical, m["msttr"], 50, 10, True)
        + gap(t.sentence_cv, m["s_cv"], 20, 10, many) + gap(t.paragraph_cv, m["p_cv"], 15, 7, blocks)
        + F.when(many & (short < t.short_share), 4).otherwise(0) + F.when(many & (long < 0.07), 2).otherwise(0)
    )
    met = (m["msttr"] >= t.lexical) & (m["s_cv"] >= t.sentence_cv) & (m["p_cv"] >= t.paragraph_cv)
    named = F.map_from_arrays(F.array(*map(F.lit, lx.STYLE_FRAMES)), m["frames"])
    counts = (
        "generic_phrase_hits", "repeated_sentence_openings", "repeated_paragraph_openings", "generic_connector_hits", "long_sentence_count",
        "overloaded_sentence_count", "very_short_sentence_count", "repeated_frame_density",
    )
    return [
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).alias("naturalness_score"),
        *[m[k].alias(k) for k in ("word_count", "paragraph_count", "sentence_count")],
        F.bround(m["msttr"], 3).alias("lexical_diversity_msttr"),
        F.bround(m["s_cv"], 3).alias("sentence_length_cv"),
        F.bround(m["p_cv"], 3).alias("paragraph_length_cv"),
        F.bround(short, 3).alias("short_sentence_ratio"),
        F.bround(long, 3).alias("long_sentence_ratio"),
        F.bround(m["s_sd"], 2).alias("sentence_length_std_dev"),
        F.bround(m["p_sd"], 2).alias("paragraph_length_std_dev"),
        (met & (short >= t.short_share) & (long >= t.long_share)).alias("variation_targets_met"),
        *[m[k].alias(k) for k in counts],
        F.map_filter(named, lambda _, v: v > 0).alias("repeated_frames"),
        even.alias("uniform_sentence_rhythm"), even_blocks.alias("uniform_paragraph_rhythm"),
    ]


def word_table(prose: DataFrame) -> DataFrame:
    """doc_id, word, n: how often each word stands in a text; partial counts are made before the exchange."""
    return prose.select("doc_id", F.explode(tx.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


def top_token_share(prose: DataFrame, k: int = 12) -> DataFrame:
    """doc_id, top_share (the k most frequent words), common_share (stock words), n_words, each share of all words."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "word"))
    ranked = word_table(prose).withColumn("rank", rank).withColumn("common", F.col("word").isin(*lx.COMMON_TOKENS))
    return ranked.groupBy("doc_id").agg(
        (F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")).alias("top_share"),
        (F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)) / F.sum("n")).alias("common_share"),
        F.sum("n").alias("n_words"),
    )


def ngram_repetition(prose: DataFrame) -> DataFrame:
    """doc_id, repeated_units, n_words, ngram_pct: runs of 2 to 4 words, not all stock words, that occur three times or more.

    Counted within the row, without an exchange: runs are 64-bit hashes, sorted, and every one that equals
    the one two places before it is a third or later occurrence.
    """
    w = prose.select("doc_id", tx.words(F.col("text")).alias("words")).withColumn("n_words", F.size("words"))
    w = w.select(
        "doc_id", "n_words", F.transform("words", lambda x: F.xxhash64(x)).alias("h1"), F.transform("words", lambda x: ~x.isin(*lx.STOPWORDS)).alias("own1")
    )
    for n in (2, 3, 4):
        last, more = F.slice("h1", n, F.size("h1")), F.slice("own1", n, F.size("h1"))
        size = F.greatest(F.lit(0), F.col("n_words") - n + 1)
        w = w.withColumns(
            {
                f"h{n}": F.zip_with(F.slice(f"h{n - 1}", F.lit(1), size), last, lambda a, b: F.xxhash64(a, b)),
                f"own{n}": F.zip_with(F.slice(f"own{n - 1}", F.lit(1), size), more, lambda a, b: a | b),
            }
        )
    ranked = w.select(
        "doc_id", "n_words",
        *[F.sort_array(F.array_compact(F.zip_with(f"h{n}", f"own{n}", lambda h, own: F.when(own, h)))).alias(f"g{n}") for n in (2, 3, 4)],
    )

    def units(n: int) -> Column:
        g = F.col(f"g{n}")
        rest = F.greatest(F.lit(0), F.size(g) - 2)
        again = F.zip_with(F.slice(g, F.lit(3), rest), F.slice(g, F.lit(1), rest), lambda a, b: a == b)
        return F.size(F.filter(again, lambda same: same)).cast("long") * n

    both = ranked.withColumn("repeated_units", F.when(F.col("n_words") >= 20, units(2) + units(3) + units(4)).otherwise(0).cast("long")).drop("g2", "g3", "g4")
    return both.withColumn("ngram_pct", ngram_share(F.col("repeated_units"), F.col("n_words")))


def ngram_share(repeated_units: Column, n_words: Column) -> Column:
    return tx.percent(repeated_units / F.greatest(F.lit(1), n_words) * 180)


def syntactic_signature(sentence: Column) -> Column:
    s = tx.strip(sentence)
    return (
        F.when(tx.has(s, lx.CONNECTOR), "generic-transition opening")
        .when(tx.has(s, r"^(this|these|it|the study|the chapter)\b"), "demonstrative or study-subject opening")
        .when(tx.has(s, r"^[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s+(?:is|are|was|were|has|have|can|may|should)\b", True), "noun phrase plus linking verb")
        .when(tx.has(s, r"\b(?:is|are|was|were|be|been|being)\s+\w+ed\b"), "passive construction")
        .otherwise("other")
    )


def content_density(text: Column) -> Column:
    kept = F.filter(tx.words(text), lambda w: (F.length(w) > 2) & ~w.isin(*lx.STOPWORDS))
    return F.size(kept) / F.greatest(F.lit(1), tx.n_words(text))


def evenness(sn: Column, s_cv: Column, pn: Column, p_cv: Column) -> Column:
    """0 to 100, from the numbers of sentences and paragraphs and how their shares of content words vary."""
    a = F.when((sn >= 6) & (s_cv < 0.12), 55).otherwise(F.greatest(F.lit(0.0), (F.lit(0.22) - s_cv) * 180))
    b = F.when((pn >= 4) & (p_cv < 0.10), 30).otherwise(F.greatest(F.lit(0.0), (F.lit(0.18) - p_cv) * 120))
    return tx.percent(a + b)


def temporal_score(text: Column, as_of_year: int) -> Column:
    """0 to 100: vague time without years, years to come, or only old ones."""
    years = F.transform(tx.found(text, lx.YEAR), lambda y: y.cast("int"))
    return untimely(tx.hits(text, lx.VAGUE_TIME_WIDE), F.array_max(years), as_of_year)


def untimely(vague: Column, latest: Column, as_of_year: int) -> Column:
    """The temporal score from how often time is vague, and the last year that is named, null if none is."""
    return tx.percent(
        F.when(vague > 0, F.least(F.lit(55), vague * 12)).otherwise(0)
        + F.when((vague > 0) & latest.isNull(), 35).otherwise(0)
        + F.when(latest > as_of_year + 1, 45).otherwise(0)
        + F.when((latest < as_of_year - 6) & (vague > 0), 25).otherwise(0)
    )


def implausibility(text: Column, unsupported: Column) -> Column:
    """0 to 100: impossible percentages, p-values and coefficients, unsupported claims, repeated certainty."""

    def values(pattern: str, bad) -> Column:
        caught = F.regexp_extract_all(text, F.lit(tx.rx(pattern)), 1)
        return F.size(F.filter(caught, lambda v: bad(v.cast("double"))))

    p = values(lx.P_VALUE, lambda v: (v < 0) | (v > 1))
    r = values(lx.COEFFICIENT, lambda v: F.abs(v) > 1)
    return implausible(tx.hits(text, lx.IMPLAUSIBLE_PERCENT), p, r, unsupported, tx.hits(text, lx.CERTAINTY))


def implausible(percentages: Column, p: Column, r: Column, unsupported: Column, certain: Column) -> Column:
    """The score of implausibility from the numbers of what is."""
    return tx.percent(
        F.least(F.lit(50), percentages * 25) + F.least(F.lit(45), p * 20) + F.least(F.lit(45), r * 20)
        + F.least(F.lit(45), unsupported * 15) + F.when(certain >= 4, F.least(F.lit(30), (certain - 3) * 6)).otherwise(0)
    )


#: The metrics of the fingerprint and their weights.
FINGERPRINT = {
    "perplexity_proxy": 0.18, "burstiness": 0.20, "token_distribution_proxy": 0.17, "ngram_frequency": 0.15,
    "uniform_semantic_density": 0.10, "repetitive_syntactic_structures": 0.10, "systemic_transitions": 0.05, "low_vocabulary_diversity": 0.05,
}
GROUPS = {
    "primary": ("perplexity_proxy", "burstiness", "token_distribution_proxy"),
    "linguistic": ("ngram_frequency", "uniform_semantic_density", "repetitive_syntactic_structures"),
    "vocabulary": ("typo_absence", "systemic_transitions", "low_vocabulary_diversity"),
    "semantic": ("temporal_awareness", "hallucination_patterns"),
}


def fingerprint(docs: DataFrame, as_of_year: int, targets: Variation | None = None) -> DataFrame:
    """doc_id, the eleven metrics (0 to 100), a percentage for each group of them, and statistical_pct, of the prose of documents that have some.

    docs(doc_id, text); one reading of each text.
    """
    t, c = targets or Variation(), F.col
    # dealt out anew, as a file of a few MB may hold work for an hour
    read = docs.repartition("doc_id").select("doc_id", F.inline(measures.fingerprint(c("text"))))
    known = read.select(
        "*", *report_of(c("style"), t), ngram_share(c("repeated_units"), c("n_words")).alias("ngram_pct"),
        evenness(c("sn"), c("density_s_cv"), c("pn"), c("density_p_cv")).alias("semantic_pct"),
    )
    total, typos = c("n_words"), c("typos")
    polished = F.when((total >= 250) & (typos == 0), F.when(total < 800, 55).otherwise(75)).when(typos > 0, F.greatest(F.lit(0), 25 - F.least(F.lit(25), typos * 4)))
    metrics = weighted_metrics(t, c("transitions")) | {
        "typo_absence": F.coalesce(polished, F.lit(0)),
        "temporal_awareness": untimely(c("vague"), c("latest"), as_of_year),
        "hallucination_patterns": implausible(*map(c, ("percentages", "p_values", "coefficients", "unsupported", "certain"))),
    }
    order = [*(k for keys in GROUPS.values() for k in keys)]
    out = known.select("doc_id", *[metrics[k].cast("int").alias(k) for k in order])
    groups = {f"{g}_pct": tx.percent(sum((c(k) for k in keys), F.lit(0)) / len(keys)) for g, keys in GROUPS.items()}
    return out.withColumns(groups | {"statistical_pct": statistical()})


def weighted_metrics(t: Variation, transitions: Column) -> dict[str, Column]:
    """The metrics of FINGERPRINT, from the columns of a style report and top_share, common_share, ngram_pct, semantic_pct, syntax_share."""
    zero, c = F.lit(0.0), F.col
    low = F.greatest(zero, t.lexical - c("lexical_diversity_msttr"))
    repeated = c("repeated_sentence_openings") + c("repeated_paragraph_openings")
    rhythm = tx.percent(F.greatest(zero, t.sentence_cv - c("sentence_length_cv")) * 120 + F.greatest(zero, t.paragraph_cv - c("paragraph_length_cv")) * 80)
    rhythm = F.when(c("uniform_sentence_rhythm"), tx.percent(rhythm + 18)).otherwise(rhythm)
    rhythm = F.when(c("uniform_paragraph_rhythm"), tx.percent(rhythm + 12)).otherwise(rhythm)
    return {
        "perplexity_proxy": tx.percent(low * 130 + c("generic_phrase_hits") * 5 + repeated * 3 + c("repeated_frame_density") * 2),
        "burstiness": rhythm,
        "token_distribution_proxy": tx.percent(
            F.greatest(zero, c("common_share") - 0.42) * 170 + F.greatest(zero, c("top_share") - 0.50) * 150 + c("generic_phrase_hits") * 2
        ),
        "ngram_frequency": c("ngram_pct"),
        "uniform_semantic_density": c("semantic_pct"),
        "repetitive_syntactic_structures": tx.percent(c("syntax_share") * 100 + repeated * 7),
        "systemic_transitions": tx.percent(c("generic_connector_hits") * 8 + F.greatest(F.lit(0), transitions - 4) * 5),
        "low_vocabulary_diversity": tx.percent(low * 170 + F.greatest(zero, c("top_share") - 0.50) * 120),
    }


def statistical() -> Column:
    """The weighted metrics of a row."""
    return tx.percent(sum((F.col(k) * w for k, w in FINGERPRINT.items()), F.lit(0.0)))
