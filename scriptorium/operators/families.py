"""The nine signal families A to I of a document, the counter-evidence J, and what is read off them.

One row per document throughout.  The texts are measured by `functions.scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx
from scriptorium.operators import measures
from scriptorium.operators.segments import by_document

WEAK, MODERATE, STRONG = "weak", "moderate", "strong"


def evidence(*found: tuple[Column, str | Column, str | Column]) -> Column:
    """(condition, description, severity) -> the evidence that holds; one piece for each description."""
    pieces = []
    for condition, description, severity in found:
        d = F.lit(description) if isinstance(description, str) else description
        s = F.lit(severity) if isinstance(severity, str) else severity
        pieces.append((condition, F.struct(d.alias("description"), s.alias("severity"))))
    return tx.listed(pieces, "struct<description: string, severity: string>")


def score(found: Column) -> Column:
    def n(kind: str) -> Column:
        return F.size(F.filter(found, lambda e: e["severity"] == kind))

    return tx.severity(n(WEAK), n(MODERATE), n(STRONG))


def longest_runs(sentences: Column) -> Column:
    """array<struct<start, n, at>>: runs of two or more sentences in a row that begin with the same two words; at: the first one's place, from 0."""

    def runs(starts: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(starts) - 1, F.lit(0)))
        begins = F.filter(places, lambda i: (i == 0) | (F.get(starts, i) != F.get(starts, i - 1)))

        def closed(b: Column) -> Column:
            ends = F.concat(F.slice(b, F.lit(2), F.size(b)), F.array(F.size(starts)))
            return F.zip_with(b, ends, lambda x, y: F.struct(F.get(starts, x).alias("start"), (y - x).alias("n"), x.alias("at")))

        return F.flatten(F.transform(F.array(begins), closed))

    # one-element arrays bind the openings, and the places where runs begin, once
    found = F.flatten(F.transform(F.array(F.transform(sentences, lambda s: tx.opening(s, 2))), runs))
    return F.filter(found, lambda r: (r["n"] >= 2) & (r["start"] != ""))


def windows(lengths: Column) -> Column:
    """array: for each three lengths in a row, the difference of the greatest and the least."""
    n = F.size(lengths) - 2
    three = [F.slice(lengths, F.lit(i), F.greatest(F.lit(0), n)) for i in (1, 2, 3)]
    pairs = F.zip_with(three[0], three[1], lambda a, b: F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    return F.zip_with(pairs, three[2], lambda p, c: F.greatest(p["hi"], c) - F.least(p["lo"], c))


def tight(lengths: Column) -> Column:
    """How many windows of three lengths are at most five words apart."""
    return F.size(F.filter(windows(lengths), lambda d: d <= 5))


def burstiness(segments: DataFrame) -> DataFrame:
    """doc_id, windows, tight: windows of three sentences of a document, and those of like length; none of shorter documents."""
    each = by_document(segments).select("doc_id", F.transform("sentences", tx.n_words).alias("lengths")).where(F.size("lengths") >= 3)
    return each.select("doc_id", F.size(windows(F.col("lengths"))).cast("long").alias("windows"), tight(F.col("lengths")).cast("long").alias("tight"))


def anaphora(segments: DataFrame) -> DataFrame:
    """doc_id, at (index of the first sentence), start, n of runs of sentences that begin alike."""
    runs = by_document(segments).select("doc_id", F.col("at").alias("indexes"), F.inline(longest_runs(F.col("sentences"))))
    return runs.select("doc_id", F.get("indexes", F.col("at")).alias("at"), "start", F.col("n").cast("long").alias("n"))


def family_evidence(measured: DataFrame) -> DataFrame:
    """`measured`, which has the columns of `measures.FAMILIES`, with evidence columns A to J (academic values)."""
    c = F.col
    per_1000 = F.greatest(F.lit(1), c("words"))
    share = c("tight") / F.greatest(F.lit(1), c("n") - 2)
    density, hedging = c("n_vocabulary") / per_1000 * 1000, c("hedges") / per_1000 * 1000
    distinct = c("n_different")
    bullet_share = c("bullet_words") / per_1000
    safe = F.when((density >= 6) | (c("n_vocabulary") >= 8), STRONG).when((density >= 3) | (c("n_vocabulary") >= 4), MODERATE).otherwise(WEAK)
    few, many = c("n") < 8, c("n") >= 8
    even = (c("n") >= 8) & (c("sentence_cv") < 0.25) & (c("n_paragraphs") >= 3) & (c("paragraph_cv") < 0.25)
    frames = F.coalesce(c("repeated_frame_density"), F.lit(0))
    families = {
        "A": evidence(
            ((c("n_vocabulary") > 0) & ((distinct >= 2) | (density >= 2.5)), "Safe vocabulary is frequent.", safe),
            (c("adjectives") >= 4, "Generic evaluative wording recurs.", F.when(c("adjectives") >= 6, MODERATE).otherwise(WEAK)),
        ),
        "B": evidence(
            (few & (c("tight") > 0), "Three sentences in a row are of like length.", MODERATE),
            (~(few & (c("tight") > 0)) & (share >= 0.28), "Windows of three like lengths are common.", MODERATE),
            (~(few & (c("tight") > 0)) & (share < 0.28) & (share >= 0.14) & (c("sentence_cv") < 0.45), "Windows of three like lengths recur.", WEAK),
            (many & (c("sentence_cv") < 0.22), "Sentence length varies little.", MODERATE),
            (many & (c("sentence_cv") >= 0.22) & (c("sentence_cv") < 0.30), "Sentence rhythm is fairly uniform.", WEAK),
        ),
        "C": evidence(
            ((c("hedges") > 0) & ((hedging >= 3) | (c("hedges") >= 7)), "Hedges are dense.", F.when(hedging >= 7, MODERATE).otherwise(WEAK)),
        ),
        "D": evidence(
            ((c("bullets") >= 12) & (bullet_share >= 0.45), "Lists make up much of the text.", WEAK),
            (c("conclusion"), "A formulaic conclusion opener.", MODERATE),
            (c("tricolons") >= 2, "Symmetrical three-part constructions recur.", MODERATE),
            (c("diminished") > 0, "A not-X-but-Y pivot.", WEAK),
            ((c("n_paragraphs") >= 5) & (c("paragraph_cv") < 0.18), "Paragraph lengths are unusually even.", WEAK),
            (frames >= 7, "Framing phrases recur densely.", WEAK),
        ),
        "E": evidence(
            (c("obscured") >= 2, "Frames that hide who acts.", MODERATE),
            (c("universal") >= 2, "Universal claims about groups.", MODERATE),
        ),
        "F": evidence(
            (c("strong") > 0, "Strong formulaic transitions.", F.when(c("strong") >= 2, STRONG).otherwise(MODERATE)),
            (c("moderate") >= 2, "Formulaic pivots recur.", MODERATE),
        ),
        "G": evidence(
            (c("dashes") > F.greatest(F.lit(1), F.floor(c("words") / 300)), "Em dashes are frequent for the length.", MODERATE),
            (c("paired"), "An aside between em dashes.", WEAK),
            (c("semicolons") >= F.greatest(F.lit(8), F.floor(c("words") / 100)), "Semicolons are dense.", WEAK),
            (c("colons") > 0, "An announcement before a colon.", MODERATE),
        ),
        "H": evidence((c("informal") & (c("n") >= 4) & (c("complete") / F.greatest(c("n"), F.lit(1)) > 0.9), "Informal markers on polished prose.", STRONG)),
        "I": evidence(
            *[(c("rhetoric") > i, f"Rhetorical construction {i + 1} of those that recur.", WEAK) for i in range(8)],
            (c("anaphora"), "Sentences in a row start alike.", WEAK),
            (c("questions") >= 2, "Parallel question lists recur.", MODERATE),
            (even, "Rhythm is smooth across sentences and paragraphs.", WEAK),
        ),
        "J": evidence(
            (c("corrected"), "A self-correction in mid-thought.", MODERATE),
            (c("dated"), "A dated personal detail.", MODERATE),
            (c("technical") >= 3, "Methods, exact statistics and named sources.", WEAK),
            (c("technical") == 2, "Some technical detail.", WEAK),
        ),
    }
    return measured.withColumns({f"{k}_evidence": v for k, v in families.items()})


def family_scores(prose: DataFrame) -> DataFrame:
    """One row per document of prose(doc_id, text, repeated_frame_density): the columns of `judged`."""
    measured = prose.withColumn("measured", measures.families(F.col("text")))
    return judged(measured.select("*", "measured.*").drop("measured"))


def judged(measured: DataFrame) -> DataFrame:
    """`measured`, which has the columns of `measures.FAMILIES`, with scores A to J (0 to 3), weighted total, category, lexical and consistency
    percentages, verdict and confidence.

    The total is on the scale of 27 points that the verdict uses; J only bears on confidence.
    """
    c = F.col
    w = lx.FAMILY_WEIGHTS
    most = sum(3 * x for x in w.values())
    objective = "ABCFG"
    scored = family_evidence(measured).withColumns({k: score(F.col(f"{k}_evidence")) for k in [*w, "J"]})
    weighted = {k: F.bround(F.col(k) * x, 2) for k, x in w.items()}
    total = F.bround(sum(weighted.values(), F.lit(0.0)), 2)
    n, cv, p, pcv = c("n"), c("sentence_cv"), c("n_paragraphs"), c("paragraph_cv")
    rhythm = F.when(n < 8, 0).when(cv < 0.22, 35).when(cv < 0.30, 22).when(cv < 0.38, 10).otherwise(0)
    blocks = F.when(p < 5, 0).when(pcv < 0.18, 25).when(pcv < 0.28, 14).when(pcv < 0.40, 7).otherwise(0)
    points = rhythm + blocks + F.least(F.lit(30), c("D") * 6 + c("I") * 4)
    lexical = sum((weighted[k] for k in objective), F.lit(0.0)) / sum(3 * w[k] for k in objective) * 100
    active = tx.count_true(F.col(k) > 0 for k in w)
    strong = tx.count_true(F.col(k) >= 2 for k in w)
    shares = scored.withColumns({"weighted_total": total, "active": active, "corroborating": strong})
    out = shares.withColumns(
        {
            "scaled": c("weighted_total") * (27 / most),
            "conditional": (weighted["C"] + weighted["H"] + weighted["I"]) / F.greatest(F.lit(0.001), c("weighted_total")),
            "lexical_pct": tx.percent(lexical),
            "consistency_pct": tx.percent(points),
        }
    )
    rounded = F.bround("scaled", 0)
    first = (
        F.when(c("words") < 100, F.when(c("corroborating") >= 3, "Medium").otherwise("Low"))
        .when(c("words") < 180, "Medium")
        .when((c("active") >= 6) & (c("corroborating") >= 4) & ((rounded >= 14) | (rounded <= 4)), "High")
        .otherwise("Medium")
    )
    capped = ((c("conditional") > 0.60) & (c("weighted_total") > 0)) | (c("J") >= 2)
    return out.withColumns(
        {
            "category_pct": tx.percent(c("scaled") / 27 * 100),
            "verdict": tx.verdict(rounded),
            "confidence": F.when((first == "High") & capped, "Medium").otherwise(first),
        }
    )


def signals(scores: DataFrame) -> DataFrame:
    """Long form: doc_id, key, name, score, weight, weighted_score, evidence for each family of each document."""
    rows = [
        F.struct(
            F.lit(k).alias("key"), F.lit(lx.FAMILY_NAMES[k]).alias("name"), F.col(k).alias("score"), F.lit(x).alias("weight"),
            F.bround(F.col(k) * x, 2).alias("weighted_score"), F.col(f"{k}_evidence").alias("evidence"),
        )
        for k, x in lx.FAMILY_WEIGHTS.items()
    ]
    return scores.select("doc_id", F.inline(F.array(*rows)))


def strongest(long: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, families: the names of the n strongest families that score, by weighted score, evidence and key."""
    order = F.struct((-F.col("weighted_score")).alias("w"), (-F.size("evidence")).alias("e"), "key", "name")
    ranked = long.where("score > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("x"))
    return ranked.select("doc_id", F.transform(F.slice("x", 1, n), lambda x: x["name"]).alias("families"))
