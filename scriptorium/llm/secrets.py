"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is trained on random strings, the other on ordinary identifiers.  A token
whose characters follow each other rather as in the first is taken for a secret.
All of it is column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.columns import code_points, match_starts, scanned, whole
from scriptorium.llm.quality import training_rows

#: The base patterns.  Of the first, group 2 must have ASSIGNED characters or more.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGNED = 12
#: In the order in which spans that start together are listed; the last is the models'.
KINDS = ("assign", "access", "hex", "markov")

#: What the models see: a start mark, and the characters of tokens.
ALPHABET = "^ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 20
TOKEN = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: What joins the parts of a token; a part is a run without joints, or of joints alone.
JOINTS = "[/=_+-]+"
PARTS = f"[A-Za-z0-9]+|{JOINTS}"

#: Ordinary words of which identifiers are made for training, of the languages that the corpora hold.
WORDS = """account address after amount and array available base before between bibliotheca branch buffer build cache
category central change chapter check class client collection color column command comment commit common community
company config connection container content control country create current customer data database date default
delete description development device different directory document download during element email encoding error
event example factory feature field file filter first folder for format from function general geschichte group
handler header height history http identifier image implementation important index information input interface
internal international item journal kingdom language length letter library line list local location login manager
message method model module mountain name national network node number object oder open option order output
package page parameter parent parse password path people person plugin point position private process product
project property provider public query question random range reader record reference register release remote report
request resource response result return river route schema school science search second section security select
sentence server service session setting should simple size some source spring standard state status stream string
structure student style system table target template test text the their there thing this thread through time title
token total transaction translation tree type under unit university update upload user utility value variable
version view water which width window with without word world writer year zeitung gesellschaft entwicklung
information nacional historia desarrollo universidad maison travail politique changement""".split()


def labelled_samples(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """text, secret (1: random characters, 0: identifiers made of words, and some rules of marks); the same for a given number of rows."""
    sets = [ALPHABET[1:63], ALPHABET[1:65], ALPHABET[27:63], ALPHABET[1:27] + ALPHABET[53:63], "0123456789abcdef",
            ALPHABET[1:53], ALPHABET[27:53], ALPHABET[1:27]]
    listed = {"sets": sets, "words": WORDS, "joints": ["", "_", "-", "/", "_", ""], "marks": list(ALPHABET[63:])}
    arrays = [F.array(*map(F.lit, x)).alias(k) for k, x in listed.items()]
    word = f"element_at(words, 1 + int(pmod(xxhash64(id, i), {len(WORDS)})))"
    return (
        spark.range(rows)
        .select("id", *arrays)
        .selectExpr("*", "int(id % 2) AS secret", "int(id div 2) AS n")
        .selectExpr("*", f"element_at(sets, 1 + n % {len(sets)}) AS chars", "element_at(joints, 1 + n % 6) AS joint")
        .selectExpr(
            "secret",
            f"""CASE WHEN secret = 1 THEN array_join(transform(sequence(1, 20 + int(pmod(xxhash64(id, 'n'), 29))),
                    i -> substr(chars, 1 + int(pmod(xxhash64(id, i), length(chars))), 1)), '')
                WHEN n % 21 = 20 THEN array_join(transform(sequence(1, 1 + int(pmod(xxhash64(id, 'w'), 4))),
                    i -> repeat(element_at(marks, 1 + int(pmod(xxhash64(id, i), size(marks)))), 4 + int(pmod(xxhash64(id, i, 'r'), 30)))), '+')
                ELSE array_join(transform(sequence(1, 3 + int(pmod(xxhash64(id, 'w'), 4))), i -> CASE
                    WHEN n % 6 = 0 THEN initcap({word}) WHEN n % 6 = 1 THEN upper({word})
                    WHEN n % 6 = 2 AND i % 4 = 3 THEN string(pmod(xxhash64(id, i), 2030)) ELSE {word} END), joint) END AS text""",
        )
    )


def ordinary_words(docs: DataFrame, labels: DataFrame, most: int = 2000, most_words: int = 3000) -> DataFrame:
    """text, secret (0): distinct words of letters, of at most `most` documents that labels.quality calls good; the documents and the words by a hash.

    They teach the identifier model the language of the corpus.  Words of twenty letters or more
    are left out, as they may be keys.  Without good documents there are none.
    """
    good = training_rows(docs, labels.where("quality = 1"), "quality", most)
    words = good.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("text")).where(F.length("text").between(3, LEAST - 1))
    return words.distinct().orderBy(F.xxhash64("text"), "text").limit(most_words).select("text", F.lit(0).alias("secret"))


def corpus_model(docs: DataFrame, labels: DataFrame) -> list[float]:
    """Trained on samples made by rule and on ordinary words of labelled documents of the corpus."""
    return trained(labelled_samples(docs.sparkSession).unionByName(ordinary_words(docs, labels)))


def trained(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """log P(next | character, random) - log P(next | character, identifier) for all pairs of the alphabet, row by row.

    samples(text, secret): rows with a null in either are left out.  The counts brought
    to the driver are at most two for each pair of characters.
    """
    n = len(ALPHABET)
    index = f"transform(split(text, ''), c -> greatest(1, instr('{ALPHABET}', c)))"
    pairs = (
        samples.where("text IS NOT NULL AND text <> '' AND secret IS NOT NULL")
        .selectExpr("secret", f"{index} AS i")
        .selectExpr("secret", "explode(zip_with(concat(array(1), slice(i, 1, size(i) - 1)), i, (a, b) -> struct(a, b))) AS p")
        .groupBy("secret", "p.a", "p.b")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = [[[smoothing] * n for _ in range(n)] for _ in range(2)]
    for r in pairs.collect():
        counts[r["secret"]][r["a"] - 1][r["b"] - 1] += r["n"]
    p = [[[math.log(x / sum(row)) for x in row] for row in kind] for kind in counts]
    return [p[1][a][b] - p[0][a][b] for a in range(n) for b in range(n)]


def log_ratio(token: Column, model: list[float]) -> Column:
    """The sum of the model over the characters of a token, from the start mark on; the token is split once, so it costs its length."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")  # folded once
    places = F.transform(F.split(token, ""), lambda c: F.greatest(F.lit(1), F.call_function("instr", F.lit(ALPHABET), c)))
    state = F.struct(F.lit(1).alias("before"), F.lit(0.0).alias("sum"))

    def step(acc: Column, at: Column) -> Column:
        return F.struct(at.alias("before"), (acc["sum"] + F.element_at(table, (acc["before"] - 1) * len(ALPHABET) + at)).alias("sum"))

    return F.aggregate(places, state, step, lambda acc: acc["sum"])


def likely_spans(token: Column, model: list[float], threshold: float) -> Column:
    """array<struct<start, end>> in a token: all of it if its mean ratio is at least `threshold`, or else each likely stretch of parts.

    A part weighs what its ratio, as a token of its own, is over the threshold, joints are
    below it by just the threshold.  A stretch goes on while its weights sum to more than
    zero, ends where the sum is greatest, and counts from LEAST characters on.
    """
    span = "struct<start: bigint, end: bigint>"

    def weighed(part: Column) -> Column:
        ratio = F.when(part.rlike(f"^{JOINTS}"), F.lit(0.0)).otherwise(log_ratio(part, model))
        return F.struct(code_points(part).alias("n"), (ratio - threshold * F.length(part)).alias("weight"))

    def ended(acc: Column) -> Column:
        long = (acc["best"] > 0) & (acc["end"] - acc["start"] >= LEAST)
        return F.when(long, F.concat(acc["done"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["done"])

    def step(acc: Column, part: Column) -> Column:
        new = acc["sum"] <= 0
        total = F.when(new, F.lit(0.0)).otherwise(acc["sum"]) + part["weight"]
        best, at = F.when(new, F.lit(0.0)).otherwise(acc["best"]), acc["at"] + part["n"]
        return F.struct(
            at.alias("at"),
            total.alias("sum"),
            F.when(new, acc["at"]).otherwise(acc["start"]).alias("start"),
            F.when(total > best, at).otherwise(acc["end"]).alias("end"),
            F.greatest(total, best).alias("best"),
            F.when(new, ended(acc)).otherwise(acc["done"]).alias("done"),
        )

    zero = F.lit(0).cast("long")
    state = F.struct(
        zero.alias("at"), F.lit(0.0).alias("sum"), zero.alias("start"), zero.alias("end"), F.lit(0.0).alias("best"), F.array().cast(f"array<{span}>").alias("done")
    )
    parts = F.transform(F.regexp_extract_all(token, F.lit(PARTS), 0), weighed)
    all_of_it = F.array(F.struct(zero.alias("start"), code_points(token).alias("end")))
    return F.when(log_ratio(token, model) >= threshold * F.length(token), all_of_it).otherwise(F.aggregate(parts, state, step, ended))


def _spans(text: Column, pattern: str, kind: int, good: Column, matches: Column) -> Column:
    """array<struct<start, kind, end>> of the matches for which `good`, an array of booleans, holds."""
    starts = match_starts(text, pattern, matches)
    found = F.zip_with(
        F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + code_points(m)).alias("end"))),
        good,
        lambda span, ok: F.struct(span.alias("span"), ok.alias("ok")),
    )
    kept = F.transform(F.filter(found, lambda x: x["ok"]), lambda x: x["span"])
    nothing = F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")
    return F.when(F.size(matches) > 0, kept).otherwise(nothing)


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scanned_secrets(docs: DataFrame, model: list[float], threshold: float = 0.35, text: str = "text") -> DataFrame:
    """`docs` with base_spans and spans: array<struct<start, kind, end>>, in code points, end exclusive, by start and kind.

    base_spans are the matches of the base patterns, spans those and, of the tokens of
    LEAST characters or more, what `likely_spans` finds.  Null and empty texts have none.  Existing columns of these names are replaced.
    """
    t = whole(text)
    every = docs.drop("base_spans", "spans").select(
        "*",
        F.regexp_extract_all(t, F.lit(ASSIGN), 0).alias("__assign"),
        F.regexp_extract_all(t, F.lit(ASSIGN), 2).alias("__value"),
        F.regexp_extract_all(t, F.lit(ACCESS), 0).alias("__access"),
        F.regexp_extract_all(t, F.lit(HEX), 0).alias("__hex"),
        F.regexp_extract_all(t, F.lit(TOKEN), 0).alias("__token"),
    )
    good = F.transform(F.col("__value"), lambda v: F.length(v) >= ASSIGNED)
    likely = F.transform(F.col("__token"), lambda x: likely_spans(x, model, threshold))
    marked = every.withColumn("__likely", likely)
    parts = marked.select(
        *docs.drop("base_spans", "spans").columns,
        _spans(t, ASSIGN, 0, good, F.col("__assign")).alias("__s0"),
        _spans(t, ACCESS, 1, F.transform("__access", lambda _: F.lit(True)), F.col("__access")).alias("__s1"),
        _spans(t, HEX, 2, F.transform("__hex", lambda _: F.lit(True)), F.col("__hex")).alias("__s2"),
        F.when(
            F.exists("__likely", lambda x: F.size(x) > 0),
            F.flatten(
                F.zip_with(
                    match_starts(t, TOKEN, F.col("__token")),
                    F.col("__likely"),
                    lambda s, found: F.transform(found, lambda x: F.struct((s + x["start"]).alias("start"), F.lit(3).alias("kind"), (s + x["end"]).alias("end"))),
                )
            ),
        ).otherwise(F.array().cast("array<struct<start: bigint, kind: int, end: bigint>>")).alias("__s3"),
    )
    return parts.select(
        *docs.drop("base_spans", "spans").columns,
        F.sort_array(F.concat("__s0", "__s1", "__s2")).alias("base_spans"),
        F.sort_array(F.concat("__s0", "__s1", "__s2", "__s3")).alias("spans"),
    )


def span_report(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of what `scanned_secrets` returns."""
    def of(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", of(0), of(1), of(2), F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(found: DataFrame, mark: str = "[secret]", text: str = "text") -> DataFrame:
    """What `scanned_secrets` returns, with every run of overlapping spans replaced by `mark`, and without the span columns."""
    t, spans, zero = whole(text), F.col("spans"), F.lit(0).cast("long")
    before = scanned(F.transform(spans, lambda s: s["end"]), zero, lambda a, b: F.greatest(a, b))  # the greatest end so far
    kept = F.zip_with(
        spans,
        before,
        lambda s, b: F.when(
            (s["start"] >= b), F.concat(F.substring(t, (b + 1).cast("int"), (s["start"] - b).cast("int")), F.lit(mark))
        ).otherwise(F.lit("")),
    )
    rest = F.substring(t, (F.array_max(F.transform(spans, lambda s: s["end"])) + 1).cast("int"), F.length(t))
    return found.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), rest)).otherwise(F.col(text))).drop("base_spans", "spans")


def without_secrets(docs: DataFrame, model: list[float], mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret in text replaced by `mark`, and n_chars, where there is such a column, as the new text has it."""
    found = scanned_secrets(docs, model)
    if "n_chars" in docs.columns:
        found = found.withColumn("__hit", F.size("spans") > 0)
        new = F.when(F.col("__hit"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return redacted(found, mark).withColumn("n_chars", new).select(*docs.columns)
    return redacted(found, mark).select(*docs.columns)
