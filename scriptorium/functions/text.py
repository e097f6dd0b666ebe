"""Column builders for words, sentences and numbers; every one is a JVM expression."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions.literals import needed

#: White space, as Unicode has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), for which `value` is computed once: an expression within a lambda is computed again for every use."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rx(pattern: str, cased: bool = False) -> str:
    """A pattern with Unicode classes, and without regard to letter case unless `cased`."""
    return ("(?U)" if cased else "(?iU)") + pattern


def folded(text: Column) -> Column:
    """Lower case, in which stands every ASCII text that a pattern without regard to letter case finds: the four other letters that match are replaced."""
    plain = text
    for a, b in (("ſ", "s"), ("\u212a", "k"), ("ı", "i"), ("İ", "i")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(plain))


def may_have(text: Column, pattern: str, low: Column | None = None) -> Column | None:
    """Whether one of the texts stands in `text` without which a pattern cannot match; none, if there are no such texts.

    low: folded(text), for use in a lambda; elsewhere Spark computes the same expression once.
    """
    out = None
    for x in needed(pattern) or ():
        one = (folded(text) if low is None else low).contains(x)
        out = one if out is None else out | one
    return out


def listed(found: Iterable[tuple[Column, Column]], kind: str = "string") -> Column:
    """array of the values whose condition holds, in order; made without a lambda, so that it is compiled."""
    empty = F.array().cast(f"array<{kind}>")
    return F.concat(empty, *[F.when(c, F.array(v)).otherwise(empty) for c, v in found])


def has(text: Column, pattern: str, cased: bool = False, low: Column | None = None) -> Column:
    """Whether a pattern is found; it is tried only where what it needs is there, as patterns are slow."""
    gate, hit = may_have(text, pattern, low), text.rlike(rx(pattern, cased))
    return hit if gate is None else gate & hit


def found(text: Column, pattern: str, cased: bool = False) -> Column:
    """All matches, in order."""
    return F.regexp_extract_all(text, F.lit(rx(pattern, cased)), 0)


def hits(text: Column, pattern: str, cased: bool = False, low: Column | None = None) -> Column:
    """How often a pattern is found; it is counted only where what it needs is there."""
    gate, n = may_have(text, pattern, low), F.regexp_count(text, F.lit(rx(pattern, cased)))
    return n if gate is None else F.when(~gate, 0).otherwise(n)


def count_true(conditions: Iterable[Column]) -> Column:
    out = F.lit(0)
    for c in conditions:
        out = out + c.cast("int")
    return out


def words(text: Column) -> Column:
    """Lower-cased words that start with a Latin letter, typographic apostrophes made plain."""
    return F.transform(found(text, lx.W2, True), lambda w: F.replace(F.lower(w), F.lit("’"), F.lit("'")))


def n_words(text: Column) -> Column:
    return hits(text, lx.W2, True)


def n_words_wide(text: Column) -> Column:
    """Words of any script, with digits."""
    return hits(text, lx.W1, True)


def tokens(text: Column) -> Column:
    """Plain Latin tokens, in lower case."""
    return found(F.lower(text), lx.W3, True)


def opening(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(found(F.lower(text), lx.W2, True), 1, n), " ")


def strip(text: Column) -> Column:
    """Without white space at either end, as Unicode has it."""
    return F.btrim(text, F.lit(SPACE))


def squeezed(text: Column) -> Column:
    rare = text.rlike(f"  |[{SPACE.replace(' ', '')}]")
    return strip(F.when(rare, F.regexp_replace(text, r"(?U)\s+", " ")).otherwise(text))


def quote(text: Column, limit: int = 115) -> Column:
    clean = squeezed(text)
    short = F.concat(F.regexp_replace(F.substring(clean, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.length(clean) <= limit, clean).otherwise(short)


def sentences(text: Column) -> Column:
    """Stripped sentences that are not blank."""
    return F.filter(F.transform(F.split(text, "(?U)" + lx.SENTENCE_BREAK), strip), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.split(text, rf"\r\n|[{lx.LINE_BREAK}]")


def mean(values: Column) -> Column:
    """Mean of an array of numbers; null if it is empty."""

    def of(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))

    return bound(values, of)


def _deviation(v: Column, m: Column) -> Column:
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
    return F.when(F.size(v) >= 2, F.sqrt(square / F.size(v))).otherwise(0.0)


def deviation(values: Column) -> Column:
    """Population standard deviation of an array; 0 for fewer than two."""
    return bound(values, lambda v: bound(mean(v), lambda m: _deviation(v, m)))


def variation(values: Column) -> Column:
    """Coefficient of variation of an array; 0 for fewer than two or a mean of 0."""

    def of(v: Column, m: Column) -> Column:
        return F.when((F.size(v) >= 2) & (m != 0), _deviation(v, m) / m).otherwise(0.0)

    return bound(values, lambda v: bound(mean(v), lambda m: of(v, m)))


def percent(value: Column) -> Column:
    """Rounded half to even, held to 0..100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(value.cast("double"), 0).cast("int")))


def percentile(values: Column, q: float) -> Column:
    """Linear interpolation over the sorted array, rounded half to even; 0 if it is empty."""

    def of(s: Column) -> Column:
        at = F.lit(q) * (F.size(s) - 1)
        low = F.floor(at).cast("int")
        part = at - low
        a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(s) - 1))
        return F.when(F.size(s) > 0, F.bround(a * (1 - part) + b * part, 0).cast("int")).otherwise(0)

    return bound(F.sort_array(values), of)


def type_token_ratio(text: Column, window: int = 50) -> Column:
    """Mean share of distinct tokens over windows of 50 tokens, 25 apart; over all of a shorter text, 0 of an empty one."""
    step = max(10, window // 2)

    def share(part: Column) -> Column:
        return bound(part, lambda x: F.size(F.array_distinct(x)) / F.size(x))

    def of(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - window + 1, F.lit(1)), F.lit(step))
        return (
            F.when(F.size(t) == 0, 0.0)
            .when(F.size(t) <= window, share(t))
            .otherwise(mean(F.transform(starts, lambda i: share(F.slice(t, i, window)))))
        )

    return bound(tokens(text), of)


def three_parts(sentence: Column) -> Column:
    """Whether a sentence has just three parts between commas, of like length and like openings."""

    def of(parts: Column) -> Column:
        starts = F.size(F.array_distinct(F.transform(parts, lambda p: F.coalesce(F.get(p, 0), F.lit("")))))
        return bound(F.transform(parts, F.size), lambda n: bound(F.array_max(n) - F.array_min(n), lambda spread: (
            (F.array_min(n) >= 3) & (spread <= 4) & ((spread <= 2) | (starts <= 2))
        )))

    three = F.length(sentence) - F.length(F.replace(sentence, F.lit(","), F.lit(""))) == 2
    return three & bound(F.transform(F.split(sentence, ","), words), of)


def severity(weak: Column, moderate: Column, strong: Column) -> Column:
    """0 to 3 from the numbers of pieces of evidence."""
    return (
        F.when((strong >= 1) | (moderate >= 2) | (weak >= 4), 3).when((moderate >= 1) | (weak >= 2), 2).when(weak >= 1, 1).otherwise(0)
    )


def band(risk: Column) -> Column:
    return F.when(risk >= 70, "high").when(risk >= 45, "moderate").when(risk >= 25, "low").otherwise("natural")


def level(percentage: Column) -> Column:
    out = F.when(percentage < 20, "Minimal").when(percentage < 40, "Low").when(percentage < 60, "Moderate").when(percentage < 80, "Elevated")
    return F.concat(out.otherwise("Strong"), F.lit(" AI-style signal"))


def verdict(score: Column) -> Column:
    return (
        F.when(score <= 4, "Human").when(score <= 8, "Likely Human").when(score <= 13, "Uncertain").when(score <= 19, "Likely AI").otherwise("AI")
    )


def digest(text: Column) -> Column:
    """SHA-256 of the text with line feeds only, and without white space at its ends."""
    return F.sha2(strip(F.regexp_replace(text, "\r\n?", "\n")), 256)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
