"""What a rewrite must leave alone: the signature of protected evidence, the gate and the certificate, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.functions import text as tx


def signature(text: Column) -> Column:
    """struct of ordered lists, one for each kind of evidence, and the counts of claim qualifiers."""
    lists = []
    for name, (pattern, cased) in lx.EVIDENCE.items():
        got = tx.found(text, pattern, cased)
        lists.append((F.transform(got, tx.strip) if name in ("headings", "reference_headings") else got).alias(name))
    counts = F.struct(*[tx.hits(text, p).alias(k) for k, p in lx.QUALIFIERS.items()])
    return F.struct(*lists, counts.alias("claim_qualifiers"))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text, without overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")


def word_change(original: Column, candidate: Column) -> Column:
    before = F.greatest(F.lit(1), tx.n_words_wide(original))
    return F.abs(tx.n_words_wide(candidate) - before) / before


def broken(original: Column, candidate: Column, limit: Column | float = 0.06, terms: Column | None = None) -> Column:
    """array: what the candidate changed that it must not; empty if it may stand.  terms: array of protected terms."""
    a, b = signature(original), signature(candidate)
    limit = F.lit(limit) if isinstance(limit, float) else limit
    changed = [F.when(a[k] != b[k], F.lit(f"{k} changed")) for k in [*lx.EVIDENCE, "claim_qualifiers"]]
    out = F.array_compact(F.array(*changed, F.when(word_change(original, candidate) > limit, F.lit("word count changed"))))
    if terms is None:
        return out
    lost = F.filter(F.filter(terms, lambda t: t != ""), lambda t: occurrences(original, t) != occurrences(candidate, t))
    return F.concat(out, F.transform(F.array_distinct(lost), lambda t: F.concat(F.lit("protected term changed: "), t)))


def reference_tail(text: Column) -> Column:
    """The text from its first reference heading on, stripped; empty if it has none."""
    lines = tx.lines(text)
    at = F.array_position(F.transform(lines, lambda x: tx.has(tx.strip(x), lx.REFERENCE_HEADING)), True)
    return F.when(at > 0, tx.strip(F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n"))).otherwise("")


def certificate(original: Column, candidate: Column, terms: Column | None = None) -> Column:
    """struct: twelve checks, whether all passed, and the ratio of changed words.  It audits evidence, not meaning."""
    a, b = signature(original), signature(candidate)

    def same(*keys: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & (a[k] == b[k])
        return out

    kept = F.lit(True)
    if terms is not None:
        kept = F.forall(F.filter(terms, lambda t: t != ""), lambda t: occurrences(original, t) == occurrences(candidate, t))
    checks = {
        "numbers": same("numbers"), "citations": same("citation_blocks"), "urls": same("urls"), "emails": same("emails"), "headings": same("headings"),
        "tables": same("table_lines", "tabular_lines"), "equations": same("display_equations", "equationish"),
        "references": reference_tail(original) == reference_tail(candidate), "placeholders": same("placeholders"), "acronyms": same("acronyms"),
        "claim_qualifiers": same("claim_qualifiers"), "user_terms": kept,
    }
    passed = F.lit(True)
    for check in checks.values():
        passed = passed & check
    return F.struct(
        passed.alias("passed"), *[v.alias(k) for k, v in checks.items()], F.round(word_change(original, candidate), 4).alias("changed_word_ratio")
    )


def protected_terms(terms: Column, most: int = 40, longest: int = 120) -> Column:
    """Terms without blanks and repeats, in order; too many or too long ones are an error."""
    clean = F.array_distinct(F.filter(F.transform(terms, tx.strip), lambda t: t != ""))
    bad = (F.size(clean) > most) | F.exists(clean, lambda t: F.length(t) > longest)
    return F.when(bad, F.raise_error(F.lit("too many or too long protected terms")).cast("array<string>")).otherwise(clean)
