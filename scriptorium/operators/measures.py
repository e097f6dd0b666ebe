"""The measures of `functions.scan` as columns: one Python call reads a text for all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from scriptorium.functions import evidence, scan

STYLE = (
    "word_count int, paragraph_count int, sentence_count int, n_lengths int, n_blocks int, msttr double, s_cv double, p_cv double, s_sd double, p_sd double, "
    "short int, long int, generic_phrase_hits int, repeated_sentence_openings int, repeated_paragraph_openings int, generic_connector_hits int, "
    "long_sentence_count int, overloaded_sentence_count int, very_short_sentence_count int, repeated_frame_density int, frames array<int>"
)
FAMILIES = (
    "n int, words int, n_paragraphs int, sentence_cv double, paragraph_cv double, n_vocabulary int, n_different int, adjectives int, tight int, hedges int, "
    "bullets int, bullet_words int, conclusion boolean, tricolons int, diminished int, obscured int, universal int, strong int, moderate int, dashes int, "
    "paired boolean, semicolons int, colons int, informal boolean, complete int, rhetoric int, anaphora boolean, questions int, technical int, "
    "corrected boolean, dated boolean"
)
PARAGRAPHS = "segment_count long, segment_mean int, segment_p75 int, segment_p90 int, flagged_segments long"
DISTRIBUTION = (
    "top_share double, common_share double, n_words int, repeated_units long, sn int, pn int, density_s_cv double, density_p_cv double, syntax_share double, "
    "transitions int"
)
#: What the fingerprint takes besides style and distribution; latest: the last of the years that are named.
MARKS = "typos int, vague int, latest int, percentages int, p_values int, coefficients int, certain int, unsupported int"
_KINDS = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "string": StringType(), "array<int>": ArrayType(IntegerType())}


def _struct(fields: str, **more: DataType) -> StructType:
    out = StructType([StructField(name, _KINDS[kind]) for name, kind in map(str.split, filter(None, fields.split(", ")))])
    for name, kind in more.items():
        out.add(name, kind)
    return out


_PARTS = (
    "total_words long, assessed_words long, assessed_sentences long, assessed_paragraphs long",
    {"sections": ArrayType(_struct("section string, n int, total int")), "flagged_at": ArrayType(_struct("start int, end int"))},
    {"own_style": _struct(STYLE)},
    {"style": _struct(STYLE), "families": _struct(FAMILIES), "paragraphs": _struct(PARAGRAPHS), "distribution": _struct(DISTRIBUTION)},
)


def _measured(measure: Callable[[list[str]], Iterable], made: DataType) -> Callable:
    """A UDF of a text: its measures; null of a null text."""

    @F.arrow_udf(made)
    def run(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        found = iter(measure([t for t in texts if t is not None]))
        return pa.array([None if t is None else next(found) for t in texts], type=to_arrow_type(made))

    return run


style, families = _measured(partial(map, scan.style), _struct(STYLE)), _measured(partial(map, scan.families), _struct(FAMILIES))

#: A UDF of a text: an array of one struct of what its fingerprint is made of, empty for a text without prose.
fingerprint = _measured(scan.fingerprints, ArrayType(_struct(f"{DISTRIBUTION}, {MARKS}", style=_struct(STYLE))))


@cache
def document(naturalness: bool = True, context: bool = True) -> Callable:
    """A UDF of a text: all measures of a document, but for the style of the whole text, or for sections and flagged ranges."""
    coverage, places, own, prose = _PARTS
    made = _struct(coverage, **places if context else {}, **own if naturalness else {}, **prose)
    return _measured(partial(scan.documents, naturalness=naturalness, context=context), made)


#: An edited text with what it breaks and its style.
CANDIDATES = ArrayType(_struct("level string, candidate string", issues=ArrayType(StringType()), style=_struct(STYLE)))
CHECKS = (
    "numbers", "citations", "urls", "emails", "headings", "tables", "equations", "references", "placeholders", "acronyms", "claim_qualifiers", "user_terms",
)
_CERTIFICATE = _struct(", ".join(f"{k} boolean" for k in ("passed", *CHECKS)) + ", changed_words double")


def edited(edit: Callable[..., list[tuple[str, str]]]) -> Callable:
    """A UDF of (text, terms, change limit, ...): struct of the style of the text, and of the candidates (level, text) that `edit` makes of it."""
    made = _struct("", style=_struct(STYLE), candidates=CANDIDATES)

    def one(text: str, terms: list[str] | None, limit: float, *more: list) -> dict:
        known = scan.Text(text)
        source, terms = evidence.Evidence(text), terms or []
        style = known.style(source.text, source.low)
        judged: dict[str, dict] = {text: {"issues": evidence.broken(source, source, limit, terms), "style": style}}
        out = []
        for level, candidate in edit(text, terms, *[x or [] for x in more]):
            if candidate not in judged:
                new = evidence.Evidence(candidate)
                issues = evidence.broken(source, new, limit, terms)
                judged[candidate] = {"issues": issues, "style": None if issues else known.style(new.text, new.low)}
            out.append({"level": level, "candidate": candidate} | judged[candidate])
        return {"style": style, "candidates": out}

    @F.arrow_udf(made)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], type=to_arrow_type(made))

    return run


@F.arrow_udf(_CERTIFICATE)
def _certificate(original: pa.Array, candidate: pa.Array, terms: pa.Array) -> pa.Array:
    rows = zip(original.to_pylist(), candidate.to_pylist(), terms.to_pylist(), strict=True)
    return pa.array([evidence.certificate(a, b, t) for a, b, t in rows], type=to_arrow_type(_CERTIFICATE))


def certificate(original: Column, candidate: Column, terms: Column | None = None) -> Column:
    """`preservation.certificate` by one reading of both texts; none of them null."""
    made = _certificate(original, candidate, F.array().cast("array<string>") if terms is None else terms)
    return F.struct(made["passed"].alias("passed"), *[made[k].alias(k) for k in CHECKS], F.round(made["changed_words"], 4).alias("changed_word_ratio"))
