"""Sections and batches of long documents for an external editor."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.operators import edits

_HEADING = re.compile(lx.HEADING_LINE.replace("|Bibliography))", r"|Bibliography|Appendix(?:es)?(?:\s+.+)?))"), re.I)
_TAIL = re.compile(lx.REFERENCE_HEADING, re.I)


def sections(text: str) -> list[tuple[str, str, bool]]:
    """(heading, text, protected) of a text, a section from each heading on."""
    out: list[tuple[str, list[str]]] = [("", [])]
    for line in text.splitlines(keepends=True):
        if line.strip() and _HEADING.match(line.strip()):
            out.append((line.strip(), []))
        out[-1][1].append(line)
    joined = [(h, "".join(lines).strip()) for h, lines in out]
    return [(h, t, bool(_TAIL.match(h))) for h, t in joined if t]


def units(text: str, most: int) -> list[str]:
    """Parts of at most `most` words: paragraphs, failing that lines, failing that runs of sentences; a longer sentence stays whole."""
    if edits.n_words(text) <= most:
        return [text]
    parts = [p for p in map(str.strip, re.split(r"\n\s*\n", text)) if p]
    if len(parts) < 2:
        parts = [x.rstrip() for x in text.splitlines() if x.strip()]
    out = []
    for part in parts:
        if edits.n_words(part) <= most:
            out.append(part)
            continue
        held, n = [], 0
        for s in edits.sentences(part):
            w = edits.n_words(s)
            if held and n + w > most:
                out.append(" ".join(held))
                held, n = [], 0
            held.append(s)
            n += w
        out.append(" ".join(held))
    return out


def packed(text: str, most: int = 4200) -> list[tuple[str, bool, int, str]]:
    """(text, protected, words, headings): neighbouring units together up to `most` words (2500 to 5000); protected sections alone."""
    most = max(2500, min(5000, most))
    out, held, heads, n = [], [], [], 0

    def flush() -> None:
        nonlocal held, heads, n
        if held:
            t = "\n\n".join(held).strip()
            out.append((t, all(edits.protected(x) for x in t.splitlines()), edits.n_words(t), " | ".join(dict.fromkeys(filter(None, heads)))))
            held, heads, n = [], [], 0

    for heading, body, locked in sections(text):
        if locked:
            flush()
            out.append((body, True, edits.n_words(body), heading))
            continue
        for unit in units(body, most):
            w = edits.n_words(unit)
            if held and n + w > most:
                flush()
            held.append(unit)
            heads.append(heading)
            n += w
    flush()
    return out


def batches(docs: DataFrame, most: int = 4200, context: int = 1800) -> DataFrame:
    """doc_id, batch, text, protected, n_words, heading, context_before, context_after (of editable neighbours).

    Made row by row, so repeated and null ids are documents of their own; null texts have no batches.
    """
    schema = "doc_id long, batch int, text string, protected boolean, n_words int, heading string, context_before string, context_after string"

    def of(doc_id: int | None, text: str) -> list[tuple]:
        made = packed(text, most)
        editable = [i for i, b in enumerate(made) if not b[1]]
        near = {i: (editable[k - 1] if k else None, editable[k + 1] if k + 1 < len(editable) else None) for k, i in enumerate(editable)}
        rows = []
        for i, b in enumerate(made):
            before, after = near.get(i, (None, None))
            rows.append((doc_id, i, *b, None if before is None else made[before][0][-context:].strip(" "), None if after is None else made[after][0][:context].strip(" ")))
        return rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.string()]
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in it:
            rows = [r for d, t in zip(batch.column(0), batch.column(1), strict=True) for r in of(d.as_py(), t.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def marked(paragraphs: DataFrame) -> DataFrame:
    """doc_id, prompt: paragraphs(doc_id, index, text) between numbered markers, in order."""
    one = F.concat(F.lit("<<<P:"), F.col("index"), F.lit(">>>\n"), F.col("text"), F.lit("\n<<<ENDP:"), F.col("index"), F.lit(">>>"))
    each = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("index", one.alias("m")))).alias("x"))
    return each.select("doc_id", F.array_join(F.transform("x", lambda x: x["m"]), "\n").alias("prompt"))


def unmarked(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, index, text of answers(doc_id, prompt) whose markers are just the expected(doc_id, index) ones, in order; others have no rows."""
    rx = r"(?s)<<<P:(\d+)>>>\s*(.*?)\s*<<<ENDP:\1>>>"
    ids, texts = (F.regexp_extract_all("prompt", F.lit(rx), i) for i in (1, 2))
    want = expected.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.col("index").cast("int"))).alias("want"))
    found = answers.select("doc_id", F.transform(ids, lambda i: i.cast("int")).alias("ids"), texts.alias("texts")).join(want, "doc_id")
    return found.where(F.col("ids") == F.col("want")).select("doc_id", F.inline(F.arrays_zip("ids", "texts"))).toDF("doc_id", "index", "text")
