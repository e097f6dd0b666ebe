"""Functions for SQL: the local editor, and a table function that cuts a text into sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import lexicon as lx
from scriptorium.operators import edits

LINE = re.compile(rf"[^{lx.LINE_BREAK}]*(?:\r\n|[{lx.LINE_BREAK}]|\Z)")


def segments(text: str | None) -> Iterator[tuple[int, int, int, int, str]]:
    """(paragraph_index, sentence_index, start, end, text) as `operators.segments.sentences` cuts; nothing of null and blank texts."""
    paragraph = -1
    for line in LINE.finditer(text or ""):
        body = line[0].strip()
        if not body:
            continue
        paragraph += 1
        start, at = line.start() + line[0].index(body), 0
        pieces = [(m.start(), m.end()) for m in edits.BREAK.finditer(body)]
        for i, (end, following) in enumerate([*pieces, (len(body), len(body))]):
            yield paragraph, i, start + at, start + end, body[at:end]
            at = following


class _Segments:
    def eval(self, text: str):
        yield from segments(text)


def register(spark: SparkSession) -> None:
    """rewrite_local(text, mode): the local edit, which has not passed the gate (null stays null); segments(text): a table of sentences."""

    @F.pandas_udf("string")
    def rewrite_local(text: pd.Series, mode: pd.Series) -> pd.Series:
        def one(t: str | None, level: str | None) -> str | None:
            seen: Counter = Counter()
            return None if t is None else edits.by_line(t, lambda p: edits.refined(p, seen, level or "balanced", []))

        return pd.Series([one(t, m) for t, m in zip(text, mode, strict=True)], dtype=object)

    spark.udf.register("rewrite_local", rewrite_local)
    spark.udtf.register("segments", F.udtf(_Segments, returnType="paragraph_index int, sentence_index int, start int, `end` int, text string"))
