"""Column expressions that the native operators share; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays are scanned in blocks of so many, as appending to an array copies it.
BLOCK = 256


def whole(text: str = "text") -> Column:
    """The text as a string; null is empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_keys(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that tell rows of different ids or texts apart and are never null; rows that agree in both have the same."""
    a, b = F.col(doc_id).cast("string"), F.col(text).cast("string")
    absent = [F.col(x).isNull().cast("int") for x in (doc_id, text)]
    return [F.xxhash64(a, b, *absent).alias("k1"), F.xxhash64(F.lit(1), *absent, b, a).alias("k2")]


def scanned(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, `op` over `start` and all elements before it; `op` is associative."""

    def scan(block: Column, first: Column) -> Column:
        return F.aggregate(block, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    last = F.greatest(F.ceil(F.size(values) / BLOCK).cast("int") - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    totals = F.transform(blocks, lambda b: F.aggregate(F.slice(b, 2, BLOCK), F.element_at(b, 1), op))
    firsts = scan(totals, start)
    done = F.flatten(F.zip_with(blocks, F.slice(firsts, 1, last + 1), lambda b, first: F.slice(scan(b, first), 1, F.size(b))))
    return F.when(F.size(values) > 0, done).otherwise(F.array().cast("array<bigint>"))


def add(a: Column, b: Column) -> Column:
    return a + b


def code_points(x: Column) -> Column:
    return F.length(x).cast("long")


def match_starts(text: Column, pattern: str, matches: Column) -> Column:
    """Where each of all leftmost matches of `pattern` starts, in code points; `matches` holds their texts."""
    gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), code_points)
    steps = F.zip_with(gaps, F.transform(matches, code_points), add)
    return F.zip_with(scanned(steps, F.lit(0).cast("long"), add), gaps, add)
