"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-two-fit: a sequence is filled greedily, longest piece first; then its
smallest piece is replaced by two unpacked pieces that fit the gap it leaves
more tightly.  Only lengths matter for that, and there are at most `size` of
them, so the packing is made on the histogram of lengths: a pattern of lengths
is repeated for as long as all its lengths last.  The work on the driver is
bounded by the size of a sequence, whatever the number of documents; the pieces
find their places by their rank among the pieces of the same length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.byte_bpe import loaded
from scriptorium.llm.common import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Every document's ids and an end id, cut into pieces of `size` from the back if longer; null text is empty.

    The first piece of a longer document is the one that may be shorter.  part and nth
    number the pieces of one length within the task that made them.  Repeated rows
    and null ids are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(vocabulary)
        seen: Counter[int] = Counter()
        part = TaskContext.get().partitionId()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows: list[tuple] = []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                n, at, k = len(ids), 0, 0
                while at < n:
                    length = (n - at) % size or size
                    crc = zlib.crc32(ids[at : at + length])
                    rows.append((key.as_py(), k, at, length, crc, part, seen[length]))
                    seen[length] += 1
                    at, k = at + length, k + 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class _Lengths:
    """How many pieces of each length are left, and the greatest length at most x that is left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: v for k, v in counts.items() if v > 0}
        self.sorted = sorted(self.left)

    def at_most(self, x: int, used: Counter) -> int | None:
        i = bisect_right(self.sorted, x) - 1
        while i >= 0 and self.left[self.sorted[i]] <= used[self.sorted[i]]:
            i -= 1
        return self.sorted[i] if i >= 0 else None

    def take(self, pattern: Counter) -> int:
        times = min(self.left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            self.left[k] -= n * times
            if not self.left[k]:
                del self.left[k]
                self.sorted.remove(k)
        return times


def two_fit(gap: int, lengths: _Lengths, used: Counter) -> tuple[int, int] | None:
    """The two unpacked lengths with the greatest sum of at most `gap`."""
    best, found = 0, None
    for i in range(bisect_right(lengths.sorted, gap) - 1, -1, -1):
        a = lengths.sorted[i]
        if 2 * a <= best:
            break
        if lengths.left[a] <= used[a]:
            continue
        used[a] += 1
        b = lengths.at_most(min(a, gap - a), used)
        used[a] -= 1
        if b is not None and a + b > best:
            best, found = a + b, (a, b)
            if best == gap:
                break
    return found


def patterns(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """[({length: how often in a sequence}, number of such sequences)]: uses up all counts; deterministic."""
    lengths, found = _Lengths(counts), []
    while lengths.sorted:
        used: Counter[int] = Counter()
        gap = size
        while (x := lengths.at_most(gap, used)) is not None:
            # as many of it at once as the gap and the stock allow; the greedy choice stays the same meanwhile
            n = min(gap // x, lengths.left[x] - used[x])
            used[x] += n
            gap -= n * x
        if gap and sum(used.values()) > 1:
            smallest = min(used)
            used[smallest] -= 1
            pair = two_fit(gap + smallest, lengths, used)
            if pair and sum(pair) > smallest:
                used[pair[0]] += 1
                used[pair[1]] += 1
            else:
                used[smallest] += 1
        pattern = Counter({k: n for k, n in used.items() if n})
        found.append((dict(pattern), lengths.take(pattern)))
    return found


def slots(found: list[tuple[dict[int, int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, pieces of it in each, offset of the first)] by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: Counter[int] = Counter()
    sequence = 0
    for pattern, times in found:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((ranks[length], sequence, n, offset))
            ranks[length] += n * times
            offset += n * length
        sequence += times
    return out


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """`pieces` with sequence_id and offset; sequences are gapless from offset 0 and hold at most `size` tokens.

    The pieces are written to the shared folder once, so that part and nth stay what
    they are if executors are lost.  An empty table gives no rows.
    """
    cut = written(cut, "pieces")
    per_part = written(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    places = slots(patterns(counts, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    names = [x for x in cut.columns if x not in ("part", "nth")]
    ranked = cut.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).select(*names, "rank")
    schema = "{}, sequence_id long, offset long".format(", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in places.items()}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                at = length == value
                first, base, n, start = by_length[int(value)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                k = rank[at] - first[i]
                sequence[at], offset[at] = base[i] + k // n[i], start[i] + k % n[i] * value
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def packed(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Best-fit packing of the whole table: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, vocabulary, size, end_id), size)
