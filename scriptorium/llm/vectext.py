"""Hashes of words and character n-grams of many texts at once, with numpy.

A polynomial prefix hash modulo 2^64 gives the hash of any span as a difference
times a power of the inverse of the base, so spans need no loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: A fixed odd multiplier of 64 bits, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def powers(x: int) -> np.ndarray:
        out = np.full(n, np.uint64(x))
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(BASE), powers(INVERSE)


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point, whether it is a letter, a digit or an underscore."""
    return np.array([chr(c).isalnum() or c == 95 for c in range(0x110000)])


@lru_cache(maxsize=1)
def white_space() -> np.ndarray:
    return np.array([chr(c).isspace() for c in range(0x110000)])


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high and low bits all depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Texts laid end to end with a space before, between and after them."""

    def __init__(self, texts: list[str]):
        joined = " " + " ".join(texts) + " "
        self.codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate([[1], 1 + np.cumsum(lengths + 1)])[:-1]
        self.ends = self.starts + lengths
        n = 1 << (len(self.codes) + 1).bit_length()
        forward, self.back = _powers(n)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * forward[: len(self.codes)])])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters in [a, b) of each span; does not depend on where it stands."""
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of characters for which `inside`, a table by code point, holds."""
        flags = np.diff(inside[self.codes].astype(np.int8), prepend=0, append=0)
        return np.flatnonzero(flags == 1), np.flatnonzero(flags == -1)


def portions(texts: Iterator[str], most: int = 400_000) -> Iterator[list[str]]:
    """Lists of texts of about `most` characters in all; a longer text stands alone."""
    held, n = [], 0
    for t in texts:
        if held and n + len(t) > most:
            yield held
            held, n = [], 0
        held.append(t)
        n += len(t)
    if held:
        yield held
