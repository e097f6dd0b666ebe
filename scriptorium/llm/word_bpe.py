"""Exact BPE by dynamic programming over prefixes.

For every prefix of a word exactly one token can be its last one: a token that
ends there and whose join with the last token of the prefix before it survives
BPE.  A suffix automaton over the vocabulary lists the tokens that end at a
position, a compatibility test of two tokens replays the merges around their
boundary, and the last tokens, followed backwards, are the word's ids.  The work
is linear in the word times the number of tokens that end at a position;
nothing is merged greedily.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm.byte_bpe import byte_chars

#: What the vocabulary's pre-tokeniser keeps of a text (a fixed value of its format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Texts with other characters than those below U+0300 and common punctuation are normalised by the library.
UNCOMMON = re.compile("[\u0300-\u200f\u2028-\U0010ffff]")

#: Stands for the end of a word in our copy of the vocabulary; byte-level text has no such character.
END = "\0"


class SuffixAutomaton:
    """The smallest automaton of all substrings of some tokens; it finds every token that ends at a place of a word.

    A state stands for substrings that end at the same places of the tokens, up to `longest` characters;
    `link` leads to the next shorter ones.  Tokens are held by the states that they belong to, the longest first.
    """

    def __init__(self, tokens: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.longest = [-1], [0]
        tokens = list(tokens)
        for token in tokens:
            last = 0
            for c in token:
                last = self._extended(last, c)
        held: dict[int, list[str]] = {}
        for token in tokens:
            state = 0
            for c in token:
                state = self.next[state][c]
            held.setdefault(state, []).append(token)
        self.held = {state: sorted(found, key=len, reverse=True) for state, found in held.items()}
        #: The nearest state on the way of links, from a state on, that holds tokens.
        self.up = [-1] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.longest.__getitem__):
            self.up[state] = state if state in held else self.up[self.link[state]]
        self.tokens = {state: [(len(t), t, {}) for t in found] for state, found in self.held.items()}  # the last: token before -> do they join

    def _new(self, longest: int, steps: dict[str, int], link: int) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _extended(self, last: int, c: str) -> int:
        """The state of the text of `last` and c; states are added and split as needed."""
        known = self.next[last].get(c)
        if known is not None and self.longest[known] == self.longest[last] + 1:
            return known
        new = -1 if known is not None else self._new(self.longest[last] + 1, {}, 0)
        at = last
        while new >= 0 and at >= 0 and c not in self.next[at]:
            self.next[at][c] = new
            at = self.link[at]
        if at < 0:
            return new
        to = self.next[at][c]
        if self.longest[to] != self.longest[at] + 1:
            twin = self._new(self.longest[at] + 1, dict(self.next[to]), self.link[to])
            self.link[to] = twin
            while at >= 0 and self.next[at].get(c) == to:
                self.next[at][c] = twin
                at = self.link[at]
            to = twin
        if new < 0:
            return to
        self.link[new] = to
        return new

    def ends(self, word: str) -> Iterator[tuple[int, list[tuple[int, str, dict[str, bool]]]]]:
        """(place after a character, tokens of one state that end there); several states a place, the longest tokens first."""
        state, n = 0, 0
        for end, c in enumerate(word, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.longest[state]
            state = self.next[state].get(c, 0)
            n = n + 1 if state else 0
            at = self.up[state] if state else -1
            while at > 0:
                found = self.tokens[at]
                yield end, found if found[0][0] <= n else [t for t in found if t[0] <= n]
                at = self.up[self.link[at]] if self.link[at] > 0 else -1


class PrefixBpe:
    """ids of words under merges whose tokens may carry a word-end suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        def own(token: str) -> str:
            return token[: -len(suffix)] + END if suffix and token.endswith(suffix) and len(token) > len(suffix) else token

        self.suffix = bool(suffix)
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, tuple[int, str, str]] = {}  # token -> (rank of its merge, left, right)
        for i, (a, b) in enumerate(merges):
            pair = own(a), own(b)
            self.rank.setdefault(pair, i)
            self.made.setdefault(pair[0] + pair[1], (i, *pair))
        self.id = {own(t): i for t, i in vocab.items()}
        self.tested = 0
        reachable = (t for t in self.id if len(t) - t.endswith(END) == 1 or t in self.made and self.joins(*self.made[t][1:], whole=True))
        self.automaton = SuffixAutomaton(reachable)

    def joins(self, a: str, b: str, whole: bool = False) -> bool:
        """Whether BPE of a + b ends as [a, b]; with `whole`, whether no merge crosses the boundary until a and b are made.

        Undoes the merges next to the boundary, latest first; a merge across the boundary
        that comes before the one undone last would have been made in its place.
        """
        limit = len(self.rank)
        while True:
            crossing = -1 if whole else self.rank.get((a, b), limit)
            whole = False
            if 0 <= crossing < limit:
                return False
            left, right = self.made.get(a), self.made.get(b)
            if left and (not right or left[0] > right[0]):
                limit, a = left[0], left[2]  # of equal pairs, the left one is merged first
            elif right:
                limit, b = right[0] + 1, right[1]
            else:
                return True

    def encode(self, word: str) -> list[str]:
        """The tokens of one byte-level word."""
        if self.suffix:
            word += END
        if self.tested > 300_000:
            self.tested = 0
            for found in self.automaton.tokens.values():
                for _, _, fits in found:
                    fits.clear()
        last = [""] * (len(word) + 1)
        for end, found in self.automaton.ends(word):
            if last[end]:
                continue
            for length, token, fits in found:
                if length == end:
                    last[end] = token
                    break
                if before := last[end - length]:
                    ok = fits.get(before)
                    if ok is None:
                        ok = fits[before] = self.joins(before, token)
                        self.tested += 1
                    if ok:
                        last[end] = token
                        break
        at, out = len(word), []
        while at:
            token = last[at]
            if not token:
                raise ValueError(f"no encoding of {word!r}")
            out.append(token)
            at -= len(token)
        return out[::-1]


class Recent(dict):
    """A dictionary that makes missing values itself and keeps the `limit` to 2 * `limit` keys asked for last."""

    def __init__(self, make: Callable[[str], str], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> str:
        found = self.old.get(key) or self.make(key)
        if len(key) < 100:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found


class WordBpe:
    """Decimal ids of whole texts, and the text that ids stand for; words seen lately are looked up."""

    def __init__(self, path: str, limit: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.added = {t["content"]: str(t["id"]) for t in spec["added_tokens"]}
        self.split = regex.compile("|".join(f"({regex.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.bpe = PrefixBpe({t: i for t, i in model["vocab"].items() if t not in self.added}, merges, model["end_of_word_suffix"] or "")
        self.shown = {t: f" {i}" for t, i in self.bpe.id.items()}
        self.token = {str(i): t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.byte = {b: c for c, b in byte_chars().items()}
        self.words = regex.compile(WORDS)
        self.known = Recent(self._word, limit)

    def _word(self, word: str) -> str:
        """The ids of a word, with a space before each."""
        byte_level = word if word.isascii() and word.isprintable() else "".join(map(self.byte.__getitem__, word.encode()))
        return "".join(map(self.shown.__getitem__, self.bpe.encode(byte_level)))

    def _plain(self, text: str) -> list[str]:
        # There nothing is composed and every letter's lower case is its own; elsewhere the library normalises.
        text = self.normalizer.normalize_str(text) if UNCOMMON.search(text) else text.lower()
        return list(map(self.known.__getitem__, self.words.findall(text)))

    def encode(self, text: str) -> list[str]:
        """The ids of a text, as decimals."""
        if "<" in text and self.split.search(text):
            found: list[str] = []
            for piece in filter(None, self.split.split(text)):
                found += [f" {self.added[piece]}"] if piece in self.added else self._plain(piece)
        else:
            found = self._plain(text)
        return "".join(found).split()

    def decode(self, ids: Iterable[str]) -> str:
        """Tokens joined by a space, as the vocabulary, which has no decoder, asks for; ids that it lacks are left out."""
        return " ".join(filter(None, map(self.token.get, ids)))


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded: exact ids of each whole text and what they decode to; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = loaded(vocabulary)
        for batch in batches:
            found = [code.encode(x.as_py() or "") for x in batch.column(1)]
            ids = pa.array([list(map(int, x)) for x in found], pa.list_(pa.int32()))
            decoded = pa.array(map(code.decode, found), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, ids array<int>, decoded string"
    )


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, decoded, of ids(doc_id, ids array<int>); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = loaded(vocabulary)
        for batch in batches:
            texts = pa.array([code.decode(map(str, x.as_py() or [])) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, decoded string")


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, made where the text is encoded; the second text is decoded from the ids; null text is empty."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = loaded(vocabulary)
        for batch in batches:
            rows = [(len(ids), sha(" ".join(ids)), sha(code.decode(ids))) for ids in (code.encode(x.as_py() or "") for x in batch.column(1))]
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
