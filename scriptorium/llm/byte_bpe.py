"""Byte-level BPE ids of whole texts, with the vocabulary file of the tokenizers library.

Letters, digits and white space below U+0250 and common punctuation mean the same
to the two libraries at hand, and there the quicker one gives the same ids; any
other text, and one with added tokens or very long runs, goes to the other.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import tiktoken
from tokenizers import Tokenizer

#: The pattern of byte-level pre-tokenisation (a fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


#: What sends a text to the exact library: characters beyond those named above, runs of 500 without a space, or of 500 spaces.
UNCOMMON = re.compile("[\u0250-\u200f\u2028-\U0010ffff]|[^ ]{500}| {500}")


class ByteBpe:
    """ids of a text; added tokens in it are found, none are added."""

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte, self.added = byte_chars(), tuple(t["content"] for t in spec["added_tokens"])
        ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        self.quick = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if UNCOMMON.search(text) or any(t in text for t in self.added):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


@lru_cache(maxsize=4)
def loaded(path: str) -> ByteBpe:
    """One per Python worker."""
    return ByteBpe(path)
