"""Edits of one paragraph, as plain functions of strings; `rewrite` runs them over documents.

Evidence (numbers, citations, names, terms to keep, ...) is taken out of the paragraph
first and put back last, so no edit can touch it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

from scriptorium.functions import lexicon as lx
from scriptorium.functions import phrases as ph
from scriptorium.functions.literals import needed
from scriptorium.functions.scan import folded

I = re.IGNORECASE
BREAK = re.compile(lx.SENTENCE_BREAK)
#: The same white space, behind the sign before it: found more quickly.
_BREAK = re.compile(r"[.!?](\s+)" + lx.SENTENCE_BREAK.split(r"\s+", 1)[1])
PRIVATE = 0xE000
#: Private characters of a supplementary plane.
PLANE = 0xFFFE


def n_words(text: str) -> int:
    return len(re.findall(lx.W1, text))


@lru_cache(64)  # the edits of a paragraph ask one after the other
def sentences(paragraph: str) -> tuple[str, ...]:
    out, at = [], 0
    for m in _BREAK.finditer(paragraph):
        out.append(paragraph[at : m.start(1)])
        at = m.end()
    return tuple(s for s in map(str.strip, [*out, paragraph[at:]]) if s)


def _plain(pattern: str) -> str:
    return re.sub(r"^\(\?[a-z]+\)", "", pattern)


EVIDENCE = [
    (re.compile(p, f), needed(p))
    for p, f in (
        (lx.EMAIL, I), (lx.EVIDENCE["urls"][0], I), (lx.EVIDENCE["placeholders"][0], 0), (lx.EQUATION, I), (ph.PARENTHETICAL_EVIDENCE, 0),
        (ph.PROPER_NAMES, 0), (lx.EVIDENCE["acronyms"][0], 0), (lx.EVIDENCE["numbers"][0], 0),
    )
]
#: With the texts one of which a pattern needs.
REPLACED = [(re.compile(p, I), r, needed(p)) for p, r in ph.REPLACEMENTS]
ARTEFACTS = [(re.compile(p, I), needed(p)) for p in ph.ARTEFACTS]
CONNECTOR = re.compile(ph.CONNECTORS, I)
DIRECT, _DIRECT_NEEDS = re.compile(lx.DIRECT_VERB, I), needed(lx.DIRECT_VERB)


def _may(low: str, needs: tuple[str, ...] | None) -> bool:
    """Whether one of the texts that a pattern needs stands in a folded text."""
    if needs is None:
        return True
    for x in needs:
        if x in low:
            return True
    return False


def private(i: int) -> str:
    """The i-th mark: a private character, of the basic plane and then of plane 15; after those, one of plane 16 before one of plane 15."""
    if i < 6400:
        return chr(PRIVATE + i)
    lead, at = divmod(i - 6400, PLANE)
    return (chr(0x100000 + lead - 1) if lead else "") + chr(0xF0000 + at)


def marks(text: str) -> Iterator[str]:
    """Marks without end, none of whose characters stands in `text`."""
    used = set(text)
    return (m for m in map(private, count()) if not used & set(m))


class Masked:
    """A text whose protected spans, the first kind that finds them first, are private characters."""

    def __init__(self, text: str, terms: list[str]):
        starts, ends, self.kept, low = [], [], {}, folded(text)
        wanted = [re.compile(re.escape(t)) for t in sorted(set(filter(None, terms)), key=len, reverse=True)]
        for rx in wanted + [rx for rx, needs in EVIDENCE if _may(low, needs)]:
            for m in rx.finditer(text):
                a, b = m.span()
                i = bisect_left(starts, a)
                if a < b and (not i or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= b):
                    starts.insert(i, a)
                    ends.insert(i, b)
        out, at = [], 0
        for a, b, mark in zip(starts, ends, marks(text), strict=False):
            self.kept[mark] = text[a:b]
            out += [text[at:a], mark]
            at = b
        self.text = "".join(out) + text[at:]

    def restored(self, text: str) -> str:
        def own(m: re.Match) -> str:
            return self.kept[m[0]] if m[0] in self.kept else "".join(self.kept.get(c, c) for c in m[0])

        return re.sub("[\U00100000-\U0010fffd]?[\ue000-\uf8ff\U000f0000-\U000ffffd]", own, text)


def lifted(text: str) -> str:
    return text[:1].upper() + text[1:]


def lowered(text: str) -> str:
    """First letter in lower case, unless the first word is an acronym."""
    return text[:1].lower() + text[1:] if text[:1].isupper() and not text[:2].isupper() else text


def ended(text: str) -> str:
    return text.rstrip(".!?") + "."


def cased(source: str, new: str) -> str:
    return new.upper() if source.isupper() else lifted(new) if source[:1].isupper() else new


def per_sentence(f: Callable[[str], list[str]]) -> Callable[[str], str]:
    return lambda p: " ".join(x for s in sentences(p) for x in f(s))


def split_at(pattern: str, least: int, left_least: int, right_least: int, join: Callable[[re.Match, str], str], follows: str = "") -> Callable[[str], str]:
    """Splits sentences of `least` words at a pattern, if both sides are long enough and the right one starts as `follows` says."""
    rx, start = re.compile(pattern, I), re.compile(follows, I)

    def cut(s: str) -> list[str]:
        m = rx.search(s)
        if not m or n_words(s) < least:
            return [s]
        left, right = s[: m.start()].rstrip(" ,"), s[m.end() :].strip()
        if n_words(left) < left_least or n_words(right) < right_least or not start.match(right):
            return [s]
        return [ended(left), join(m, right)]

    return per_sentence(cut)


split_compound = split_at(
    rf",\s+(and|but)\s+(?={ph.SUBJECTS})", 28, 10, 9, lambda m, r: "But " + lowered(r) if m[1].lower() == "but" else lifted(r)
)
split_contrast = split_at(
    r",\s+(yet|although)\s+", 26, 10, 7, lambda m, r: ("Yet " if m[1].lower() == "yet" else "Even so, ") + lowered(r), ph.CONTRAST_SUBJECTS
)
_colon = split_at(r":", 24, 9, 8, lambda m, r: lifted(r), ph.COLON_SUBJECTS)
split_overloaded = split_at(
    rf",\s+(while|whereas)\s+(?={ph.PIVOT_SUBJECTS})", 38, 14, 10,
    lambda m, r: ("By contrast, " if m[1].lower() == "whereas" else "At the same time, ") + r[:1].lower() + r[1:],
)


def split_colon(paragraph: str) -> str:
    return " ".join(_colon(s) if s.count(":") == 1 else s for s in sentences(paragraph))


def split_semicolons(paragraph: str) -> str:
    """Sentences of over 45 words, if every part has seven."""

    def cut(s: str) -> list[str]:
        if ";" not in s:
            return [s]
        parts = [p for p in map(str.strip, s.split(";")) if p]
        long = n_words(s) > 45 and len(parts) > 1 and all(n_words(p) >= 7 for p in parts)
        return [lifted(ended(p)) for p in parts] if long else [s]

    return per_sentence(cut)(paragraph)


def flatten(paragraph: str) -> str:
    """not only X but also Y, and not only/simply/merely X, but Y: both halves or nothing."""
    pairs = ((r"\bnot only\s+", r"\bbut also\s+", "and "), (r"\bnot\s+(?:only|simply|merely)\s+", r",\s*but(?:\s+also)?\s+", ", and "))

    def flat(s: str) -> list[str]:
        if not _may(folded(s), ("not",)):
            return [s]
        for first, second, joint in pairs:
            if re.search(first, s, I) and re.search(second, s, I):
                s = re.sub(second, joint, re.sub(first, "", s, count=1, flags=I), count=1, flags=I)
        return [s]

    return per_sentence(flat)(paragraph)


def vary_studies(paragraph: str) -> str:
    """Of three sentences or more: the second "the study" is "the analysis", later ones "it"; a second "the chapter" is "the section"."""
    every = sentences(paragraph)
    if len(every) < 3:
        return paragraph
    seen: Counter[str] = Counter()
    out = []
    for s in every:
        m = re.match(r"(?:This|The) (study|chapter)\b", s)
        if m:
            seen[m[1]] += 1
            n = seen[m[1]]
            new = None if n < 2 else "The section" if m[1] == "chapter" else "The analysis" if n == 2 else "It"
            s = new + s[m.end() :] if new else s
        out.append(s)
    return " ".join(out)


def vary_demonstratives(paragraph: str) -> str:
    """From the second "This result" (pattern, ...) on: "The result"."""
    every, n, out = sentences(paragraph), 0, []
    if len(every) < 2:
        return paragraph
    for s in every:
        if s.startswith(tuple(f"This {w}" for w in ph.DEMONSTRATIVES)):
            n += 1
            s = "The" + s[4:] if n > 1 else s
        out.append(s)
    return " ".join(out)


def drop_connectors(paragraph: str, seen: Counter, most: int) -> str:
    """Connectors at the start of sentences, beyond `most` uses of each in the document so far."""
    out = []
    for s in sentences(paragraph):
        if m := CONNECTOR.match(s):
            seen[m[1].casefold()] += 1
            if seen[m[1].casefold()] > most:
                s = lifted(s[m.end() :].lstrip())
        out.append(s)
    return " ".join(out)


def tidied(text: str) -> str:
    for pattern, new in ((r"[ \t]{2,}", " "), (r"\s+([,.;:!?])", r"\1"), (r"([.!?])\s*([A-Z])", r"\1 \2"), (r",\s*,", ",")):
        text = re.sub(pattern, new, text)
    text = text.strip()
    if "a" <= text[:1] <= "z":
        text = lifted(text)
    return re.sub(r"([.!?]\s+)([a-z])", lambda m: m[1] + m[2].upper(), text)


def phrased(paragraph: str, terms: list[str]) -> tuple[Masked, str]:
    """The masked paragraph, and its text with phrases replaced."""
    masked = Masked(paragraph.strip(), terms)
    text = masked.text
    low = folded(text)
    for rx, needs in ARTEFACTS:
        if _may(low, needs):
            text, n = rx.subn(" ", text)
            low = folded(text) if n else low
    for rx, new, needs in REPLACED:
        if _may(low, needs):
            text, n = rx.subn(lambda m, new=new: cased(m[0], new), text)
            low = folded(text) if n else low
    return masked, DIRECT.sub(lambda m: f"{m[1]} {ph.DIRECT_VERBS[m[2].lower()]} ", text) if _may(low, _DIRECT_NEEDS) else text


def refined(paragraph: str, seen: Counter, level: str, terms: list[str], known: dict[str, tuple[Masked, str]] | None = None) -> str:
    """light: phrases; balanced: also connectors, openings, semicolons; deep: also frames, demonstratives and long joins.

    known: what `phrased` made of paragraphs so far, for the same terms.
    """
    known = {} if known is None else known
    if paragraph not in known:
        known[paragraph] = phrased(paragraph, terms)
    masked, text = known[paragraph]
    if level != "light":
        text = split_semicolons(vary_studies(drop_connectors(text, seen, 0 if level == "deep" else 1)))
    if level == "deep":
        for edit in (flatten, vary_demonstratives, split_compound, split_contrast, split_colon, split_overloaded):
            text = edit(text)
    return masked.restored(tidied(text)).strip()


def guided(paragraph: str, seen: Counter, families: set[str], level: str, terms: list[str]) -> str:
    """The edits that the families call for, then `refined`; terms stay masked in both passes."""
    masked = Masked(paragraph.strip(), terms)
    text = masked.text
    for keys, pattern, new in ph.GUIDED:
        if families & set(keys):
            text = re.sub(pattern, new, text, flags=I)
    if families & set("DI"):
        text = vary_studies(vary_demonstratives(flatten(text)))
    if families & set("BG"):
        if "G" in families:
            for pattern, new in ph.DASHES:
                text = re.sub(pattern, new, text)
        chosen = [split_semicolons] + [split_compound, split_contrast] * (level != "light") + [split_colon, split_overloaded] * (level == "deep")
        for edit in chosen:
            text = edit(text)
    return refined(masked.restored(text), seen, level, terms)


_LINE = [
    (re.compile(p, f), most)
    for p, f, most in (
        (_plain(lx.HEADING_LINE), I, None), (lx.REFERENCE_HEADING, I, None), (lx.FIGURE_LINE, I, None), (lx.FORM_LINE, I, None),
        (r"#|\|", 0, None), (r"^CHAPTER\s+(?:\d+|[A-Z]+)$", I, None), (r"^\|?\s*:?-{3,}", 0, None), (r"^(?:[-*+•]\s+|\d+[.)]\s+)", 0, None),
        (lx.EMAIL, I, 16), (lx.EQUATION, I, 22),
    )
]


@lru_cache(512)  # each level asks again
def protected(line: str) -> bool:
    """Whether a line stays as it is."""
    v = line.strip()
    if not v or "\t" in line or " | " in line or "```" in v or "$$" in v:
        return True
    n = len(v.split())
    for rx, most in _LINE:
        if (rx.match(v) if most is None else n <= most and rx.search(v)):
            return True
    untitled = not re.search(r"[.!?]$", v)
    return n <= 14 and (v.isupper() or untitled and (v.istitle() or bool(re.search(lx.INSTITUTION, v, I))))


def by_line(text: str, edit: Callable[[str], str], wanted: Callable[[int, int], bool] = lambda a, b: True) -> str:
    """`edit` over the prose lines that are wanted, up to the first reference heading; everything else is copied."""
    out, at, tail = [], 0, False
    heading = re.compile(lx.REFERENCE_HEADING, I)
    for line in text.splitlines(keepends=True):
        core = line.rstrip("\r\n")
        tail = tail or bool(heading.match(core.strip()))
        out.append(line if tail or protected(core) or not wanted(at, at + len(line)) else edit(core) + line[len(core) :])
        at += len(line)
    return "".join(out).strip()
