"""What is measured in one text, by plain functions of strings; `operators.measures` runs them over documents.

A document is read once: lines, sentences and words are kept for all measures that use
them, and a pattern is tried only where the texts it needs stand.  All sentences of some
documents are searched for those texts in one go; most hold none and meet no pattern.
Patterns mean what they mean to Java's regular expressions, so that measures agree with
the columns of `operators.segments`, `signals` and `paragraphs`; tests hold them together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate, chain, count, groupby, islice
from operator import itemgetter
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.functions import lexicon as lx
from scriptorium.functions.literals import needed
from scriptorium.functions.text import SPACE

#: White space and line ends within a class, as Java has them.
_WHITE, _END = SPACE, "\n\r\x85\u2028\u2029"
#: Letters for what only Java, and signs for what only Python takes for part of a word.
_LETTER, _SIGN = "ƻ", "§"
_CLOSERS = "])\"'’”"


def java(pattern: str, cased: bool = False, flags: int = 0) -> re.Pattern:
    """A pattern of the lexicon as Java reads it: its white space, its dot; texts do not end in a line break."""
    lines, out, i, inside = pattern.startswith("(?m)"), [], 0, False
    pattern = pattern.removeprefix("(?m)")
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            c = pattern[i : i + 2]
            if c in (r"\s", r"\S"):
                c = _WHITE if inside else f"[{'^' * (c == r'\S')}{_WHITE}]"
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == ".":
            c = f"[^{_END}]"
        elif c == "$":
            c = r"\Z"
        elif c == "^" and lines:
            c = rf"(?:\A|(?<=[{_END}]))"
        out.append(c)
        i += 1
    return re.compile("".join(out), flags | (0 if cased else re.I))


class Pattern:
    """A pattern, the texts one of which it needs, and whether it holds only at the start."""

    __slots__ = ("needs", "rx", "tried")

    def __init__(self, pattern: str, cased: bool = False):
        self.rx, self.needs = java(pattern, cased), needed(pattern)
        self.tried = self.rx.match if pattern.startswith("^") else self.rx.search

    def may(self, low: str) -> bool:
        if self.needs is None:
            return True
        for x in self.needs:
            if x in low:
                return True
        return False

    def has(self, text: str, low: str) -> bool:
        return self.may(low) and self.tried(text) is not None

    def hits(self, text: str, low: str) -> int:
        return len(self.rx.findall(text)) if self.may(low) else 0


def patterns(*each: str) -> tuple[Pattern, ...]:
    return tuple(map(Pattern, each))


GAP = re.compile(f"[{SPACE}]+")
W1, W2, W3 = (java(w, True) for w in (lx.W1, lx.W2, lx.W3))
#: Words are runs of letters where these lack; the last four are letters that a pattern may take for ASCII ones.
JOINTS = re.compile(r"[0-9_'\-’ſ\u212aıİ]")
#: For ASCII: the letters in lower case, "-" for what joins words, blanks for all else.
SPELLED = "".join(chr(i).lower() if chr(i).isalpha() else "-" if chr(i) in "0123456789_'-" else " " for i in range(128))
RUNS = re.compile(r"\w+")
LINE = re.compile(rf"\r\n|[{lx.LINE_BREAK}]")
RAW_LINE = re.compile(rf"[^{lx.LINE_BREAK}]*(?:\r\n|[{lx.LINE_BREAK}]|\Z)")
#: The white space that parts sentences, behind the sign that ends one.
BREAK = re.compile(rf"(?<=[.!?])([{SPACE}]+)(?=[A-Z\[]|\*\*)")

SECTION_HEADING, SECTION_NUMBER = java(lx.SECTION_HEADING), java(lx.SECTION_NUMBER, True)
STRUCTURE = java("|".join((r"^\d+(?:\.\d+)*\.?$", lx.PROTECTED_LINE, lx.CAPTION, lx.BARE_HEADING, lx.FORM_LABEL)))
CAPTION, BARE_HEADING, FORM_LABEL = (java(p) for p in (lx.CAPTION, lx.BARE_HEADING, lx.FORM_LABEL))
NUMBERED_HEADING, NUMBERED_TITLE = java(lx.NUMBERED_HEADING, True), java(lx.NUMBERED_TITLE, True)
CAPTION_STRICT, FORM_START, BULLET = java(lx.CAPTION_STRICT), java(lx.FORM_START), java(lx.BULLET)
EMAIL_LABEL, WHOLE_EMAIL = java(r"\bEmail\s*:\s*\S+@\S+"), java(r"^\S+@\S+$")
INSTITUTION, AUXILIARY = Pattern(lx.INSTITUTION), java(lx.AUXILIARY)
NUMERIC, SOME_NUMERIC = java(lx.NUMERIC_TOKEN, True, re.A), re.compile(r"[0-9A-Z](?:(?<=[0-9])|[A-Z])")
KEPT_LINE = java("|".join((
    lx.HEADING_LINE, lx.REFERENCE_HEADING, lx.FIGURE_LINE, lx.FORM_LINE, r"^CHAPTER\s+(?:\d+|[A-Z]+)$", r"^\|?\s*:?-{3,}", r"^(?:[-*+•]\s+|\d+[.)]\s+)",
)))
REFERENCES, EMAIL, EQUATION = java(lx.REFERENCE_HEADING), java(lx.EMAIL), java(lx.EQUATION)

VOCABULARY = [v for v in lx.VOCABULARY if v != "robust"]
HEDGES, STRONG, MODERATE = patterns(*lx.HEDGES), patterns(*lx.TRANSITIONS_STRONG), patterns(*lx.TRANSITIONS_MODERATE)
#: Points of a sentence by itself, for any of some patterns.
OWN = [
    (22, patterns(lx.SETUP, lx.DIMINISHMENT, lx.MORE_THAN, lx.TURNS_OUT)), (14, patterns(lx.ANNOUNCEMENT)), (16, patterns(lx.REFRAME)),
    (16, patterns(lx.COMPOSED_ASIDE)), (22, patterns(lx.BALANCED_ASIDES)), (24, patterns(lx.QUESTION_LIST)), (20, patterns(lx.THESIS_FIRST, lx.ACTUAL_WORK)),
    (16, patterns(lx.OBSCURED, lx.UNIVERSAL)), (18, patterns(lx.COLON_FRAME)),
]
GENERIC = [(Pattern(p), max(4, w // 3)) for p, _, w in lx.GENERIC]
FRAMES = [Pattern(rf"\b{f}\b") for f in lx.FRAMES]
VAGUE_TIME, VAGUE_TIME_WIDE, YEAR, CITATION, NUMBER = (Pattern(p) for p in (lx.VAGUE_TIME, lx.VAGUE_TIME_WIDE, lx.YEAR, lx.CITATION, lx.NUMBER))
CERTAINTY, UNSUPPORTED, IMPLAUSIBLE, CONNECTOR = (Pattern(p) for p in (lx.CERTAINTY, lx.UNSUPPORTED, lx.IMPLAUSIBLE_PERCENT, lx.CONNECTOR))
P_VALUE, COEFFICIENT, TYPO = (java(p) for p in (lx.P_VALUE, lx.COEFFICIENT, lx.TYPO))
#: Found in the lower case of all that TYPO is found in.
MAYBE_TYPO = lx.TYPO.lower().replace(r"\b", "").replace(r"\s", f"[{SPACE}]")
PRONOUNS, REPORT_OPENING = java(r"\b(?:this|these|it)\b"), java(lx.REPORT_OPENING)

SUBJECT_OPENING = java(r"^(this|these|it|the study|the chapter)\b")
LINKING = java(r"^[A-Z][a-z]+(?:\s+[a-z]+){0,3}\s+(?:is|are|was|were|has|have|can|may|should)\b", True)
PASSIVE = java(r"\b(?:is|are|was|were|be|been|being)\s+\w+ed\b")
LINKS, BEING = frozenset("is are was were has have can may should".split()), frozenset("is are was were be been being".split())
#: What is looked for first in lines: the signs of structure in a sentence.
SIGNS = re.compile(r"[\t|$`@]")
#: First characters of what STRUCTURE, or a pattern of `prose_sentence`, may match; other such texts start with one beyond ASCII.
STRUCTURE_STARTS, FORM_STARTS = frozenset("0123456789#cCrRbBaAtTfFeEiIlLwW"), frozenset("0123456789tTfFaAlLeEwWrRbB")
SUBJECT_STARTS = frozenset("TtIi")
#: One of these stands in every dated detail, or "may", or a number and white space.
DATES = tuple("monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december".split())
COUNTED = re.compile(rf"\d[{SPACE}]")

STYLE_FRAMES, STYLE_GENERIC = [Pattern(rf"\b{f}\b") for f in lx.STYLE_FRAMES], patterns(*lx.STYLE_GENERIC)
DIRECT = STYLE_GENERIC[0]  # alone of these it may go over the end of a line
LINE_CONNECTOR, TRANSITION_WORDS = Pattern(lx.LINE_CONNECTOR), Pattern(lx.TRANSITION_WORDS)
STOPWORDS, COMMON = frozenset(lx.STOPWORDS), frozenset(lx.COMMON_TOKENS)

WORDING = Pattern(rf"\b(?:{'|'.join(sorted(lx.VOCABULARY, key=len, reverse=True))})\b")
STRONG_LINES, MODERATE_LINES = (patterns(*("(?m)" + p for p in each)) for each in (lx.TRANSITIONS_STRONG, lx.TRANSITIONS_MODERATE))
ADJECTIVE, CONCLUSION, PAIRED, COLONS, INFORMAL = patterns(lx.GENERIC_ADJECTIVE, lx.CONCLUSION_OPENER, lx.PAIRED_DASHES, lx.COLON_FRAME, lx.INFORMAL)
DIMINISHED, OBSCURED, UNIVERSAL, QUESTIONS = patterns(lx.DIMINISHMENT, lx.OBSCURED, lx.UNIVERSAL, lx.QUESTION_LIST)
RHETORIC = patterns(lx.SETUP, lx.MORE_THAN, lx.DIMINISHMENT, lx.TURNS_OUT, lx.BINARY, lx.BINARY_CHOICE, lx.ACTUAL_WORK, lx.ANNOUNCEMENT)
METHODS, PERCENT, P_STATEMENT, SOURCES = patterns(lx.METHOD_TERMS, lx.EXACT_PERCENT, lx.P_STATEMENT, lx.DATA_SOURCES)
CORRECTION, DATED = patterns(lx.SELF_CORRECTION, lx.DATED_DETAIL)
#: Patterns that are not tried on a sentence without any of LITERALS, as each needs one of them.
SOUGHT = (
    *HEDGES, *STRONG, *MODERATE, *chain(*(each for _, each in OWN)), *(p for p, _ in GENERIC), *FRAMES, VAGUE_TIME, VAGUE_TIME_WIDE, CERTAINTY, UNSUPPORTED,
    CONNECTOR, *STYLE_FRAMES, *STYLE_GENERIC, LINE_CONNECTOR, TRANSITION_WORDS, WORDING, *STRONG_LINES, *MODERATE_LINES, ADJECTIVE, CONCLUSION, COLONS,
    INFORMAL, DIMINISHED, OBSCURED, UNIVERSAL, QUESTIONS, *RHETORIC, METHODS, SOURCES, CORRECTION,
)
LITERALS = {*VOCABULARY, *DATES, *chain(*(p.needs for p in SOUGHT))}
ANY_LITERAL = "|".join(re.escape(x) for x in sorted(LITERALS) if not any(y != x and y in x for y in LITERALS))
#: So many characters of documents at a time.
MOST_AT_ONCE = 500_000


@cache
def _stand_in(c: str) -> str:
    """What stands for a character that only one of Java and Python takes for part of a word."""
    kind = category(c)
    circled = "Ⓐ" <= c <= "ⓩ" or "\U0001f130" <= c <= "\U0001f189"
    if kind in ("Mn", "Me", "Mc", "Pc") or c in "\u200c\u200d" or (kind == "So" and circled):
        return _LETTER
    return _SIGN if kind == "No" else c


def plain(text: str) -> str:
    """`text`, in which words end where they end for Java; of the same length."""
    if text.isascii():
        return text
    odd = {ord(c): s for c in set(text) if c > "\x7f" and (s := _stand_in(c)) != c}
    return text.translate(odd) if odd else text


def lowered(text: str) -> str:
    return text.replace("İ", "i" + _LETTER).lower() if "İ" in text else text.lower()


def folded(text: str) -> str:
    """Lower case, with the four other letters that a pattern without regard to letter case takes for ASCII ones replaced."""
    if not text.isascii():
        for a, b in (("ſ", "s"), ("\u212a", "k"), ("ı", "i"), ("İ", "i")):
            text = text.replace(a, b)
    return text.lower()


def single(text: str) -> bool:
    """Whether blanks are all the white space there is, and none repeats; no other white space is printable."""
    return text.isprintable() and "  " not in text


def squeezed(text: str) -> str:
    return text.strip(" ") if single(text) else GAP.sub(" ", text).strip(SPACE)


def pieces(text: str) -> list[tuple[int, str]]:
    """(offset, text) of the sentences of a text, as they stand between the breaks."""
    every = BREAK.split(text)
    if len(every) == 1:
        return [(0, text)]
    starts = list(accumulate(map(len, every), initial=0))
    return list(zip(starts[:-1:2], every[::2], strict=True))


def sentences(text: str) -> list[str]:
    return [s for p in BREAK.split(text)[::2] if (s := p.strip(SPACE))]


def ends(text: str) -> bool:
    """Whether a stripped text ends a sentence, quotes and brackets aside."""
    return text.endswith((".", "!", "?")) or text.rstrip(_CLOSERS)[-1:] in (".", "!", "?")


def opening(text: str, n: int = 3) -> str:
    return " ".join(m[0] for m in islice(W2.finditer(lowered(text)), n))


def mean(values: list) -> float:
    total = 0.0
    for x in values:
        total += x
    return total / len(values)


def deviation(values: list, m: float | None = None) -> float:
    """Population standard deviation, from the mean if that is known; 0 of fewer than two."""
    if len(values) < 2:
        return 0.0
    m, square = mean(values) if m is None else m, 0.0
    for x in values:
        square += (x - m) * (x - m)
    return (square / len(values)) ** 0.5


def variation(values: list) -> float:
    return deviation(values, m) / m if len(values) >= 2 and (m := mean(values)) != 0 else 0.0


def share(deviation: float, values: list) -> float:
    """The variation of values from their deviation."""
    return deviation / m if len(values) >= 2 and (m := mean(values)) != 0 else 0.0


def running_deviation(values: list[int]) -> float:
    """Population standard deviation as Spark's aggregate has it, value by value."""
    n, m, square = 0.0, 0.0, 0.0
    for x in values:
        n += 1.0
        d = x - m
        m += d / n
        square += d * (d - d / n)
    return (square / n) ** 0.5


def percentile(values: list[int], q: float) -> float:
    """Linear interpolation between sorted values, as Spark's aggregate has it."""
    at = (len(values) - 1) * q
    low = int(at)
    high = low if at == low else low + 1
    a, b = values[low], values[high]
    return float(a) if a == b else (high - at) * a + (at - low) * b


def repeats(openings: list[str], allowed: int) -> int:
    return sum(n - allowed for o, n in Counter(openings).items() if o and n > allowed)


def upper(v: str) -> bool:
    if v.isascii():
        return v.isupper()
    kinds = {category(c) for c in set(v)}
    return "Lu" in kinds and not kinds & {"Ll", "Lt"}


def titled(v: str) -> bool:
    if v.isascii():
        return v.istitle()
    before, some = False, False
    for c in v:
        kind = category(c)
        if kind == "Ll" and not before or kind in ("Lu", "Lt") and before:
            return False
        before = kind in ("Lu", "Ll", "Lt")
        some = some or before
    return some


def kept_line(line: str) -> bool:
    """Whether a rewriter leaves a line as it is."""
    v = line.strip(SPACE)
    if not v or "\t" in line or " | " in line or "```" in v or "$$" in v or v[0] in "#|" or KEPT_LINE.match(v):
        return True
    n = v.count(" ") + 1 if single(v) else len(GAP.split(v))
    if n <= 16 and "@" in v and EMAIL.search(v) or n <= 22 and "=" in v and EQUATION.search(v):
        return True
    return n <= 14 and (upper(v) or v[-1] not in ".!?" and (titled(v) or INSTITUTION.rx.search(v) is not None))


def joined(marked: list[tuple[int, str, int, bool]]) -> list[tuple[str, int]]:
    """(unit, words) of lines (kind, text, words, ends): kind 0 breaks, 1 stands alone, 2 is joined to its like; as `segments.joined_units`."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    n = 0
    for kind, clean, words, end in [*marked, (0, "", 0, False)]:
        if kind == 2:
            held.append(clean)
            n += words
            if not (end and n >= 12):
                continue
            out.append((" ".join(held), n))
        else:
            if n >= 6:
                out.append((" ".join(held), n))
            if kind == 1:
                out.append((clean, words))
        held, n = [], 0
    return out


class Text:
    """A document and what is known of its lines and sentences so far."""

    def __init__(self, text: str):
        self.text = plain(text)
        #: Sentences in which no text of LITERALS stands, as far as that is known.
        self.cold: set[str] = set()
        #: How often TYPO is found in sentences, where that is asked for.
        self.typos: dict[str, int] = {}
        self.total_words = 0
        self._lines: dict[str, list[str]] = {}
        self._sentences: dict[str, list[str]] = {}
        self._even: set[str] = set()
        self._words: dict[str, list[str]] = {}
        self._clean: dict[str, str] = {}
        self._sizes: dict[str, int] = {}
        self._wide: dict[str, int] = {}
        self._tokens: dict[str, list[str]] = {}
        self._marks: dict[str, tuple] = {}
        self._prose: dict[str, bool] = {}
        self._own: dict[str, int] = {}
        self._openings: dict[str, str] = {}
        self._two: dict[str, str] = {}
        self._three: dict[str, bool] = {}
        self._judged: dict[str, tuple] = {}

    def _runs(self, s: str) -> bool:
        """Whether words are runs of letters, those of `words` the ASCII ones; then what is known of them is kept."""
        if s.isascii():
            spelled = s.translate(SPELLED)
            if "-" in spelled:
                return False
            got = self._words[s] = self._tokens[s] = spelled.split()
        elif JOINTS.search(s):
            return False
        else:
            got = RUNS.findall(s.lower())
            self._words[s] = [w for w in got if w.isascii()]
        self._wide[s] = len(got)
        self._even.add(s)
        return True

    def keep(self, line: str, parts: list[str]) -> None:
        """Keeps of a line what is known of its sentences, which single blanks part."""
        clean = self.clean(line)
        self._sentences[clean] = parts if clean == line else [squeezed(s) for s in parts]
        if len(parts) > 1:
            self._sizes[clean] = sum(map(len, map(self.words, parts)))
            self._tokens[line] = self._tokens[clean] = list(chain.from_iterable(map(self.tokens, parts)))
            self._wide[clean] = sum(map(self.wide, parts))

    def clean(self, line: str) -> str:
        if (got := self._clean.get(line)) is None:
            got = self._clean[line] = squeezed(line)
        return got

    def size(self, line: str) -> int:
        """The number of words of a line."""
        return len(self.words(line)) if (got := self._sizes.get(line)) is None else got

    def lines(self, text: str) -> list[str]:
        if (got := self._lines.get(text)) is None:
            got = self._lines[text] = LINE.split(text)
        return got

    def sentences(self, text: str) -> list[str]:
        if (got := self._sentences.get(text)) is None:
            got = self._sentences[text] = sentences(text)
        return got

    def words(self, s: str) -> list[str]:
        if (got := self._words.get(s)) is None:
            if self._runs(s):
                return self._words[s]
            # only two letters become ASCII ones in lower case
            got = W2.findall(s.lower()) if s.isascii() or not ("\u212a" in s or "İ" in s) else [w.lower() for w in W2.findall(s)]
            got = self._words[s] = [w.replace("’", "'") for w in got] if "’" in s else got
        return got

    def opening(self, s: str, n: int = 3) -> str:
        return " ".join(self.words(s)[:n]) if s in self._even or s.isascii() or not ("’" in s or "\u212a" in s or "İ" in s) else opening(s, n)

    def two(self, s: str) -> str:
        if (got := self._two.get(s)) is None:
            got = self._two[s] = self.opening(s, 2)
        return got

    def wide(self, s: str) -> int:
        if (got := self._wide.get(s)) is None:
            if self._runs(s):
                return self._wide[s]
            got = self._wide[s] = len(W1.findall(s))
        return got

    def tokens(self, line: str) -> list[str]:
        if (got := self._tokens.get(line)) is None:
            if line.isascii() and self._runs(line):
                return self._tokens[line]
            got = self._tokens[line] = W3.findall(lowered(line))
        return got

    # --- sentences in their document

    def structural(self, v: str, signs: bool = True) -> bool:
        """Whether a sentence is no prose; without `signs` it holds none of SIGNS."""
        if not v or signs and ("\t" in v or " | " in v or v[0] == "|" or "$$" in v or "```" in v):
            return True
        if (v[0] in STRUCTURE_STARTS or v[0] > "\x7f") and (NUMBERED_HEADING.match(v) or STRUCTURE.match(v)):
            return True
        if signs and "@" in v and (EMAIL_LABEL.search(v) or WHOLE_EMAIL.match(v)):
            return True
        return not ends(v) and len(self.words(v)) <= 20 and (INSTITUTION.rx.search(v) is not None or AUXILIARY.search(v) is None)

    def segments(self) -> list[tuple[int, int, str, int, str]]:
        """(paragraph, place in it, section, offset, text without white space at its ends) of the sentences that are prose; all words are counted on the way."""
        out, paragraph, section, total = [], -1, "other", 0
        known: dict[str, tuple[int, bool]] = {}
        for raw in RAW_LINE.finditer(self.text):
            line = raw[0].rstrip("\r\n")
            body = line.strip(SPACE)
            if not body:
                continue
            paragraph += 1
            if SECTION_HEADING.match(body) and len(self.words(body)) <= 16:
                clean = lowered(SECTION_NUMBER.sub("", body, count=1))
                section = next((name for name, starts in lx.SECTIONS if clean.startswith(starts)), "other")
            if section in ("references", "appendix"):
                total += len(W2.findall(body))
                continue
            at, signs = raw.start() + len(line) - len(line.lstrip(SPACE)), SIGNS.search(body) is not None
            for i, (offset, s) in enumerate(pieces(body)):
                if (got := known.get(s)) is None:
                    got = known[s] = (len(self.words(s)), self.structural(s, signs))
                total += got[0]
                if not got[1]:
                    out.append((paragraph, i, section, at + offset, s))
        self.total_words = total
        return out

    def three_parts(self, s: str) -> bool:
        if s.count(",") != 2:
            return False
        if (got := self._three.get(s)) is None:
            got, parts = False, []
            for p in s.split(","):
                parts.append(self.words(p))
                if len(parts[-1]) < 3:
                    break
            else:
                n = sorted(map(len, parts))
                spread = n[-1] - n[0]
                got = spread <= 4 and (spread <= 2 or len({p[0] for p in parts}) <= 2)
            self._three[s] = got
        return got

    def own(self, s: str, rules: Rules) -> int:
        """0 to 100: the risk of a sentence by itself."""
        if (got := self._own.get(s)) is not None:
            return got
        points = 0 if s in self.cold else self.worded(s, rules)
        if s.count(",") == 2 and self.three_parts(s):
            points += 12
        if dashes := s.count("—"):
            points += 28 if dashes >= 2 else 10
        got = self._own[s] = min(100, points)
        return got

    def worded(self, s: str, rules: Rules) -> int:
        """The points of a sentence for its wording."""
        points, low = 0, folded(s)
        if rules.vocabulary:
            lower = lowered(s)
            if n := sum(v in lower for v in rules.vocabulary):
                points += min(30, 10 + (n - 1) * 6)
        if n := sum(p.has(s, low) for p in rules.hedges):
            points += min(24, 8 + n * 5)
        if any(p.has(s, low) for p in rules.strong):
            points += 28
        elif any(p.has(s, low) for p in rules.moderate):
            points += 18
        for value, each in rules.own:
            if any(p.has(s, low) for p in each):
                points += value
        if rules.vague and VAGUE_TIME.has(s, low) and not YEAR.has(s, low):
            points += 8
        return points

    def risks(self, segments: list[tuple], rules: Rules) -> list[int]:
        """0 to 100 for each sentence, in the context of its document; as `signals.scored_segments`."""
        known, none = [], [0] * len(rules.frames)
        for _, i, _, _, s in segments:
            low, connector, frames = None, "", none
            if s not in self.cold:
                low = folded(s)
                m = CONNECTOR.rx.match(s)
                connector = lowered(m[1]) if m else ""
                frames = [p.hits(s, low) for p in rules.frames]
            known.append((s, low, i, self.opening(s), connector, len(self.words(s)), frames))
        again, connectors = Counter(k[3] for k in known), Counter(k[4] for k in known)
        first = Counter(k[3] for k in known if k[2] == 0)
        often = [sum(x) for x in zip(*(k[6] for k in known), strict=True)]
        limit = max(2, sum(k[5] for k in known) // 500)
        out = []
        for s, low, i, start, connector, n, frames in known:
            points = self.own(s, rules)
            if low is not None:
                points += self.placed(s, low, rules)
                for total, here in zip(often, frames, strict=True):
                    if here and total > limit:
                        points += min(12, 3 + total)
            if start and again[start] > 2:
                points += min(18, 6 * (again[start] - 2))
            if i == 0 and start and first[start] > 1:
                points += min(18, 8 * (first[start] - 1))
            if connector and connectors[connector] > 2:
                points += 12
            if n > 65:
                points += 8
            elif 0 < n < 5:
                points += 4
            if s.count(";") >= 2:
                points += 12
            if s.count(",") >= 7:
                points += 10
            if len(s) >= 14 and self.pronouns(s) >= 5:
                points += 10
            if "%" in s and IMPLAUSIBLE.rx.search(s):
                points += 18
            if s.count("(") >= 3 and len(CITATION.rx.findall(s)) >= 3:
                points += 8
            out.append(min(100, points))
        return out

    def placed(self, s: str, low: str, rules: Rules) -> int:
        """The points of a sentence for wording that counts within its document."""
        points = 0
        for p, least in rules.generic:
            if hits := p.hits(s, low):
                points += min(least + (hits - 1) * 2, 12)
        if rules.certain and CERTAINTY.hits(s, low) >= 2:
            points += 10
        if rules.unsupported and UNSUPPORTED.has(s, low) and not CITATION.has(s, low):
            points += 14
        if rules.vague_wide and VAGUE_TIME_WIDE.has(s, low) and not YEAR.has(s, low):
            points += 10
        return points

    def pronouns(self, s: str) -> int:
        words = self.words(s)
        if s in self._even:
            return words.count("it") + words.count("this") + words.count("these")
        low = folded(s)
        return len(PRONOUNS.findall(s)) if low.count("it") + low.count("this") + low.count("these") >= 5 else 0

    # --- the style of a text

    def mark(self, line: str) -> tuple[tuple, bool]:
        if (got := self._marks.get(line)) is None:
            clean = self.clean(line)
            n = self.wide(clean)
            kind = 0 if kept_line(line) else 1 if n >= 18 else 2
            got = self._marks[line] = ((kind, clean, n, ends(clean)), REFERENCES.match(clean) is not None)
        return got

    def style(self, text: str, low: str, told: str | None = None) -> dict:
        """The measures that `style.style_report` makes its report of; told: the sentences with a text of LITERALS, if known, a line each."""
        lines = self.lines(text)
        every = [self.mark(line) for line in lines]
        tail = next((i for i, (_, is_tail) in enumerate(every) if is_tail), len(every))
        units = joined([m for m, _ in every[:tail]])
        parts = [s for u, _ in units for s in self.sentences(u)]
        lengths, blocks = [n for n in map(self.wide, parts) if n], [n for _, n in units if n]
        s_sd, p_sd = deviation(lengths), deviation(blocks)
        tokens = list(chain.from_iterable(self.tokens(line) for line in lines if line))
        told = text if told is None else told
        frames = [p.hits(told, low) for p in STYLE_FRAMES]
        words = sum(m[2] for m, _ in every)
        limit = max(2, max(1, words) // 500)
        return {
            "word_count": words, "paragraph_count": len(units), "sentence_count": len(parts), "n_lengths": len(lengths), "n_blocks": len(blocks),
            "msttr": _type_token_ratio(tokens), "s_cv": share(s_sd, lengths), "p_cv": share(p_sd, blocks), "s_sd": s_sd, "p_sd": p_sd,
            "short": sum(5 <= n <= 11 for n in lengths), "long": sum(30 <= n <= 52 for n in lengths),
            "generic_phrase_hits": sum(p.hits(text if p is DIRECT else told, low) for p in STYLE_GENERIC),
            "repeated_sentence_openings": repeats([self.plain_opening(s) for s in parts], 2),
            "repeated_paragraph_openings": repeats([self.plain_opening(u) for u, _ in units], 1),
            "generic_connector_hits": LINE_CONNECTOR.hits(text, low),
            "long_sentence_count": sum(n > 45 for n in lengths), "overloaded_sentence_count": sum(n > 65 for n in lengths),
            "very_short_sentence_count": sum(n < 5 for n in lengths), "repeated_frame_density": sum(max(0, n - limit) for n in frames), "frames": frames,
        }

    def plain_opening(self, s: str) -> str:
        if (got := self._openings.get(s)) is None:
            got = self._openings[s] = " ".join(self._tokens[s][:3] if s in self._tokens else [m[0] for m in islice(W3.finditer(lowered(s)), 3)])
        return got

    # --- families and paragraphs of prose

    def prose_sentence(self, sentence: str) -> bool:
        if (got := self._prose.get(sentence)) is None:
            got = len(self.words(sentence)) >= 6
            if got:
                s = squeezed(sentence)
                formal = s[0] in FORM_STARTS or s[0] > "\x7f"
                got = not (formal and (CAPTION_STRICT.match(s) or NUMBERED_TITLE.match(s) or FORM_START.match(s)) or not (sentence in self._even and s[1:].islower()) and _numeric(s))
            self._prose[sentence] = got
        return got

    def prose(self, text: str) -> tuple[list[str], list[tuple[str, int]]]:
        """The prose sentences and the (paragraph, words) of a text; as `segments.prose_sentences` and `prose_paragraphs`."""
        marked, own = [], []
        for i, line in enumerate(self.lines(text)):
            if not line:
                marked.append((0, "", 0, False))
                continue
            clean = self.clean(line)
            n = self.size(clean)
            title = i < 15 and n <= 30 and clean[-1:] not in (".", "!", "?")
            skipped = not clean or title or "\t" in line or " | " in line
            if not skipped and (clean[0] in STRUCTURE_STARTS or clean[0] > "\x7f"):
                skipped = NUMBERED_HEADING.match(clean) or CAPTION.match(clean) or BARE_HEADING.match(clean) or FORM_LABEL.match(clean)
            marked.append((0 if skipped else 1 if n >= 18 else 2, clean, n, ends(clean)))
            if not skipped:
                own += [s for s in self.sentences(clean) if (self._prose[s] if s in self._prose else self.prose_sentence(s))]
        if not own:
            own = [s for s in self.sentences(text) if self.prose_sentence(s)]
        units = joined(marked)
        if not units:
            units = [(b, len(self.words(b))) for p in re.split(rf"\n[{SPACE}]*\n", text) if (b := p.strip(SPACE))]
        return own, units

    def families(self, text: str, low: str, own: list[str], units: list[tuple[str, int]]) -> dict:
        """The measures that `families.family_evidence` makes its evidence of."""
        body, warm = "\n".join(own), [s for s in own if s not in self.cold]
        told = "\n".join(warm)  # for what is found within a sentence
        lengths, blocks = [len(self.words(s)) for s in own], [n for _, n in units]
        live: dict[Pattern, int] = {}

        def matching(p: Pattern) -> int:
            if p not in live:
                live[p] = sum(p.rx.search(s) is not None for s in (own if p.needs is None else warm)) if p.may(low) else 0
            return live[p]

        wording = [w for m in WORDING.rx.finditer(told) if (w := lowered(m[0])) not in ("robust", "comprehensive")] if WORDING.may(low) else []
        bullets = [x for x in self.lines(text) if x and BULLET.match(x)]
        starts = [self.two(s) for s in own]
        return {
            "n": len(own), "words": sum(lengths), "n_paragraphs": len(units), "sentence_cv": variation(lengths), "paragraph_cv": variation(blocks),
            "n_vocabulary": len(wording), "n_different": len(set(wording)), "adjectives": ADJECTIVE.hits(body, low),
            "tight": sum(max(x) - min(x) <= 5 for x in zip(lengths, lengths[1:], lengths[2:], strict=False)),
            "hedges": sum(p.hits(told, low) for p in HEDGES), "bullets": len(bullets), "bullet_words": sum(len(self.words(x)) for x in bullets),
            "conclusion": CONCLUSION.has(body, low), "tricolons": sum(s.count(",") == 2 and self.three_parts(s) and len(NUMBER.rx.findall(s)) < 3 for s in own),
            "diminished": matching(DIMINISHED), "obscured": matching(OBSCURED), "universal": matching(UNIVERSAL),
            "strong": sum(p.hits(told, low) for p in STRONG_LINES), "moderate": sum(p.hits(told, low) for p in MODERATE_LINES),
            "dashes": body.count("—"), "paired": "—" in body and PAIRED.rx.search(body) is not None,
            "semicolons": (CITATION.rx.sub("", body) if "(" in body else body).count(";") if ";" in body else 0, "colons": COLONS.hits(told, low),
            "informal": INFORMAL.has(body, low), "complete": sum(s[-1] in ".!?" for s in own), "rhetoric": sum(matching(p) >= 2 for p in RHETORIC),
            "anaphora": any(a and a == b == c for a, b, c in zip(starts, starts[1:], starts[2:], strict=False)), "questions": matching(QUESTIONS),
            "technical": METHODS.has(text, low) + ("%" in text and len(PERCENT.rx.findall(text)) >= 5 or P_STATEMENT.hits(text, text) >= 2) + SOURCES.has(text, low),
            "corrected": CORRECTION.has(text, low), "dated": (any(x in low for x in DATES) or "may" in text.lower() or COUNTED.search(text) is not None) and DATED.has(text, low),
        }

    def paragraphs(self, units: list[tuple[str, int]], rules: Rules) -> dict:
        """How the style risk of paragraphs is distributed; as `paragraphs.segment_scores` and `segment_distribution`."""
        scores, known = [], self._judged
        for unit, _ in units:
            every = [known.get(s) or self.judged(s, rules) for s in self.sentences(unit)]
            own = [x for x in every if x[0]] or every
            risks, n = [x[1] for x in own] or [0], [x[2] for x in own] or [0]
            starts = [x[3] for x in own if x[3]]
            average = mean(n)
            cv = running_deviation(n) / average if len(own) >= 2 and average > 0 else 0.0
            points = (14 if cv < 0.22 else 7 if cv < 0.32 else 0) if len(own) >= 3 else 0
            points += 6 * (len(own) >= 4 and min(n) >= 12 and max(n) <= 38)
            points += 8 * (len(starts) >= 3 and len(set(starts)) <= max(1, len(starts) // 2))
            points += 8 * (sum([x[4] for x in own]) >= 2)
            scores.append(min(100, round(max(risks) * 0.45 + mean(risks) * 0.35 + min(35, points) * 0.20)))
        scores.sort()
        return {
            "segment_count": len(scores), "segment_mean": round(mean(scores)), "segment_p75": round(percentile(scores, 0.75)),
            "segment_p90": round(percentile(scores, 0.9)), "flagged_segments": sum(x >= 20 for x in scores),
        }

    def judged(self, s: str, rules: Rules) -> tuple[bool, int, int, str, bool]:
        """Whether a sentence is prose, its risk by itself, its words, the first two of them, and whether it opens as reports do."""
        report = s[:1] in ("T", "t") and REPORT_OPENING.match(s) is not None
        got = self._judged[s] = (self.prose_sentence(s), self.own(s, rules), len(self.words(s)), self.two(s), report)
        return got

    # --- the fingerprint of prose

    def syntax_share(self, segments: list[tuple], linked: bool, been: bool) -> float:
        """The share of sentences whose construction occurs three times or more; whether some word is one of LINKS, and of BEING."""
        found: Counter[str] = Counter()
        for s, k in Counter(map(itemgetter(4), segments)).items():
            if (linked or been or s not in self._even or s not in self.cold or s[0] in SUBJECT_STARTS or s[0] > "\x7f") and (name := self.signature(s, linked, been)):
                found[name] += k
        return sum(k for k in found.values() if k >= 3) / len(segments)

    def signature(self, s: str, linked: bool = True, been: bool = True) -> str:
        """The construction of a sentence, as `style.syntactic_signature`; empty for any other."""
        if s not in self.cold and CONNECTOR.rx.match(s):
            return "transition"
        even = s in self._even
        if (s[:1] in SUBJECT_STARTS or s[:1] > "\x7f") and SUBJECT_OPENING.match(s):
            return "subject"
        if not (even and (not linked or LINKS.isdisjoint(self.words(s)[1:5]))) and LINKING.match(s):
            return "linking"
        if even and (not been or BEING.isdisjoint(self.words(s))):
            return ""
        return "passive" if "ed" in folded(s) and PASSIVE.search(s) else ""


class Rules:
    """The rules of sentences that a text, in lower case, may meet."""

    def __init__(self, low: str):
        def live(each: tuple[Pattern, ...]) -> list[Pattern]:
            return [p for p in each if p.may(low)]

        self.vocabulary = [v for v in VOCABULARY if v in low]
        self.hedges, self.strong, self.moderate = live(HEDGES), live(STRONG), live(MODERATE)
        self.own = [(value, kept) for value, each in OWN if (kept := live(each))]
        self.frames = live(FRAMES)
        self.generic = [(p, least) for p, least in GENERIC if p.may(low)]
        self.vague, self.vague_wide = VAGUE_TIME.may(low), VAGUE_TIME_WIDE.may(low)
        self.certain, self.unsupported = CERTAINTY.may(low), UNSUPPORTED.may(low)


def _type_token_ratio(tokens: list[str], window: int = 50, step: int = 25) -> float:
    if len(tokens) <= window:
        return len(set(tokens)) / len(tokens) if tokens else 0.0
    return mean([len(set(tokens[i : i + window])) / window for i in range(0, len(tokens) - window + 1, step)])


def _numeric(s: str) -> bool:
    if not SOME_NUMERIC.search(s):
        return False
    parts = [t for t in s.split(" ") if t]
    return sum(NUMERIC.match(t.strip("(),;:")) is not None for t in parts) / max(1, len(parts)) >= 0.45


def _distributions(read: list[tuple[Text, list]]) -> Iterator[dict]:
    """Shares and repetition of words, and how even density and construction are, over the sentences that are prose, of documents that have some.

    Words are numbered, in all of the documents at once.
    """
    if not read:
        return
    each = [known for one, segments in read for known in map(one.words, map(itemgetter(4), segments))]
    words = list(chain.from_iterable(each))
    index = dict(zip(dict.fromkeys(words), count(), strict=False))
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def among(known: frozenset[str]) -> np.ndarray:
        return np.fromiter(map(known.__contains__, index), bool, len(index))

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(values)))[at])

    stock = among(STOPWORDS)
    content = ~stock & (np.fromiter(map(len, index), np.int64, len(index)) > 2)
    # where documents, and paragraphs, start among the sentences, and where sentences start among the words; with the end of all
    first = np.fromiter(accumulate((len(x) for _, x in read), initial=0), np.int64, len(read) + 1)
    block = np.fromiter(map(itemgetter(0), chain.from_iterable(x for _, x in read)), np.int64, len(each))
    new = np.concatenate(([True], block[1:] != block[:-1], [True]))[: len(each) + 1]
    new[first] = True
    starts = np.flatnonzero(new)
    at = np.fromiter(accumulate(map(len, each), initial=0), np.int64, len(each) + 1)
    density, even = (sums(content[ids], x) / np.maximum(1, np.diff(x)) for x in (at, at[starts]))
    blocks, bounds = np.searchsorted(starts, first).tolist(), at[first].tolist()
    common, linked, been = (sums(among(known)[ids], bounds).tolist() for known in (COMMON, LINKS, BEING))
    first = first.tolist()
    del each, words, index
    for i, (one, segments) in enumerate(read):
        read[i] = None
        own = ids[bounds[i] : bounds[i + 1]]
        n, densities, parts = len(own), np.sort(density[first[i] : first[i + 1]]).tolist(), even[blocks[i] : blocks[i + 1]].tolist()
        yield {
            "top_share": _most(own, 12) / n if n else 0.0, "common_share": common[i] / n if n else 0.0, "n_words": n,
            "repeated_units": _repeated_units(own, stock) if n >= 20 else 0, "sn": len(densities), "pn": len(parts),
            "density_s_cv": variation(densities), "density_p_cv": variation(parts), "syntax_share": one.syntax_share(segments, linked[i] > 0, been[i] > 0),
        }


def _most(words: np.ndarray, k: int) -> int:
    """How many of some words are one of the k most frequent."""
    words = np.sort(words)
    counts = np.diff(np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1], [True]))))
    return int(np.sort(counts)[-k:].sum())


def _repeated_units(words: np.ndarray, stock: np.ndarray) -> int:
    """Words in the third and later occurrences of runs of 2 to 4 words, not all stock words; of the numbers of words, and of which numbers are stock."""
    out, many, runs, plain = 0, len(stock), words, stock[words]
    whole = plain
    for n in (2, 3, 4):
        if (int(runs.max()) + 1) * many >= 2**63:
            runs = np.unique(runs, return_inverse=True)[1]
        runs, whole = runs[:-1] * many + words[n - 1 :], whole[:-1] & plain[n - 1 :]
        found = np.sort(runs[~whole])
        again = int(np.count_nonzero(found[2:] == found[:-2]))
        if not again:  # longer runs are made of such
            break
        out += n * again
    return out


def style(text: str | None) -> dict:
    one = Text(text or "")
    return one.style(one.text, folded(one.text))


def families(prose: str) -> dict:
    one = Text(prose)
    return one.families(one.text, _prose_low(one.text), *one.prose(one.text))


def _prose_low(prose: str) -> str:
    """In which stands all that stands in the lines of the prose, joined or not, and in its sentences."""
    return folded(GAP.sub(" ", prose))


def _cold(each: set[str]) -> set[str]:
    """Those of the sentences in which no text of LITERALS stands, also without blanks that repeat."""
    known = list(each)
    clean = [squeezed(s) for s in known]
    found = pc.match_substring_regex(pa.array(map(folded, clean), pa.large_string(), size=len(clean)), ANY_LITERAL).to_pylist()
    return {x for pair in zip(known, clean, found, strict=True) if not pair[2] for x in pair[:2]}


def _typos(each: set[str]) -> dict[str, int]:
    """How often TYPO is found in those of the sentences in which it is."""
    known = list(each)
    maybe = pc.match_substring_regex(pa.array(map(folded, known), pa.large_string(), size=len(known)), MAYBE_TYPO).to_pylist()
    return {s: len(TYPO.findall(s)) for s, may in zip(known, maybe, strict=True) if may}


def _read(texts: Iterable[str | None], typos: bool = False) -> Iterator[tuple[Text, list[tuple], dict]]:
    """Each document, the sentences that are prose, and what `_distributions` finds in them, if there are any; with `typos` those of sentences are known."""
    held: list[tuple[Text, list]] = []
    size, left = 0, iter(texts)
    while True:
        text = next(left, left)
        if text is not left:
            one = Text(text or "")
            held.append((one, one.segments()))
            size += len(one.text)
            if size < MOST_AT_ONCE:
                continue
        each = {x[4] for _, segments in held for x in segments}
        cold, slips = _cold(each), _typos(each) if typos else {}
        for one, _ in held:
            one.cold, one.typos = cold, slips
        distributions = _distributions([x for x in held if x[1]])
        for j, (one, segments) in enumerate(held):
            held[j] = None  # what is known of a text goes with it
            yield one, segments, next(distributions) if segments else {}
        if text is left:
            return
        held, size = [], 0


def documents(texts: list[str | None], naturalness: bool = True, context: bool = True) -> list[dict]:
    """All measures of each document: coverage, sections, ranges of flagged sentences, its style, and those of its prose.

    Without `naturalness` the style of the whole text is left out; that of the prose stays.  Without `context` the
    sections and ranges are, which alone take the risk of a sentence within its document.
    """
    return [_document(*known, naturalness, context) for known in _read(texts)]


def fingerprints(texts: Iterable[str | None]) -> Iterator[list[dict]]:
    """What `style.fingerprint` is made of, of each document: a list of one, empty without prose."""
    for one, segments, distribution in _read(texts, typos=True):
        yield [_fingerprint(one, segments, distribution)] if segments else []


def _warm(one: Text, segments: list[tuple]) -> tuple[list[str], str]:
    """The sentences with a text of LITERALS, and a text in which stands every such text that does: none holds the end of a sentence, so none goes over it."""
    warm = [x[4] for x in segments if x[4] not in one.cold]
    return warm, "\n".join(folded(squeezed(s)) for s in dict.fromkeys(warm))


def _prose(one: Text, segments: list[tuple]) -> str:
    """The prose of a document, as `segments.prose_text`; what is known of its lines is kept."""
    lines: list[str] = []
    for _, each in groupby(segments, itemgetter(0)):
        p = [x[4] for x in each]
        lines += [" ".join(p), ""]
        one.keep(lines[-2], p)
    lines.pop()
    prose = "\n\n".join(lines[::2])
    if not any(c in prose for c in "\x1c\x1d\x1e"):  # they end lines, but are no white space and so stay
        one._lines[prose] = lines
    return prose


def _document(one: Text, segments: list[tuple], distribution: dict, naturalness: bool, context: bool) -> dict:
    out = {
        "total_words": one.total_words, "assessed_words": 0, "assessed_sentences": len(segments), "assessed_paragraphs": len({s[0] for s in segments}),
    }
    if context:
        out |= {"sections": [], "flagged_at": []}
    if naturalness:
        out["own_style"] = one.style(one.text, folded(one.text))
    if not segments:
        return out
    warm, low = _warm(one, segments)
    rules = Rules(low)
    if context:
        risks = one.risks(segments, rules)
        sections: dict[str, list[int]] = {}
        for (_, _, section, _, _), risk in zip(segments, risks, strict=True):
            sections.setdefault(section, []).append(risk)
        out["sections"] = [{"section": k, "n": len(v), "total": sum(v)} for k, v in sections.items()]
        out["flagged_at"] = [{"start": at, "end": at + len(s)} for (_, _, _, at, s), risk in zip(segments, risks, strict=True) if risk >= 25]
    prose = _prose(one, segments)
    own, units = one.prose(prose)
    told = "\n".join(warm)
    return out | {
        "assessed_words": distribution["n_words"],
        "style": one.style(prose, low, told), "families": one.families(prose, low, own, units), "paragraphs": one.paragraphs(units, rules),
        "distribution": distribution | {"transitions": TRANSITION_WORDS.hits(told, low)},
    }


def _fingerprint(one: Text, segments: list[tuple], distribution: dict) -> dict:
    warm, low = _warm(one, segments)
    prose, told = _prose(one, segments), "\n".join(warm)
    years = YEAR.rx.findall(prose) if YEAR.may(prose) else []
    equal = "=" in prose
    related = equal or "<" in prose or ">" in prose
    typos = one.typos
    return distribution | {
        "style": one.style(prose, low, told), "transitions": TRANSITION_WORDS.hits(told, low),
        # single blanks between sentences are none, what parts paragraphs is one
        "typos": len({x[0] for x in segments}) - 1 + sum([typos[x[4]] for x in segments if x[4] in typos]),
        "vague": VAGUE_TIME_WIDE.hits(told, low), "latest": max(map(int, years), default=None),
        "percentages": len(IMPLAUSIBLE.rx.findall(prose)) if "%" in prose else 0,
        "p_values": sum(not 0 <= float(v) <= 1 for v in P_VALUE.findall(prose)) if related else 0,
        "coefficients": sum(abs(float(v)) > 1 for v in COEFFICIENT.findall(prose)) if equal else 0,
        "certain": CERTAINTY.hits(told, low),
        "unsupported": sum(UNSUPPORTED.rx.search(s) is not None and CITATION.rx.search(s) is None for s in warm) if UNSUPPORTED.may(low) else 0,
    }
