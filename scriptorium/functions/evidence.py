"""What a rewrite must leave alone, by plain functions of strings; as the columns of `operators.preservation`, which tests hold it against."""

from __future__ import annotations

import re
from functools import cached_property

from scriptorium.functions import lexicon as lx
from scriptorium.functions import scan
from scriptorium.functions.literals import needed
from scriptorium.functions.text import SPACE

_RARE_ENDS = re.compile("[\r\x85\u2028\u2029]")
_BLANK = f"[{SPACE.replace(chr(10), '')}]"


class _Lines:
    """A pattern of lines: with Python's own line ends, and with all that Java knows."""

    def __init__(self, pattern: str, cased: bool):
        self.needs, whole = needed(pattern), "(?s)" in pattern
        body = pattern.removeprefix("(?m)").removeprefix("(?s)").replace(r"[^\S\n]", _BLANK)
        if whole or not pattern.startswith("(?m)"):
            self.quick = self.full = re.compile(body, re.S) if whole else scan.java(body, cased)
            return
        begin, end = r"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))(?!\Z)", r"(?:(?=[\r\x85\u2028\u2029])|(?<!\r)(?=\n)|\Z)"
        head, tail = body.startswith("^"), body.endswith("$")
        inner = body[head : len(body) - tail]
        self.quick = re.compile("^" * head + scan.java(inner, cased).pattern + "$" * tail, re.M | (0 if cased else re.I))
        self.full = re.compile(begin * head + scan.java(inner, cased).pattern + end * tail, 0 if cased else re.I)


_KINDS = {name: _Lines(pattern, cased) for name, (pattern, cased) in lx.EVIDENCE.items()}
_QUALIFIERS = [scan.Pattern(p) for p in lx.QUALIFIERS.values()]


class Evidence:
    """A text and the evidence in it, each kind looked for once."""

    def __init__(self, text: str):
        self.raw, self.text = text, scan.plain(text)
        self.low = scan.folded(self.text)
        self.rare = _RARE_ENDS.search(text) is not None
        self._found: dict[str, list[str]] = {}

    def of(self, name: str) -> list[str]:
        if (got := self._found.get(name)) is None:
            kind, got = _KINDS[name], []
            if kind.needs is None or any(x in self.low for x in kind.needs):
                rx = kind.full if self.rare else kind.quick
                got = rx.findall(self.text) if self.raw is self.text else [self.raw[slice(*m.span())] for m in rx.finditer(self.text)]
                if name in ("headings", "reference_headings"):
                    got = [x.strip(SPACE) for x in got]
            self._found[name] = got
        return got

    @cached_property
    def qualifiers(self) -> list[int]:
        return [p.hits(self.text, self.low) for p in _QUALIFIERS]

    @cached_property
    def words(self) -> int:
        return len(scan.W1.findall(self.text))

    @cached_property
    def tail(self) -> str:
        """The text from its first reference heading on."""
        lines, plain = scan.LINE.split(self.raw), scan.LINE.split(self.text)
        at = next((i for i, x in enumerate(plain) if scan.REFERENCES.match(x.strip(SPACE))), None)
        return "" if at is None else "\n".join(lines[at:]).strip(SPACE)


def changed_words(a: Evidence, b: Evidence) -> float:
    before = max(1, a.words)
    return abs(b.words - before) / before


def broken(a: Evidence, b: Evidence, limit: float, terms: list[str]) -> list[str]:
    """What the candidate `b` changed that it must not, in the order of `preservation.broken`."""
    if a.raw == b.raw and limit >= 0:
        return []
    out = [f"{k} changed" for k in _KINDS if a.of(k) != b.of(k)]
    if a.qualifiers != b.qualifiers:
        out.append("claim_qualifiers changed")
    if changed_words(a, b) > limit:
        out.append("word count changed")
    return out + [f"protected term changed: {t}" for t in dict.fromkeys(terms) if t and a.raw.count(t) != b.raw.count(t)]


def certificate(original: str, candidate: str, terms: list[str]) -> dict:
    """The checks of `preservation.certificate`, whether all passed, and the share of changed words."""
    a, b = Evidence(original), Evidence(candidate)

    def same(*names: str) -> bool:
        return a.raw == b.raw or all(a.of(k) == b.of(k) for k in names)

    checks = {
        "numbers": same("numbers"), "citations": same("citation_blocks"), "urls": same("urls"), "emails": same("emails"), "headings": same("headings"),
        "tables": same("table_lines", "tabular_lines"), "equations": same("display_equations", "equationish"),
        "references": a.raw == b.raw or a.tail == b.tail, "placeholders": same("placeholders"), "acronyms": same("acronyms"),
        "claim_qualifiers": a.raw == b.raw or a.qualifiers == b.qualifiers, "user_terms": all(a.raw.count(t) == b.raw.count(t) for t in terms if t),
    }
    return {"passed": all(checks.values()), **checks, "changed_words": changed_words(a, b)}
