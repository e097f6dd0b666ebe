"""Texts without which a pattern cannot match, read off the pattern: they are looked for first, as that is much quicker."""

from __future__ import annotations

import re
from functools import cache
from itertools import product
from re import _constants as k
from re import _parser

#: So many texts at most stand for one pattern; shorter words than this are in most texts.
MOST, LEAST = 24, 3


def _exact(op, arg) -> set[str] | None:
    """All texts that one part of a pattern matches, in lower case, if they are few."""
    if op is k.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is k.IN:
        return {chr(x).lower() for _, x in arg} if all(o is k.LITERAL and x < 128 for o, x in arg) and len(arg) <= 4 else None
    if op is k.SUBPATTERN:
        return _whole(arg[-1])
    if op is k.BRANCH:
        each = [_whole(x) for x in arg[1]]
        return None if None in each else _few(set().union(*each))
    if op is k.MAX_REPEAT or op is k.MIN_REPEAT:
        once = _whole(arg[2]) if arg[:2] == (0, 1) else None
        return None if once is None else _few(once | {""})
    return {""} if op is k.AT else None


def _few(found: set[str]) -> set[str] | None:
    return found if len(found) <= MOST else None


def _whole(parts) -> set[str] | None:
    out: set[str] | None = {""}
    for op, arg in parts:
        one = _exact(op, arg)
        out = None if out is None or one is None else _few({a + b for a, b in product(out, one)})
    return out


def _shortest(found: set[str]) -> set[str]:
    """Without texts that hold another one."""
    return {x for x in found if not any(y != x and y in x for y in found)}


def _value(found: set[str]) -> tuple[int, int]:
    return 0 if any(map(_common, found)) else min(map(len, found)), -len(found)


def _common(text: str) -> bool:
    return len(text) < LEAST and text[0].isalpha()


def _needed(parts) -> set[str] | None:
    """The best of the sets one of whose texts must be found."""
    runs, run = [], {""}
    for op, arg in parts:
        one = _exact(op, arg)
        longer = None if one is None else _few({a + b for a, b in product(run, one)})
        if longer is not None:
            run = longer
            continue
        runs.append(run)
        run = {""} if one is None else one
        if one is None:
            inner = None
            if op is k.SUBPATTERN:
                inner = _needed(arg[-1])
            elif op is k.BRANCH:
                each = [_needed(x) for x in arg[1]]
                inner = None if None in each else set().union(*each)
            elif (op is k.MAX_REPEAT or op is k.MIN_REPEAT) and arg[0] > 0:
                inner = _needed(arg[2])
            if inner:
                runs.append(inner)
    kept = [x for x in map(_shortest, [*runs, run]) if "" not in x and len(x) <= MOST]
    return max(kept, key=_value, default=None)


@cache
def needed(pattern: str) -> tuple[str, ...] | None:
    """Texts in lower case, one of which stands in the lower-cased form of every text in which `pattern` is found; none where no such few are known."""
    if r"\p{" in pattern:
        return None
    try:
        found = _needed(_parser.parse(pattern))
    except re.error:  # what only Java can read
        return None
    if not found or any(map(_common, found)):
        return None
    return tuple(sorted(found))
