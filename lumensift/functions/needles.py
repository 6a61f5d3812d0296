"""Strings that a text must hold for a regular expression to match in it: cheap tests that spare the expression itself."""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column

try:  # the parser behind ``re``; without it nothing is known of an expression, and it runs on every text
    from re import _constants as C
    from re import _parser as P
except ImportError:
    C = P = None

#: Alternatives that are worth testing one by one, and characters of a class that are.
MOST_ALTERNATIVES, MOST_OF_CLASS = 24, 4


class Needles(NamedTuple):
    """any_of: one of these is in every match (in lower case, where folded); none if nothing is known.

    context_free: whether a match inside a line is a match in any text that holds the line.
    """

    any_of: tuple[str, ...]
    folded: bool
    context_free: bool


def _weight(text: str) -> int:
    """How rare a string is, roughly."""
    return sum(1 if c in " .,etaoinsr\n" else 2 if c.isalnum() else 4 for c in text)


def _score(found: frozenset[str]) -> tuple[int, int]:
    return (min(map(_weight, found)), -len(found)) if found else (0, 0)


def _best(parts, fold: bool) -> frozenset[tuple[str, bool]]:
    """The alternatives, each with whether case counts, of which a match of the sequence must hold one."""
    sets, run = [], ""

    def flush() -> None:
        nonlocal run
        if run:
            sets.append(frozenset([(run, fold)]))
        run = ""

    for op, arg in parts:
        if op is C.LITERAL:
            run += chr(arg)
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0 and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
            run += chr(arg[2][0][1])  # what stands before meets the first of them, what follows the last one
            flush()
            run = chr(arg[2][0][1])
            continue
        flush()
        if op is C.SUBPATTERN:
            _, added, removed, inner = arg
            sets.append(_best(inner, (fold or bool(added & re.IGNORECASE)) and not removed & re.IGNORECASE))
        elif op is C.ATOMIC_GROUP:
            sets.append(_best(arg, fold))
        elif op is C.BRANCH:
            each = [_best(b, fold) for b in arg[1]]
            if all(each) and sum(map(len, each)) <= MOST_ALTERNATIVES:
                sets.append(frozenset().union(*each))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            if arg[0] > 0:
                sets.append(_best(arg[2], fold))
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= MOST_OF_CLASS:
            sets.append(frozenset((chr(a), fold) for _, a in arg))
    flush()
    return max(sets, key=lambda s: _score(frozenset(t for t, _ in s)), default=frozenset())


def _context_free(parts) -> bool:
    """No anchors but word boundaries (a line's end is one as well), no look at what surrounds a match, no atomic groups."""
    for op, arg in parts:
        if op is C.AT:
            if arg not in (C.AT_BOUNDARY, C.AT_NON_BOUNDARY):
                return False
        elif op in (C.ASSERT, C.ASSERT_NOT, C.ATOMIC_GROUP, C.POSSESSIVE_REPEAT, C.GROUPREF_EXISTS):
            return False
        elif op is C.SUBPATTERN:
            if not _context_free(arg[3]):
                return False
        elif op is C.BRANCH:
            if not all(map(_context_free, arg[1])):
                return False
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and not _context_free(arg[2]):
            return False
    return True


@cache
def needles(regex: str) -> Needles:
    if P is None:
        return Needles((), False, False)
    try:
        tree = P.parse(regex)
    except (re.error, OverflowError):  # of another dialect
        return Needles((), False, False)
    found = _best(tree, bool(tree.state.flags & re.IGNORECASE))
    folded = any(fold and t.lower() != t.upper() for t, fold in found)
    # what folds beyond ASCII may change its length: nothing is claimed then
    if any(not t.isascii() and folded for t, _ in found):
        found, folded = frozenset(), False
    return Needles(tuple(sorted({t.lower() if folded else t for t, _ in found})), folded, _context_free(tree))


def may_match(text: Column, lowered: Column, regex: str) -> Column | None:
    """Whether the text holds what the expression needs; None if nothing is known. lowered: the text in lower case."""
    known = needles(regex)
    out = None
    for needle in known.any_of:
        test = (lowered if known.folded else text).contains(needle)
        out = test if out is None else out | test
    return out


def matches(text: Column, lowered: Column, regex: str) -> Column:
    """rlike, behind the cheap test."""
    cheap = may_match(text, lowered, regex)
    return text.rlike(regex) if cheap is None else cheap & text.rlike(regex)
