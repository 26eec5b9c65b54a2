"""Patterns in Python syntax as Spark expressions of the same meaning.

Java gets the flags for Unix lines, Unicode classes and Unicode case folding, and the four control
characters that Python counts as white space. Patterns are always literals: Spark compiles those once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cache
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str, any_case: bool = True, lines: bool = False) -> str:
    flags = "dU" + ("iu" if any_case else "") + ("m" if lines else "")
    return f"(?{flags})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def matches(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def replace(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by.replace("\\", "\\\\").replace("$", "\\$")))


def positions(text: Column, pattern: str) -> Column:
    """Starts of all matches, from 0: the lengths of the pieces between them, and of the matches before."""
    pieces, found = F.split(text, pattern, -1), extract(text, pattern)
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda x, i: total(F.slice(pieces, F.lit(1), i + 1)) + total(F.slice(found, F.lit(1), i)))


def literal_array(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def any_of(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return F.lit(False) if out is None else out


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Guards: one search for the literals that patterns need is many times cheaper than the patterns.

#: Letters that a search without case takes for an ASCII one, though their lower case isn't.
_ODD_CASE = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def folded(text: Column) -> Column:
    """Lower case in which whatever a pattern without case takes for an ASCII letter is that letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(F.translate(text, "".join(_ODD_CASE), "".join(_ODD_CASE.values()))))


#: Stands for any character that isn't ASCII.
_NOT_ASCII = "\x80"


def _not_ascii(kind, x) -> bool:
    """Whether a part of a character class has only characters that aren't ASCII, nor folded to ASCII."""
    low, high = x if kind is parser.RANGE else (x, x) if kind is parser.LITERAL else (0, 0)
    return low >= 128 and not any(low <= ord(c) <= high for c in _ODD_CASE)


def _needed(ops: Iterable) -> frozenset[str]:
    """Literals of which each match of a parsed pattern holds one at least; none if nothing is known. The longest are chosen."""
    found: list[frozenset[str]] = []
    run = ""
    for op, value in [*ops, (None, None)]:
        if op is parser.LITERAL and value < 128:
            run += chr(value).lower()
            continue
        if op in (parser.AT, parser.ASSERT, parser.ASSERT_NOT):
            continue  # no width
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is parser.SUBPATTERN:
            found.append(_needed(value[3]))
        elif op is parser.IN and all(_not_ascii(kind, x) for kind, x in value):
            found.append(frozenset([_NOT_ASCII]))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            found.append(_needed(value[2]))
        elif op is parser.BRANCH:
            branches = [_needed(b) for b in value[1]]
            found.append(frozenset().union(*branches) if all(branches) else frozenset())
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=frozenset())


@cache
def needles(pattern: str) -> tuple[str, ...]:
    """Literals in lower case; a text whose folded form has none of them has no match. Empty if the pattern needs none."""
    found = sorted(_needed(parser.parse(pattern)), key=lambda n: (len(n), n))
    return tuple(n for i, n in enumerate(found) if not any(m in n for m in found[:i]))


def holds(text: Column, word: str) -> Column:
    """Whether the text holds the word. A plain pattern of four characters or more is searched with skips, which beats ``contains``."""
    return F.rlike(text, F.lit(re.escape(word))) if len(word) > 3 else F.contains(text, F.lit(word))


class Guard:
    """Which of many patterns a text can match at all: the literals that they need, each searched once in the folded text."""

    def __init__(self, patterns: Iterable[str]):
        self.needed = {p: needles(p) for p in patterns}
        self.words = sorted({n for found in self.needed.values() for n in found})

    def found(self, text: Column) -> Column:
        """``array<boolean>``: which of the literals stand in the text."""
        sought = lambda low: F.array(*(F.octet_length(text) != F.length(text) if w == _NOT_ASCII else holds(low, w) for w in self.words))
        return let(folded(text), sought)

    def might(self, found: Column, pattern: str) -> Column:
        """Whether a text can have a match, from what ``found`` gave for it."""
        return any_of(F.get(found, F.lit(self.words.index(n))) for n in self.needed[pattern]) if self.needed[pattern] else F.lit(True)


@cache
def guard(patterns: tuple[str, ...]) -> Guard:
    return Guard(patterns)


def could_make(replacement: str, pattern: str) -> bool:
    """Whether a replacement could be part of a literal that the pattern needs, and so make one that wasn't there."""
    r = replacement.lower()
    overlap = lambda n: n in r or r in n or any(n.endswith(r[:k]) or n.startswith(r[-k:]) for k in range(1, len(r)))
    return any(not r.isascii() if n == _NOT_ASCII else overlap(n) for n in needles(pattern))
