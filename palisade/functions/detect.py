"""Tier 1: pattern and structure detection as one Column expression, without shuffles or Python."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog
from .catalog import Pattern
from .regex import Guard, any_of, count, extract, guard, holds, java, let, matches, positions

RISKS = ("low", "medium", "high", "critical")
MATCHES = "array<struct<pattern:string,matched:string,position:int,category:string,severity:string>>"
FLAGS = "array<struct<type:string,details:string,severity:string>>"


@dataclass(frozen=True)
class Detector:
    """Settings of the detector; ``custom`` patterns switch the keyword filter off, ``added`` ones don't."""

    use_fast_filter: bool = True
    max_analysis_length: int = 50_000
    entropy_threshold: float = 4.5
    entropy_min_length: int = 50
    max_field_length: int = 100_000
    custom: tuple[Pattern, ...] = ()
    added: tuple[Pattern, ...] = ()

    @property
    def patterns(self) -> tuple[Pattern, ...]:
        return catalog.PATTERNS + self.custom + self.added

    def add_pattern(self, pattern: Pattern) -> Detector:
        return Detector(**{**self.__dict__, "added": (*self.added, pattern)})


def java_of(p: Pattern) -> str:
    return java(p.regex, p.flag == "i")


def has_keyword(text: Column) -> Column:
    """Whether the lower-case text holds any of the filter's keywords."""
    return let(F.lower(text), lambda low: any_of(holds(low, k) for k in catalog.KEYWORDS))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""

    def bits(size: Column) -> Column:
        # Each step takes the first character out of what is left, all of it, and counts what the step before took.
        def step(x: Column, _: Column) -> Column:
            first = F.substring(x["left"], 1, 1)
            n = (x["before"] - F.octet_length(x["left"])) / x["width"] / size
            return F.when(x["width"] == 0, x).otherwise(F.struct(F.replace(x["left"], first).alias("left"), F.octet_length(x["left"]).alias("before"), F.octet_length(first).alias("width"), (x["bits"] - n * F.log2(n)).alias("bits")))

        first = F.substring(text, 1, 1)
        start = F.struct(F.replace(text, first).alias("left"), F.octet_length(text).alias("before"), F.octet_length(first).alias("width"), F.lit(0.0).alias("bits"))
        # As many steps as the text can have characters: 128 if it is ASCII, or else its length.
        steps = F.sequence(F.lit(0), F.when(size == F.octet_length(text), F.least(size, F.lit(128))).otherwise(size))
        return F.aggregate(steps, start, step, lambda x: x["bits"])

    return F.when(F.octet_length(text) > 0, let(F.length(text), bits)).otherwise(0.0)


_STRUCTURE = (catalog.NESTED_TAG, catalog.ROLE_WORD, catalog.NESTED_BRACKETS, catalog.MANY_NEWLINES, catalog.HEADING, catalog.SEPARATOR_LINE)


def _guard(patterns: Sequence[Pattern]) -> Guard:
    return guard((*(p.regex for p in patterns), *_STRUCTURE))


def _nested(text: Column, found: Column, g: Guard) -> Column:
    tag, word = java(catalog.NESTED_TAG), java(catalog.ROLE_WORD)
    crowded = lambda tags: (F.size(tags) > 4) & F.exists(tags, lambda t: matches(t, word))
    tagged = (g.might(found, catalog.NESTED_TAG) & (count(text, tag) >= 2)) | (g.might(found, catalog.ROLE_WORD) & let(extract(text, java(catalog.ANY_TAG, any_case=False)), crowded))
    return (F.contains(text, F.lit("<")) & tagged) | (g.might(found, catalog.NESTED_BRACKETS) & F.contains(text, F.lit("[[")) & matches(text, java(catalog.NESTED_BRACKETS)))


def _formatted(text: Column, found: Column, g: Guard) -> Column:
    ways = ((catalog.MANY_NEWLINES, False, "\n\n\n"), (catalog.HEADING, True, "#"), (catalog.SEPARATOR_LINE, False, "\n"))
    return any_of(g.might(found, p) & F.contains(text, F.lit(sign)) & matches(text, java(p, lines=lines)) for p, lines, sign in ways)


def _beside_literals(text: Column, g: Guard, use) -> Column:
    """``use(text, found)`` with both computed once."""
    return let(F.struct(text.alias("t"), g.found(text).alias("found")), lambda x: use(x["t"], x["found"]))


def nested_markers(text: Column) -> Column:
    return _beside_literals(text, _guard(()), lambda t, found: _nested(t, found, _guard(())))


def suspicious_formatting(text: Column) -> Column:
    return _beside_literals(text, _guard(()), lambda t, found: _formatted(t, found, _guard(())))


def structural_flags(text: Column, original: Column, d: Detector = Detector()) -> Column:
    """``array<struct<type,details,severity>>``: excessive length of the original, high entropy, nested markers, formatting."""

    def flag(kind: str, details: Column, severity: str, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), details.alias("details"), F.lit(severity).alias("severity")))

    def found(x: Column) -> Column:
        return F.array(
            flag("excessive_length", F.concat(F.lit("Length "), x["size"].cast("string"), F.lit(f" is above {d.max_field_length}")), "medium", x["size"] > d.max_field_length),
            flag("high_entropy", F.concat(F.lit("Entropy "), F.format_number(x["bits"], 2), F.lit(f" is above {d.entropy_threshold}")), "medium", x["bits"] > d.entropy_threshold),
            flag("nested_markers", F.lit("Nested tags or brackets name roles"), "medium", x["nested"]),
            flag("suspicious_formatting", F.lit("Formatting sets a command apart"), "low", x["formatted"]),
        )

    g = _guard(())
    structure = _beside_literals(text, g, lambda t, literals: _structure(t, literals, g, F.length(original), d))
    return F.filter(let(structure, found), lambda f: f.isNotNull())


def _structure(text: Column, found: Column, g: Guard, size: Column, d: Detector) -> Column:
    """``size, bits`` (0 below the least length), ``nested, formatted``."""
    bits = F.when(F.length(text) >= d.entropy_min_length, entropy(text)).otherwise(0.0)
    return F.struct(size.alias("size"), bits.alias("bits"), _nested(text, found, g).alias("nested"), _formatted(text, found, g).alias("formatted"))


def pattern_counts(text: Column, patterns: Sequence[Pattern]) -> Column:
    """``array<int>`` with the number of matches of each pattern, in order."""
    g = _guard(patterns)
    return _beside_literals(text, g, lambda t, found: _counts(t, found, g, patterns))


def _counts(text: Column, found: Column, g: Guard, patterns: Sequence[Pattern]) -> Column:
    return F.array(*(F.when(g.might(found, p.regex), count(text, java_of(p))).otherwise(0) for p in patterns))


def pattern_matches(text: Column, patterns: Sequence[Pattern]) -> Column:
    """All matches of all patterns, by pattern, then position."""
    g = _guard(patterns)

    def of(t: Column, literals: Column, p: Pattern) -> Column:
        at, found = positions(t, java_of(p)), extract(t, java_of(p))
        rows = F.transform(found, lambda x, i: F.struct(F.lit(p.id).alias("pattern"), x.alias("matched"), F.get(at, i).alias("position"), F.lit(p.category).alias("category"), F.lit(p.severity).alias("severity")))
        return F.when(g.might(literals, p.regex) & matches(t, java_of(p)), rows).otherwise(F.array().cast(MATCHES))

    return _beside_literals(text, g, lambda t, literals: F.flatten(F.array(*(of(t, literals, p) for p in patterns))))


def _bounded(text: Column, d: Detector) -> Column:
    return F.substring(text, 1, d.max_analysis_length) if d.max_analysis_length < 2**31 - 1 else text


def _scanned(text: Column, d: Detector) -> tuple[Column, Column]:
    bounded = _bounded(text, d)
    use = has_keyword(bounded) if d.use_fast_filter and not d.custom else F.lit(True)
    return bounded, (F.length(text) >= 3) & use


def rank_of(high: Column, medium: Column, medium_flags: Column) -> Column:
    """The suggested risk's rank, from numbers of matches and flags (no flag is of high severity)."""
    return F.when(high >= 2, 3).when((high >= 1) | (medium >= 3) | ((medium >= 2) & (medium_flags >= 1)), 2).when((medium >= 1) | (medium_flags >= 2), 1).otherwise(0)


def name_of(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), rank + 1)


def counts(text: Column, d: Detector = Detector()) -> Column:
    """The cheap part of ``analyze``: numbers of matches by severity and of medium flags, rank and ids, without positions.

    ``struct<high:int,medium:int,low:int,flags:int,rank:int,ids:array<string>>``; ids are those that
    match, one for each match, in catalog order.
    """
    of = {s: [i for i, p in enumerate(d.patterns) if p.severity == s] for s in ("high", "medium", "low")}
    ids = F.array(*(F.lit(p.id) for p in d.patterns))
    none = F.array().cast("array<int>")

    def total(per: Column, severity: str) -> Column:
        return sum((F.get(per, F.lit(i)) for i in of[severity]), F.lit(0))

    g = _guard(d.patterns)

    def scan(x: Column) -> Column:
        use = has_keyword(x["t"]) if d.use_fast_filter and not d.custom else F.lit(True)
        per = F.when((x["size"] >= 3) & use, _counts(x["t"], x["found"], g, d.patterns)).otherwise(none)
        return F.struct(per.alias("per"), F.when(x["size"] >= 3, _structure(x["t"], x["found"], g, x["size"], d)).alias("s"))

    def finish(x: Column) -> Column:
        scanned = F.size(x["per"]) > 0
        high, medium, low = (F.when(scanned, total(x["per"], s)).otherwise(0) for s in ("high", "medium", "low"))
        yes = lambda c: F.when(c, 1).otherwise(0)
        medium_flags = yes(x["s"]["size"] > d.max_field_length) + yes(x["s"]["bits"] > d.entropy_threshold) + yes(x["s"]["nested"])
        hit = F.when(high + medium + low > 0, F.flatten(F.zip_with(x["per"], ids, lambda n, i: F.array_repeat(i, n)))).otherwise(F.array().cast("array<string>"))
        return F.struct(high.alias("high"), medium.alias("medium"), low.alias("low"), (medium_flags + yes(x["s"]["formatted"])).alias("flags"), rank_of(high, medium, medium_flags).alias("rank"), hit.alias("ids"))

    # Each of these is bound once: inside a lambda nothing else would share it.
    text = F.coalesce(text, F.lit(""))
    bound = let(F.struct(_bounded(text, d).alias("t"), F.length(text).alias("size")), lambda x: F.struct(x["t"].alias("t"), x["size"].alias("size"), g.found(x["t"]).alias("found")))
    return let(let(bound, scan), finish)


def analyze(text: Column, d: Detector = Detector()) -> Column:
    """``struct<matches,structural_flags,has_detections,suggested_risk>`` of a text; null and texts below three characters have none."""
    text = F.coalesce(text, F.lit(""))
    bounded, scanned = _scanned(text, d)
    found = F.when(scanned, pattern_matches(bounded, d.patterns)).otherwise(F.array().cast(MATCHES))
    flags = F.when(F.length(text) >= 3, structural_flags(bounded, text, d)).otherwise(F.array().cast(FLAGS))

    def finish(x: Column) -> Column:
        n = lambda a, severity: F.size(F.filter(a, lambda m: m["severity"] == severity))
        rank = rank_of(n(x["matches"], "high"), n(x["matches"], "medium"), n(x["flags"], "medium"))
        any_ = (F.size(x["matches"]) > 0) | (F.size(x["flags"]) > 0)
        return F.struct(x["matches"].alias("matches"), x["flags"].alias("structural_flags"), any_.alias("has_detections"), name_of(rank).alias("suggested_risk"))

    return let(F.struct(found.alias("matches"), flags.alias("flags")), finish)
