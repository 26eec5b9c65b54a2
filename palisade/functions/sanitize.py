"""The composite sanitizer: what a risk level, or a list of methods, does to a text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog, encoding
from .detect import name_of
from .regex import let
from .text import contains_role_markers, fold_lookalikes, nfkc, normalize, remove_patterns, strip_role_markers, suspicious_unicode, wrap

BLOCKED = "[CONTENT BLOCKED FOR SECURITY]"
METHODS = ("unicode_normalization", "boundary_annotation", "role_stripping", "pattern_removal", "encoding_detection")
_NONE = "array<string>"


def _result(text: Column, methods: Column, removed: Column, risk: Column) -> Column:
    return F.struct(text.alias("sanitized"), methods.alias("methods_applied"), removed.alias("patterns_removed"), risk.alias("risk_level"))


def _fired(text: Column, fired: Column, ids: Column | None = None) -> Column:
    return F.struct(text.alias("text"), fired.alias("fired"), (F.lit(None).cast(_NONE) if ids is None else ids).alias("ids"))


def _step(state: Column, on: Column, run, method: str) -> Column:
    """One stage over an array of one struct ``t, m, ids``: ``run`` where ``on`` holds, its method noted if it fired."""
    ran = F.transform(state, lambda x: F.struct(x.alias("s"), F.when(on, run(x["t"])).alias("r")))

    def merge(y: Column) -> Column:
        noted = F.when(y["r"]["fired"], F.array_append(y["s"]["m"], F.lit(method))).otherwise(y["s"]["m"])
        new = F.struct(y["r"]["text"].alias("t"), noted.alias("m"), F.coalesce(y["r"]["ids"], y["s"]["ids"]).alias("ids"))
        return F.when(y["r"].isNull(), y["s"]).otherwise(new)

    return F.transform(ran, merge)


def _roles(text: Column) -> Column:
    return let(contains_role_markers(text), lambda has: _fired(F.when(has, strip_role_markers(text)).otherwise(text), has))


def _patterns(risk: Column, redaction: str):
    """All patterns at high risk, those of high severity at medium: one fold, as a second would double the plan."""
    active = lambda p: risk.isin("medium", "high") if p.severity == "high" else risk == "high"
    return lambda text: let(remove_patterns(text, None, redaction, active), lambda done: _fired(done["text"], F.size(done["patterns_removed"]) > 0, done["patterns_removed"]))


def _hidden(redaction: str):
    def run(text: Column) -> Column:
        def judge(found: Column) -> Column:
            bad = F.exists(found, lambda d: d["suspicious"])
            return _fired(F.when(bad, encoding.rewrite(text, found, redaction)).otherwise(text), bad)

        return let(encoding.detections(text), judge)

    return run


def sanitize_normalized(text: Column, normal: Column, risk: Column, boundary: Column | None = None, redaction: str = "[REDACTED]", encoding_redaction: str = "[ENCODED DATA]", always_normalize: bool = True, always_annotate: bool = True) -> Column:
    """``sanitize`` for a text whose normal form is at hand: all native."""
    low, medium, high = (risk == r for r in ("low", "medium", "high"))
    text = F.coalesce(text, F.lit(""))
    use_normal = F.lit(True) if always_normalize else ~low
    start = F.when(use_normal, F.coalesce(normal, F.lit(""))).otherwise(text)
    none = F.array().cast(_NONE)
    state = F.array(F.struct(start.alias("t"), F.when(use_normal & (start != text), F.array(F.lit(METHODS[0]))).otherwise(none).alias("m"), none.alias("ids")))
    state = _step(state, medium | high, _roles, METHODS[2])
    state = _step(state, medium | high, _patterns(risk, redaction), METHODS[3])
    state = _step(state, high, _hidden(encoding_redaction), METHODS[4])
    if boundary is not None:
        state = _step(state, F.lit(True) if always_annotate else ~low, lambda t: _fired(wrap(t, boundary), F.lit(True)), METHODS[1])
    done = F.get(F.transform(state, lambda x: _result(x["t"], x["m"], x["ids"], risk)), F.lit(0))
    blocked, empty = _result(F.lit(BLOCKED), none, none, risk), _result(F.lit(""), none, none, risk)
    return F.when(F.length(text) == 0, empty).when(risk == "critical", blocked).otherwise(done)


def sanitize(text: Column, risk: Column | str, boundary: Column | None = None, methods: Sequence[str] = (), **options) -> Column:
    """``struct<sanitized,methods_applied,patterns_removed,risk_level>``.

    Empty or null text stays empty, critical text is blocked. With ``methods`` those run in order,
    whatever the risk. Else: normal form always; role markers from medium on; patterns of high
    severity at medium, all at high; suspicious encodings at high; the boundary if one is given.
    """
    risk = F.lit(risk) if isinstance(risk, str) else risk
    if not methods:
        return sanitize_normalized(text, fold_lookalikes(nfkc(F.coalesce(text, F.lit("")))), risk, boundary, **options)
    raw, none = F.coalesce(text, F.lit("")), F.array().cast(_NONE)
    state_of = lambda t, m, ids: F.array(F.struct(t.alias("t"), m.alias("m"), ids.alias("ids")))
    always = F.lit(True)
    runs = {
        METHODS[1]: lambda t: _fired(wrap(t, boundary), always),
        METHODS[2]: lambda t: _fired(strip_role_markers(t), always),
        METHODS[3]: lambda t: let(remove_patterns(t), lambda done: _fired(done["text"], always, done["patterns_removed"])),
        METHODS[4]: lambda t: let(encoding.detections(t), lambda found: _fired(encoding.rewrite(t, found), always)),
    }
    state = state_of(raw, none, none)
    for i, method in enumerate(methods):
        if method == METHODS[0]:  # a UDF, which can't stand inside the stages
            now = F.get(state, F.lit(0))
            state = state_of(normalize(raw if i == 0 else now["t"]), F.array_append(none if i == 0 else now["m"], F.lit(method)), none if i == 0 else now["ids"])
        elif method != METHODS[1] or boundary is not None:
            state = _step(state, always, runs[method], method)
    done = F.get(F.transform(state, lambda x: _result(x["t"], x["m"], x["ids"], risk)), F.lit(0))
    blocked, empty = _result(F.lit(BLOCKED), none, none, risk), _result(F.lit(""), none, none, risk)
    return F.when(F.length(raw) == 0, empty).when(risk == "critical", blocked).otherwise(done)


def sanitize_light(text: Column, **options) -> Column:
    return sanitize(text, "low", **options)["sanitized"]


def sanitize_default(text: Column, **options) -> Column:
    return sanitize(text, "medium", **options)["sanitized"]


def sanitize_aggressive(text: Column, **options) -> Column:
    return sanitize(text, "high", **options)["sanitized"]


def suggest_risk(text: Column) -> Column:
    """A risk level by points: unicode 1, role markers 2, suspicious encodings 2, each phrase 2."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    points = F.when(suspicious_unicode(text)["has_suspicious"], 1).otherwise(0) + F.when(contains_role_markers(text), 2).otherwise(0) + F.when(encoding.contains_suspicious(text), 2).otherwise(0)
    for phrase in catalog.RISK_PHRASES:
        points = points + F.when(F.contains(low, F.lit(phrase)), 2).otherwise(0)
    return name_of(F.when(points >= 6, 3).when(points >= 4, 2).when(points >= 2, 1).otherwise(0))
