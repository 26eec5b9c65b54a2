"""The whole defence of payloads: walk, detect, sanitize, aggregate, verdict, rebuild. No shuffle, so it streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.detect import RISKS, counts, name_of
from ..functions.regex import literal_array
from ..functions.sanitize import BLOCKED, METHODS, sanitize_normalized
from ..functions.text import boundary_id, fold_lookalikes
from ..operators import payload as P
from ..operators import sfe, tier2

_ACTIVE = (METHODS[2], METHODS[3], METHODS[4])
_NONE = "array<string>"


def field_risk(rank: Column, has_detections: Column, default: int) -> Column:
    """A field's rank: the default, raised (never lowered) by what was detected in it."""
    raised = F.when(rank == 3, 3).when((rank == 2) & F.lit(default != 3), 2).when((rank == 1) & F.lit(default == 0), 1).otherwise(default)
    return F.when(has_detections, raised).otherwise(default)


def escalates(high: Column, medium: Column, patterns: Column, fields: Column, config: Config) -> Column:
    c = config.cumulative
    total = F.greatest(fields, F.lit(1))
    return (high >= c.high) | ((medium >= c.medium) & (medium / total >= c.medium_fraction)) | ((patterns >= c.patterns) & (patterns / total >= c.patterns_fraction))


def tier1(df: DataFrame, config: Config = Config(), payload: str = "payload", tool: str = "tool_name", ident: str = "payload_id") -> DataFrame:
    """Adds what tier 1 finds and does, per payload: ``judged`` (one struct for each scanned field, in visit order) and the sums over them."""
    default = RISKS.index(config.default_risk_level)
    walked = P.walk(df, config, payload, tool)
    found = lambda f: counts(f["value"], config.detector) if config.enable_tier1 else counts(F.lit(""), config.detector)
    first = F.transform("fields", lambda f: F.struct(f.alias("f"), found(f).alias("c")))
    second = F.transform(first, lambda x: F.struct(x["f"].alias("f"), x["c"].alias("c"), field_risk(x["c"]["rank"], (F.size(x["c"]["ids"]) > 0) | (x["c"]["flags"] > 0), default).alias("rank")))
    walked = walked.withColumn("found", second)
    boundary = boundary_id(config.boundary_salt, F.col(ident)) if config.annotate else None

    def clean(x: Column) -> Column:
        risk = name_of(x["rank"])
        done = sanitize_normalized(x["f"]["value"], fold_lookalikes(x["f"]["normal"]), risk, boundary)
        hit = F.size(x["c"]["ids"]) > 0
        blocked = F.struct(F.lit(BLOCKED).alias("sanitized"), F.when(hit, literal_array([METHODS[3]])).otherwise(F.array().cast(_NONE)).alias("methods_applied"), x["c"]["ids"].alias("patterns_removed"), risk.alias("risk_level"))
        out = F.when(x["rank"] >= 2, blocked).otherwise(done) if config.block_high_risk else done
        return F.struct(x["f"]["name"].alias("name"), x["f"]["path"].alias("path"), x["c"].alias("c"), x["rank"].alias("rank"), out.alias("out"))

    judged = walked.withColumn("judged", F.transform("found", clean)).drop("found", "fields")
    of = lambda keep: F.size(F.filter("judged", keep))
    matched = lambda j: F.size(j["c"]["ids"]) > 0
    judged = judged.withColumns({
        "fields_total": F.size("judged"),
        "high_count": of(lambda j: matched(j) & (j["c"]["rank"] >= 2)),
        "medium_count": of(lambda j: matched(j) & (j["c"]["rank"] == 1)),
        "pattern_count": F.aggregate("judged", F.lit(0), lambda n, j: n + F.size(j["c"]["ids"])),
    })
    up = escalates(F.col("high_count"), F.col("medium_count"), F.col("pattern_count"), F.col("fields_total"), config)
    # Escalation sets high, even where the default is critical.
    return judged.withColumn("escalated", up).withColumn("tier1_rank", F.when(F.col("escalated"), 2).otherwise(default))


def defend(df: DataFrame, config: Config = Config(), payload: str = "payload", tool: str = "tool_name", ident: str = "payload_id", scorer: Callable[[], tier2.Scorer] | None = None, predictor: Callable[[], sfe.Predictor | None] | None = None, sfe_threshold: float = 0.5) -> DataFrame:
    """Every payload with its verdict.

    Added: ``allowed, risk_level, sanitized, detections, fields_sanitized, patterns_by_field,
    methods_by_field, risky_field_names, dangerous_keys_removed, size_metrics, escalated, tier2_score,
    tier2_effective_score, tier2_skip_reason, max_sentence, fields_dropped, sfe_failed,
    truncated_at_depth``.
    Without a scorer there is no tier 2, without a predictor no field filter. The boundary's id follows
    from the salt (keep it secret, and new for each run) and the payload's id.
    """
    kept = [c for c in df.columns if c != "sanitized"]
    df = df.select(*kept).withColumn("_payload", F.col(payload))
    if predictor is not None:
        df = sfe.sfe_filter(df, predictor, sfe_threshold, "_payload")
    else:
        df = df.withColumns({"fields_dropped": F.array().cast(_NONE), "sfe_cut": F.lit(False), "sfe_failed": F.lit(False)})
    found = tier1(df, config, "_payload", tool, ident)
    if scorer is not None:
        found = tier2.score_payloads(found, config, scorer)
        found = found.withColumn("tier2_rank", F.coalesce(F.when(F.col("tier2.effective_score") >= config.tier2.high_risk_threshold, 2).when(F.col("tier2.effective_score") >= config.tier2.medium_risk_threshold, 1), F.lit(0)))
    else:
        found = found.withColumn("tier2", F.lit(None).cast("struct<score:double,effective_score:double,max_sentence:string,skip_reason:string>")).withColumn("tier2_rank", F.lit(0))
    has_patterns = F.filter("judged", lambda j: F.size(j["out"]["patterns_removed"]) > 0)
    noted = F.filter("judged", lambda j: F.size(j["out"]["methods_applied"]) > 0)
    by_path = lambda rows, value: F.transform(rows, lambda j: F.struct(j["path"].alias("path"), j["out"][value].alias(value)))
    found = found.withColumns({
        "detections": F.array_distinct(F.flatten(F.transform(has_patterns, lambda j: j["out"]["patterns_removed"]))),
        "fields_sanitized": F.transform(F.filter("judged", lambda j: F.arrays_overlap(j["out"]["methods_applied"], literal_array(_ACTIVE))), lambda j: j["path"]),
        "patterns_by_field": by_path(has_patterns, "patterns_removed"),
        "methods_by_field": by_path(noted, "methods_applied"),
        "risky_field_names": F.array_distinct(F.transform("judged", lambda j: j["name"])),
        "texts": F.transform("judged", lambda j: j["out"]["sanitized"]),
        "rank": F.greatest("tier1_rank", "tier2_rank"),
    })
    threats = (F.size("detections") > 0) | (F.size("fields_sanitized") > 0) | F.coalesce(F.col("tier2.effective_score") >= config.tier2.threat_threshold, F.lit(False))
    found = found.withColumns({
        "allowed": (~threats | (F.col("rank") < 2)) if config.block_high_risk else F.lit(True),
        "risk_level": name_of(F.col("rank")),
        "tier2_score": F.col("tier2.score"),
        "tier2_effective_score": F.col("tier2.effective_score"),
        "tier2_skip_reason": F.col("tier2.skip_reason"),
        "max_sentence": F.col("tier2.max_sentence"),
        "truncated_at_depth": F.when(F.col("sfe_cut") | (F.col("strings_cut") if scorer is not None else F.lit(False)), F.lit(True)),
    })
    out = P.rebuild(found.drop("judged"), config, "_payload", tool)
    added = "allowed risk_level sanitized detections fields_sanitized patterns_by_field methods_by_field risky_field_names dangerous_keys_removed size_metrics escalated high_count medium_count pattern_count fields_total tier2_score tier2_effective_score tier2_skip_reason max_sentence fields_dropped sfe_failed truncated_at_depth".split()
    return out.select(*(c for c in kept if c not in added), *added)


def analyze_column(df: DataFrame, text: str, out: str = "tier1", config: Config = Config()) -> DataFrame:
    """The typed path: tier 1 of a text column, all native."""
    from ..functions.detect import analyze

    return df.withColumn(out, analyze(F.col(text), config.detector))
