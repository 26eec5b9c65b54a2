"""Settings: immutable, resolved on the driver; their values enter plans as literals."""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from .functions.detect import Detector

# Keys that are removed, depth of the walks that aren't tier 1's, keys that hold data, and keys that mark pages of it.
DANGEROUS_KEYS = ("__proto__", "constructor", "prototype")
MAX_WALK_DEPTH = 100
DATA_KEYS = ("data", "results", "items", "records")
PAGE_KEYS = ("next", "previous", "nextPage", "prevPage", "pagination", "page", "total", "totalCount", "hasMore", "cursor")

# Names of fields that are scanned, endings of such names, and the names for tools that have their own.
FIELD_NAMES = ("name", "description", "content", "title", "notes", "summary", "bio", "body", "text", "message", "comment", "subject")
FIELD_PATTERNS = ("_name$", "_description$", "_content$", "_body$", "_notes$", "_summary$", "_bio$", "_text$", "_message$", "_title$")
TOOL_OVERRIDES = {
    "documents_*": ("name", "description", "content", "title"),
    "hris_*": ("name", "notes", "bio", "description"),
    "ats_*": ("name", "notes", "description", "summary"),
    "crm_*": ("name", "description", "notes", "content"),
    "gmail_*": ("subject", "body", "snippet", "content"),
    "email_*": ("subject", "body", "snippet", "content"),
    "github_*": ("name", "description", "body", "content", "message", "title"),
}


@dataclass(frozen=True)
class RiskyFields:
    field_names: tuple[str, ...] = FIELD_NAMES
    field_patterns: tuple[str, ...] = FIELD_PATTERNS
    tool_overrides: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(TOOL_OVERRIDES))

    def override(self, tool: str) -> Sequence[str] | None:
        """The names for a tool: its own entry, else the first wildcard that fits, else None."""
        if tool in self.tool_overrides:
            return self.tool_overrides[tool]
        return next((names for p, names in self.tool_overrides.items() if "*" in p and wildcard(tool, p)), None)

    def risky(self, name: str, tool: str) -> bool:
        own = self.override(tool)
        if own is not None:
            return name in own
        return name in self.field_names or any(re.search(p, name) for p in self.field_patterns)


def wildcard(tool: str, pattern: str) -> bool:
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), tool, re.S) is not None


@dataclass(frozen=True)
class Traversal:
    max_depth: int = 10
    max_size: int = 10 * 1024 * 1024
    large_array_threshold: int = 1000
    skip_large_arrays: bool = True


@dataclass(frozen=True)
class Cumulative:
    medium: int = 3
    high: int = 1
    patterns: int = 3
    medium_fraction: float = 0.25
    patterns_fraction: float = 0.25


@dataclass(frozen=True)
class Tier2:
    """``high_risk_threshold`` grades scores; ``threat_threshold`` decides whether a score alone is a threat."""

    high_risk_threshold: float = 0.8
    medium_risk_threshold: float = 0.5
    threat_threshold: float = 0.8
    min_text_length: int = 10
    max_text_length: int = 10_000
    tier2_fields: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Config:
    risky_fields: RiskyFields = RiskyFields()
    traversal: Traversal = Traversal()
    cumulative: Cumulative = Cumulative()
    tier2: Tier2 = Tier2()
    detector: Detector = Detector()
    block_high_risk: bool = False
    default_risk_level: str = "medium"
    enable_tier1: bool = True
    annotate: bool = True
    boundary_salt: str = ""


def create_config(**overrides) -> Config:
    """The defaults with overrides. A mapping for a part replaces its settings of known names (unknown ones are
    left out, lists are replaced); an object replaces the part."""
    base, out = Config(), {}
    for name, value in overrides.items():
        part = getattr(base, name)
        if isinstance(value, Mapping) and dataclasses.is_dataclass(part):
            known = {f.name for f in dataclasses.fields(part)}
            value = dataclasses.replace(part, **{k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in known})
        out[name] = value
    return dataclasses.replace(base, **out)
