"""A PySpark engine that defends against hostile content in payloads and texts."""

from importlib import import_module
from typing import Any

_HOMES = {
    "api": ("Defense", "create_defense"),
    "config": ("Config", "create_config"),
    "functions.catalog": ("PATTERNS", "Pattern", "by_category", "by_severity"),
    "operators.sfe": ("DropDecision", "Predictor", "filter_value", "trained_predictor"),
    "operators.tier2": ("Scorer", "onnx_scorer"),
    "plans.defense": ("defend",),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str) -> Any:
    """Names are imported when they are first used: workers that need one module don't load them all."""
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
