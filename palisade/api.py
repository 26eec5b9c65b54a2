"""The engine as one object: settings, scorer and field filter together, over DataFrames or single values."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .config import Config, create_config
from .functions import detect, sanitize
from .operators import sfe, tier2
from .operators.models import Shared, warm
from .operators.payload import render
from .plans.defense import defend, tier1


@dataclass(frozen=True)
class Defense:
    config: Config = Config()
    scorer: Callable[[], tier2.Scorer] | None = None
    predictor: Callable[[], sfe.Predictor | None] | None = None
    sfe_threshold: float = 0.5

    def defend(self, payloads: DataFrame, **columns) -> DataFrame:
        """Verdicts of a DataFrame of payloads, batch or stream."""
        return defend(payloads, self.config, scorer=self.scorer, predictor=self.predictor, sfe_threshold=self.sfe_threshold, **columns)

    def defend_results(self, spark: SparkSession, items: Iterable[dict[str, Any]]) -> list[Row]:
        """Verdicts of values ``{"value", "tool_name"}`` that are in the driver's memory, in their order."""
        rows = [(i, x["tool_name"], render(x["value"])) for i, x in enumerate(items)]
        df = spark.createDataFrame(rows, "payload_id long, tool_name string, payload string")
        return self.defend(df).orderBy("payload_id").collect()

    def defend_result(self, spark: SparkSession, value: Any, tool_name: str) -> Row:
        return self.defend_results(spark, [{"value": value, "tool_name": tool_name}])[0]

    def sanitize_result(self, spark: SparkSession, value: Any, tool_name: str) -> Any:
        """The sanitized value alone."""
        return json.loads(self.defend_result(spark, value, tool_name).sanitized)

    def tier1(self, payloads: DataFrame, **columns) -> DataFrame:
        return tier1(payloads, self.config, **columns)

    def analyze(self, text: Column) -> Column:
        """Tier 1 of a text column."""
        return detect.analyze(text, self.config.detector)

    def sanitize(self, text: Column, risk: Column | str = "medium", **options) -> Column:
        return sanitize.sanitize(text, risk, **options)

    def classify(self, df: DataFrame, text: str = "text", by: str = "whole") -> DataFrame:
        """Tier 2 of a text column: by whole text, sentence or chunks."""
        if self.scorer is None:
            raise ValueError("no scorer")
        return tier2.classify(df, self.scorer, text, by, self.config.tier2)

    def is_injection(self, result: Column | str = "tier2", threshold: float | None = None) -> Column:
        return tier2.is_injection(F.col(result) if isinstance(result, str) else result, threshold, self.config.tier2)

    def is_ready(self) -> bool:
        """Whether the scorer can be made here, as each worker will make it; without a scorer there is nothing to wait for."""
        try:
            if self.scorer is not None:
                self.scorer()
        except Exception:
            return False
        return True

    def warmup(self, spark: SparkSession) -> bool:
        """Loads the scorer and the field filter in the workers ahead of the first payloads; whether each core's task could."""
        wanted = [make for make in (self.scorer, self.predictor) if make is not None]
        return all(warm(spark, make) == spark.sparkContext.defaultParallelism for make in wanted)

    def is_loaded(self) -> bool:
        """Whether this process holds the scorer's model; a scorer without a shared model has nothing to load."""
        return self.scorer is not None and (self.scorer.is_loaded() if isinstance(self.scorer, Shared) else True)

    def get_config(self) -> dict[str, Any]:
        """All settings by name, nested, as plain values."""
        return dataclasses.asdict(self.config)

    def with_pattern(self, pattern: detect.Pattern) -> Defense:
        """The same defence with one more pattern; the keyword filter stays on."""
        return dataclasses.replace(self, config=dataclasses.replace(self.config, detector=self.config.detector.add_pattern(pattern)))


def create_defense(scorer: Callable[[], tier2.Scorer] | None = None, predictor: Callable[[], sfe.Predictor | None] | None = None, sfe_threshold: float = 0.5, **overrides) -> Defense:
    """Defaults with overrides, as ``create_config`` takes them."""
    return Defense(create_config(**overrides), scorer, predictor, sfe_threshold)
