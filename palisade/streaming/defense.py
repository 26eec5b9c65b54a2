"""The defence as a stream: the same plan, as nothing in it crosses payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..plans.defense import defend


def defend_stream(payloads: DataFrame, path: str, checkpoint: str, config: Config = Config(), kind: str = "parquet", available_now: bool = False, **options) -> StreamingQuery:
    """Writes the verdicts of a stream of payloads; exactly once with a file sink and its checkpoint."""
    writer = defend(payloads, config, **options).writeStream.format(kind).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def risk_counts(verdicts: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Verdicts by risk in tumbling windows of event time; state is dropped once the watermark has passed."""
    return verdicts.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "risk_level").agg(F.count("*").alias("payloads"), F.count_if(~F.col("allowed")).alias("blocked"))
