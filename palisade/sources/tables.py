"""Sources and sinks of payloads: Parquet, JSON lines and text, batch or stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOADS = T.StructType([T.StructField("payload_id", T.LongType()), T.StructField("tool_name", T.StringType()), T.StructField("payload", T.StringType())])


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files are too small to give each of them a split: a table of one row group is one task otherwise.

    Tables with as many splits as cores, by the optimizer's estimate of their size, stay as they are.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * split else df


def read_payloads(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType = PAYLOADS) -> DataFrame:
    """Rows of payload id, tool name and JSON payload. Columns are pruned and filters pushed by the reader."""
    return spark.read.schema(schema).format(kind).load(path)


def stream_payloads(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType = PAYLOADS, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def payloads_of(df: DataFrame, ident: str, tool: str, fields: list[str]) -> DataFrame:
    """Payloads from columns of any type: one JSON object per row, null fields kept."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return df.select(F.col(ident).alias("payload_id"), F.lit(tool).alias("tool_name"), body.alias("payload"))


def write_verdicts(df: DataFrame, path: str, kind: str = "parquet", partition_by: str = "risk_level") -> None:
    """Verdicts by risk level, so that a reader of blocked ones scans those alone."""
    df.write.mode("errorifexists").partitionBy(partition_by).format(kind).save(path)
