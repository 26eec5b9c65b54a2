"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be broadcast; every caller has a shuffled way beyond it.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets a folder under /tmp."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file:///tmp/palisade-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors.

    The table goes when the driver exits. It has no marker of success: a write that fails raises, and none
    reads a table before its write has ended. (Hadoop's local file system starts processes for each file it makes.)
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def arrow_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Bound what goes to a Python worker at once, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def octets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and UTF-8 bytes of a string or binary column, from 0; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each has at most ``most`` bytes in ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at, _ = octets(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def text_key(text: str = "text"):
    """64 bits that, beside the id, tell rows with equal ids apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def in_order(df: DataFrame, prefix: str = ""):
    """An order of rows with equal ids and texts by all their columns, so that reruns choose the same one; ``prefix`` names the struct they are in."""
    plain = [F.col(f"{prefix}`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    return [F.xxhash64(*plain), F.hash(*plain)] if plain else [F.lit(0)]
