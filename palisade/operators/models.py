"""Models that are loaded once in each worker process, and Arrow batches of a bounded size."""

from __future__ import annotations

import threading
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: What goes to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20

_LOADED: dict[Hashable, Any] = {}
_LOCKS: dict[Hashable, threading.Lock] = {}
_GUARD = threading.Lock()


@dataclass(frozen=True)
class Shared:
    """A factory whose product is kept for the life of the process under ``key``: tasks that follow in the same worker get the same one.

    A failure, or None, is not kept: the next call tries again.
    """

    key: Hashable
    make: Callable[[], Any] = field(compare=False)

    def __call__(self) -> Any:
        with _GUARD:
            lock = _LOCKS.setdefault(self.key, threading.Lock())
        with lock:
            if _LOADED.get(self.key) is None:
                _LOADED[self.key] = self.make()
            return _LOADED[self.key]

    def is_loaded(self) -> bool:
        """Whether this process has it."""
        return _LOADED.get(self.key) is not None


def warm(spark: SparkSession, make: Callable[[], Any]) -> int:
    """Makes the product in workers, one task for each core, and returns how many tasks could."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                ok = make() is not None
            except Exception:
                ok = False
            yield pa.RecordBatch.from_arrays([pa.array([ok] * batch.num_rows)], ["ok"])

    cores = spark.sparkContext.defaultParallelism
    return spark.range(0, cores, 1, cores).mapInArrow(run, "ok boolean").filter("ok").count()


def bounded(df: DataFrame) -> DataFrame:
    """``df``; its session sends Python workers Arrow batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes at most, or one row.

    Spark's own bounds are 10,000 rows and 64 MB, and a worker holds a batch, its Python objects and the results at
    once: with these, its memory grows with the rows of its task up to there. Lower settings stay.
    """
    spark = df.sparkSession
    size_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, of in (("maxRecordsPerBatch", BATCH_ROWS, int), ("maxBytesPerBatch", BATCH_BYTES, size_of)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < of(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return df


def pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, halved until each has at most ``most`` bytes, or one row."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            half = part.num_rows // 2
            if half and part.nbytes > most:
                todo += [part.slice(half), part.slice(0, half)]
            elif part.num_rows:
                yield part
