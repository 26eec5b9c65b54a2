"""Importance resampling towards target text: hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, cut, octets, portions

#: Buckets of hashed uni- and bigrams.
BUCKETS = 1 << 14
#: A-Z to a-z; separators of words are the space and tab to return.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[32, 9, 10, 11, 12, 13]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_spans(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, none across texts, and the number of words before each text."""
    is_word = ~_BREAK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a random-valued polynomial, by differences of prefix sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_MULTIPLIER, len(data)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value ^ (value >> np.uint64(32))


def gram_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all uni- and bigrams of each text, and the number of n-grams before each text."""
    at, data = octets(column)
    data = _FOLD[data]
    starts, ends, first = word_spans(at, data)
    words = span_hashes(data, starts, ends)
    n = np.diff(first)
    grams = np.zeros(2 * len(words), np.uint64)
    grams[0::2] = words
    if len(words):
        grams[1:-1:2] = words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:] * np.uint64(3)
    # The last word of a text starts no bigram: its place is dropped.
    keep = np.ones(len(grams), bool)
    keep[2 * first[1:][n > 0] - 1] = False
    mixed = grams[keep] * _MULTIPLIER
    return (mixed >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(2 * n - 1, 0))])


def _models(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets over all texts, and over those whose id is in ``target`` (broadcast: its size is bounded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in portions(batches, "_text", 1 << 20):
            found, first = gram_buckets(batch.column(0), buckets)
            raw += np.bincount(found, minlength=buckets)
            own = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(first))
            good += np.bincount(found[own], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])

    marked = docs.join(F.broadcast(target.select(F.col("id").alias("_id")).withColumn("_good", F.lit(True))), F.col(id_col) == F.col("_id"), "left")
    counts = marked.select(F.col(text_col).alias("_text"), F.coalesce("_good", F.lit(False)).alias("_good")).mapInArrow(run, "bucket long, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # a row for each bucket
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, g in rows:
        raw[bucket], good[bucket] = r, g
    return raw, good


def threshold(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, by counting ever narrower ranges; no sort, nothing of the size of the table on the driver."""
    low, high, left = keys.agg(F.min(column), F.max(column)).first()[:2] + (k,)
    if low is None or k < 1:
        return None
    while low < high:
        width = (high - low) / 1024
        if width == 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).cast("int")
        inside = keys.filter(F.col(column).between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for row in sorted(inside, key=lambda r: -r.cell):
            if row.n >= left:
                low, high = row.low, row.high
                break
            left -= row.n
    return low


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", target_rows: int = 20_000, smooth: float = 1.0, temper: int | None = None, buckets: int = BUCKETS, seed: int = 23) -> DataFrame:
    """Every row with ``n_grams, log_weight, quality_score, gumbel_key``.

    Two bag-of-n-grams models (words and word pairs, hashed to ``buckets``): one of all texts, one of
    the target, which is the ``target_rows`` labelled rows of quality 1 and not toxic with the
    smallest keyed hash of the id (the classifier's bounded sample). ``log_weight`` is the log ratio of
    the text's probability under the target to that under the raw model, ``quality_score`` its mean
    per n-gram through the logistic function, and ``gumbel_key`` the log weight plus Gumbel noise drawn
    from the id: the top k keys are a sample without replacement by weight. With ``temper``,
    the log weight of a text of more n-grams than that is scaled to that many. Null and empty text has no
    n-gram and log weight 0. Equal ids and texts have equal noise. Labels of null ids, or null labels,
    are no target; without a target all weights are 0.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    good = labels.filter((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    target = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(target_rows)
    raw, wanted = _models(docs, target, id_col, text_col, buckets)
    if wanted.sum():
        ratio = np.log((wanted + smooth) / (wanted.sum() + smooth * buckets)) - np.log((raw + smooth) / (raw.sum() + smooth * buckets))
    else:
        ratio = np.zeros(buckets)
    shared = spark.sparkContext.broadcast(ratio)
    added = ("n_grams", "log_weight", "quality_score", "gumbel_key")
    keep = [c for c in docs.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in portions(batches, "_text", 1 << 20):
            found, first = gram_buckets(batch.column(batch.num_columns - 2), len(ratio))
            # Sums by text, each on its own: prefix sums would carry rounding from one text to the next.
            n = np.diff(first)
            sums, some = np.zeros(len(n)), n > 0
            if some.any():
                sums[some] = np.add.reduceat(ratio[found], first[:-1][some])
            mean = np.divide(sums, n, out=np.zeros(len(n)), where=some)
            if temper is not None:
                sums = mean * np.minimum(n, temper)
            uniform = (batch.column(batch.num_columns - 1).to_numpy().view(np.uint64) >> np.uint64(11)).astype(float) / 2.0**53
            noise = -np.log(-np.log(np.clip(uniform, 2.0**-54, 1 - 2.0**-53)))
            new = [pa.array(n.astype(np.int64)), pa.array(sums), pa.array(1 / (1 + np.exp(-mean))), pa.array(sums + noise)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *new], [*keep, *added])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_grams", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in added[1:])])
    draw = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(*keep, F.col(text_col).alias("_text"), draw.alias("_draw")).mapInArrow(run, schema)


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.75, **options) -> DataFrame:
    """``weigh``'s rows with ``kept``: whether the row is among the ``share`` of all rows with the largest keys.

    Rows that tie with the last one kept are kept too, so that repeated rows fare alike. The rows
    are written to the shared folder once, without the text unless ``docs`` has other columns to keep.
    """
    rows = cut(weigh(docs, labels, **options))
    k = int(np.ceil(share * rows.count()))
    least = threshold(rows.select("gumbel_key"), "gumbel_key", k)
    return rows.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))
