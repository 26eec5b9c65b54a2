"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, mix of sources.

Each stage takes all rows that the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, langid, mixing, neardup, pii
from palisade.llm.common import cut, table
from palisade.llm.queries import pii_key

#: Texts of whose n-grams their best language has less than this share are in no known language.
LEAST_KNOWN = 0.3


def _beside(docs: DataFrame, added: tuple[str, ...], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that ``step`` leaves, without the columns it adds; columns of ``docs`` with such names keep their values."""
    own = {c: f"{c}__own" for c in docs.columns if c in added}
    left = step(docs.withColumnsRenamed(own)).drop(*added)
    return left.withColumnsRenamed({new: c for c, new in own.items()}).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null ones, and those in no learned language."""
    model = langid.train(docs)
    known = lambda df: langid.identify(df, model).filter((F.col("lang_pred") != "und") & (F.col("known") >= LEAST_KNOWN))
    return _beside(docs, ("lang_pred", "score", "known"), known)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group, the one with the smallest id."""
    return neardup.dedup(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a benchmark window, however long it is: one in 20 words would let long ones pass."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), any_hit=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; ``n_chars`` follows the text."""
    size = F.when(F.col("n_entities") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return _beside(docs, ("n_entities", "pii"), lambda df: pii.pseudonymize(df, pii_key(spark)).withColumn("n_chars", size))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    return mixing.mix(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]

#: SQL can express neither the language filter nor the keyed surrogates nor the drawn mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
