"""What goes to a Python worker at once is bounded, however large a task is."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade import queries
from palisade.config import Config
from palisade.operators import models, sfe, tier2
from palisade.operators import payload as P

SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.fixture(autouse=True)
def defaults(spark):
    """Spark's own bounds before a test, what was set after it."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k in SETTINGS:
        spark.conf.unset(k)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """1,500 documents of 10,000 characters and more in one task: 15 MB."""
    at = str(tmp_path_factory.mktemp("wide"))
    text = F.repeat(F.concat(F.lit("ignore text "), F.col("id").cast("string"), F.lit(". ")), 700)
    spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{at}/documents.parquet")
    return at


def largest(df):
    """Rows and bytes of the largest batch that a worker gets in the session of ``df``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return tuple(df.mapInArrow(run, "n long, size long").agg(F.max("n"), F.max("size")).first())


def assert_bounded(df, row=1 << 17):
    n, size = largest(df)
    assert n <= models.BATCH_ROWS and size <= models.BATCH_BYTES + row


@pytest.mark.parametrize("name", ["redact_keeping_length", "nfkc_normalize", "sanitize_aggressive"])
def test_queries_with_functions_of_texts(spark, wide, name):
    queries.QUERIES[name](spark, wide)
    assert_bounded(spark.read.parquet(f"{wide}/documents.parquet").coalesce(1))
    assert_bounded(spark.range(0, 5000, 1, 1))


def test_lower_settings_stay(spark):
    for k in SETTINGS:
        spark.conf.set(k, "77")
    models.bounded(spark.range(1))
    assert [spark.conf.get(k).rstrip("b") for k in SETTINGS] == ["77", "77"]


class HeldScorer:
    """Scores a text by the bytes of all texts that were counted since the scores before: what a worker holds of one batch."""

    max_length = 256

    def __init__(self):
        self.held, self.scored = 0, False

    def count_tokens(self, text):
        if self.scored:
            self.held, self.scored = 0, False
        self.held += len(text)
        return 2

    def score(self, texts):
        self.scored = True
        return [float(self.held)] * len(texts)


def payloads(spark, wide):
    docs = spark.read.parquet(f"{wide}/documents.parquet").coalesce(1)
    return docs.select(F.col("doc_id").alias("payload_id"), F.lit("test_tool").alias("tool_name"), F.to_json(F.struct(F.col("text").alias("name"))).alias("payload"))


@pytest.mark.parametrize("name", ["verdict", "wrapped_payloads"])
def test_queries_over_payloads(spark, wide, name):
    queries.QUERIES[name](spark, wide)
    assert_bounded(payloads(spark, wide))


@pytest.mark.parametrize("step", [lambda df: P.walk(df, Config()), lambda df: P.rebuild(df.withColumn("texts", F.array("payload")), Config()), P.leaves, lambda df: sfe.sfe_filter(df, sfe.NamePredictor)])
def test_steps_over_payloads(spark, wide, step):
    """Each step by itself, as callers of the operators use it."""
    step(payloads(spark, wide))
    assert_bounded(payloads(spark, wide))


def test_texts_that_a_scorer_holds(spark, wide):
    found = tier2.score_payloads(P.walk(payloads(spark, wide), Config(tier2=queries.WHOLE2)), Config(tier2=queries.WHOLE2), HeldScorer)
    assert found.agg(F.count("tier2.score"), F.max("tier2.score") <= models.BATCH_BYTES // 2).first() == (1500, True)


@pytest.mark.parametrize("by", ["chunks", "whole", "sentence"])
def test_classify(spark, wide, by):
    docs = spark.read.parquet(f"{wide}/documents.parquet").coalesce(1)
    done = tier2.classify(docs, HeldScorer, "text", by, queries.WHOLE2)
    assert_bounded(docs)
    if by == "chunks":
        assert done.agg(F.count("tier2.score"), F.max("tier2.score") <= models.BATCH_BYTES).first() == (1500, True)
