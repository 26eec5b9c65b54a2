import re
from collections import defaultdict

from pyspark.sql import functions as F

from palisade.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, capped, the excess dealt out again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        share = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in order} if free else {s: most * sizes[s] for s in order}
        over = {s for s in order if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_and_copies(docs, rows):
    got = mixing.assign_copies(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += words(t)
    want, taken = targets(sizes), defaultdict(int)
    largest = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert sorted(r.size for r in got) == sorted(words(t) for _, t, *_ in rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_reruns_agree(docs):
    key = lambda df: sorted(map(str, df.collect()))
    assert key(mixing.assign_copies(docs)) == key(mixing.assign_copies(docs.repartition(3)))


def test_caps(spark):
    df = spark.createDataFrame([(i, "w " * (1 if i < 5 else 100), "a" if i < 5 else "b") for i in range(20)], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.assign_copies(df).collect()}
    assert got == {"a": 15.0, "b": 1490.0}


def test_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 8)
    monkeypatch.setattr(mixing, "ARITY", 4)
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise("b").alias("source"))
    got = mixing.assign_copies(df).collect()
    assert len(got) == 500
    for s in ("hot", "b"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 7


def test_mix_returns_rows(docs, clashing, empty, rows):
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copies"]
    plan = mixing.assign_copies(docs).filter("copies > 0")
    assert out.count() == plan.count() and out.agg(F.sum("copies")).first()[0] == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(clashing).count() == out.count()
    assert mixing.mix(empty).count() == 0 and mixing.assign_copies(empty).count() == 0
