import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palisade.llm import resample


def grams(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return w + list(zip(w, w[1:]))


def test_buckets_follow_grams():
    texts = ["A b c", "", None, "a B", "  x ", "c", "b c a b"]
    found, first = resample.gram_buckets(pa.array(texts), 1 << 14)
    assert np.diff(first).tolist() == [len(grams(t)) for t in texts]
    bucket = {}
    for t, a, b in zip(texts, first, first[1:]):
        assert sorted(found[a:b].tolist()) == sorted(found[a:b].tolist())
        for g in set(grams(t)):
            bucket.setdefault(g, []).append(set(found[a:b].tolist()))
    assert all(set.intersection(*s) for s in bucket.values())


def corpus(spark):
    rng = random.Random(6)
    good, bad = "river stone light paper green".split(), "junk spam click win cash".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(5, 400)))) for i in range(400)]
    labels = [(i, i % 2, 0) for i in range(0, 400, 3)] + [(None, 1, 0), (1, None, None)]
    return rows, spark.createDataFrame(rows + [(900, None), (901, ""), rows[0]], "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_weights_and_selection(spark):
    rows, docs, labels = corpus(spark)
    got = resample.resample(docs, labels, share=0.5).collect()
    assert len(got) == 403
    by = {r.doc_id: r for r in got}
    assert all((by[i].quality_score > 0.5) == bool(i % 2) for i, _ in rows)
    kept = sum(by[i].kept for i, _ in rows if i % 2)
    assert kept >= 190 and by[900].log_weight == 0 and by[901].n_grams == 0
    assert {r.kept for r in got if r.doc_id == 0} == {by[0].kept}


def test_weight_is_the_log_ratio(spark):
    rows = [(0, "a b"), (1, "a a"), (2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    raw, good = Counter(g for _, t in rows for g in grams(t)), Counter(grams("a b"))
    n = resample.BUCKETS
    for r in resample.weigh(docs, labels).collect():
        expect = sum(math.log((good[g] + 1) / (3 + n)) - math.log((raw[g] + 1) / (7 + n)) for g in grams(rows[r.doc_id][1]))
        assert abs(r.log_weight - expect) < 1e-9


def test_threshold(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for _ in range(1500)] + [7.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "x double")
    order = sorted(values, reverse=True)
    for k in (1, 10, 400, 1550):
        assert resample.threshold(df, "x", k) == order[k - 1]
    assert resample.threshold(df.limit(0), "x", 3) is None


def test_edges(docs, empty, clashing, rows, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = resample.resample(docs, labels).collect()
    assert len(got) == len(rows) and all(r.log_weight == 0 for r in got)
    assert resample.resample(empty, labels).count() == 0
    assert resample.resample(clashing, labels).filter(F.col("kept")).count() >= math.ceil(0.75 * len(rows))


def test_long_texts_have_the_whole_log_ratio(spark):
    long = " ".join(["a b c d"] * 500)
    rows = [(0, "a b"), (1, long), (2, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    raw, good = Counter(g for _, t in rows for g in grams(t)), Counter(grams("a b"))
    n = resample.BUCKETS
    ratio = lambda g: math.log((good[g] + 1) / (3 + n)) - math.log((raw[g] + 1) / (sum(raw.values()) + n))
    expect = sum(map(ratio, grams(long)))
    got = {r.doc_id: r.log_weight for r in resample.weigh(docs, labels).collect()}
    assert abs(got[1] - expect) < 1e-9 * abs(expect)


def test_selection_is_gumbel_top_k(spark):
    """Log weights by plain counting, noise from the draws, and the largest keys by a sort."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh" if i % 3 else "ghijkl") for _ in range(rng.randint(1, 40)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = [i for i, _ in rows if i % 3 and i % 2]
    labels = spark.createDataFrame([(i, int(i in good), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        target.update(grams(t) if i in good else ())
    n, a, b = resample.BUCKETS, sum(target.values()), sum(raw.values())
    ratio = {g: math.log((target[g] + 1) / (a + n)) - math.log((raw[g] + 1) / (b + n)) for g in raw}
    draws = {r.doc_id: r.d for r in docs.select("doc_id", F.xxhash64(F.lit(24), "doc_id", "text").alias("d")).collect()}
    keys = {}
    for i, t in rows:
        uniform = min(max(((draws[i] % 2**64) >> 11) / 2**53, 2.0**-54), 1 - 2.0**-53)
        keys[i] = sum(ratio[g] for g in grams(t)) - math.log(-math.log(uniform))
    expect = set(sorted(keys, key=keys.get, reverse=True)[: math.ceil(0.6 * len(rows))])
    got = resample.resample(docs, labels, share=0.6).collect()
    assert all(abs(r.gumbel_key - keys[r.doc_id]) < 1e-6 for r in got)
    assert {r.doc_id for r in got if r.kept} == expect
