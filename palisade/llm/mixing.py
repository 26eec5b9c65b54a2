"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_order, small

if TYPE_CHECKING:
    import pandas as pd

#: Words are runs of what is neither a space nor one of the five control characters from tab to return.
WORDS = r"[^\x20\x09-\x0D]+"
#: Documents in a first group, and groups that meet in one node of the tree.
LEAF, ARITY = 4096, 64


def words(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: ``source, rank, docs, source_size, target``.

    Sources rank by code point, null last, and weigh ``weights`` in turn. They share ``share`` of all
    sizes by weight; a target stops at ``most`` times its source's size, and the excess goes to the
    rest by weight until none is above. Sources without words get 0.
    """
    per = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    # A rank over any number of sources without one task: ranges, then each range's offset.
    per = cut(per.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id()))
    before = per.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    per = cut(per.join(F.broadcast(before.select("part", "before")), "part").withColumn("rank", rank).withColumn("weight", weight).select("source", "rank", "docs", "source_size", "weight"))
    total = float(share) * float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, cap = 0.0, F.col("source_size") * F.lit(float(most))
    while total:  # water-filling: the level only rises, and each round caps one more source at least
        full = F.col("weight") * F.lit(level) >= cap
        capped, open_weight = per.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not open_weight or (rise := (total - capped) / open_weight) <= level:
            break
        level = rise
    return per.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight")


def _settle(group: pd.DataFrame, seed: int, level: int, last: bool) -> pd.DataFrame:
    """Pivotal steps over one group, in a fixed order: mass (size times probability) moves between two
    documents until one of them has probability 0 or 1. At most one is left open, and at the root none.
    Large documents go first: the many small ones after them settle them, so the open one is small."""
    group = group.sort_values(["size", "order", "doc_id", "key"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    p, size = group["p"].to_numpy(float).copy(), group["size"].to_numpy(float)
    draw = np.random.default_rng([seed, level, int(group["rank"].iloc[0]), int(group["bucket"].iloc[0])]).random(len(p) + 1)
    a = -1
    for b in np.flatnonzero((p > 0) & (p < 1)):
        if a < 0:
            a = b
            continue
        up = min(size[a] * (1 - p[a]), size[b] * p[b])  # from b to a
        down = min(size[a] * p[a], size[b] * (1 - p[b]))  # from a to b
        move = up if draw[b] * (up + down) < down else -down
        p[a], p[b] = p[a] + move / size[a], p[b] - move / size[b]
        for x in (a, b):
            p[x] = 0.0 if p[x] < 1e-9 else 1.0 if p[x] > 1 - 1e-9 else p[x]
        if not 0 < p[a] < 1:
            a = b if 0 < p[b] < 1 else -1
    if last and a >= 0:
        p[a] = float(draw[-1] < p[a])
    return group.assign(p=p, bucket=group["bucket"] // ARITY)


def _settler(seed: int, level: int, last: bool, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        return _settle(group, seed, level, last)[names]

    return settle


def assign_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, source, size, source_size, target, copies``.

    A document's expected copies are its source's target over its source's size. The whole part is
    taken as it is. The fraction is rounded by the pivotal method: within groups of one source, mass
    moves between two documents until one has a whole number; what is left of each group meets in the
    next level of a tree of arity 64 until one document per source is open, which a coin settles. So
    each source's words differ from the target by less than the words of one document, nobody is taken
    more than ``most`` times, and each document's expectation is exact. Draws follow from ``seed``
    alone, so reruns agree.

    Null text has size 0 and copies of no effect; null sources are one source; repeated rows count
    each; an empty table gives an empty result. ``key`` tells rows of equal ids apart.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(source_col), F.lit("")))
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size"), key.alias("key")))
    targets = cut(source_targets(sized, weights, share, most))
    groups = F.pow(F.lit(2), F.ceil(F.log2(F.ceil(F.col("docs") / LEAF)))).cast("long")
    depth, widest = 1, targets.agg(F.max(groups)).first()[0] or 1
    while ARITY ** (depth - 1) < widest:
        depth += 1
    t = targets.withColumnRenamed("source", "t_source").withColumn("groups", groups)
    rows = sized.join(small(t), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "docs")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    want = F.when(F.abs(want - F.round(want)) < 1e-9, F.round(want)).otherwise(want)
    order = F.xxhash64(F.lit(seed), "doc_id", "key")
    rows = rows.withColumn("whole", F.floor(want)).withColumn("p", F.when(F.col("size") > 0, want - F.floor(want)).otherwise(0.0)).withColumn("order", order).withColumn("bucket", F.pmod("order", "groups")).drop("groups")
    done = []
    for level in range(depth):
        last = level == depth - 1
        rows = rows.groupBy("rank", "bucket").applyInPandas(_settler(seed, level, last, rows.columns), rows.schema)
        if not last:
            rows = cut(rows)
            done.append(rows.filter((F.col("p") == 0) | (F.col("p") == 1)))
            rows = rows.filter((F.col("p") > 0) & (F.col("p") < 1))
    for part in done:
        rows = rows.unionByName(part)
    return rows.select("doc_id", "key", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes at least once, with ``copies``; options as in ``assign_copies``.

    Rows with equal ids, texts and sources are told apart by their ordinal ``in_order``, so each has its own
    copies; without such rows no ordinal is computed, and texts are shuffled once, in the join with their copies.
    """
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    docs = docs.drop("copies")
    taken = cut(assign_copies(docs, **options).select(F.col("doc_id").alias("id2"), F.col("key").alias("key2"), "copies"))
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(source_col), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
    if not taken.groupBy("id2", "key2").count().filter("count > 1").isEmpty():
        taken = taken.withColumn("n2", F.row_number().over(Window.partitionBy("id2", "key2").orderBy(F.desc("copies"))))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy(*in_order(docs, "row."))))
        same &= F.col("n") == F.col("n2")
    return rows.join(small(taken.filter("copies > 0")), same).select("row.*", "copies")


__all__ = ["assign_copies", "mix", "source_targets", "words"]
