"""MinHash near-duplicates: banding, signature verification, exact confirmation, alternating stars."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, in_order, octets, portions, small, text_key
from .resample import _BREAK, _FOLD, word_spans

SHINGLE = 5
#: Bands and rows: a link at exactly 0.75 is missed with a chance of 5e-6, at 0.8 of 5e-8.
BANDS, ROWS = 32, 4
#: Links need 100 * intersection >= 75 * union.
PERCENT = 75
#: Candidates whose signatures agree on less than this share are no link: 5 standard deviations below 0.75.
SIGNATURE_SHARE = 0.55
#: Pairs of one class that meet one copy of its text or signature.
HUB = 20_000

_RANDOM = np.random.default_rng(9)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _encoded(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of all texts, A-Z folded, as a dictionary array (equal words, equal number), and the number of words before each text."""
    at, data = octets(column)
    data = _FOLD[data]
    starts, ends, first = word_spans(at, data)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~_BREAK[data]]))])
    return words.dictionary_encode(), first


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles: ``size`` words, or all words if fewer; none without words.

    A word's hash is that of its bytes by BLAKE2, so that no words can be made to collide at will.
    """
    coded, first = _encoded(column)
    digests = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in coded.dictionary.to_pylist())
    words = np.frombuffer(digests, np.uint64)[coded.indices.to_numpy()]
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled = _mix(rolled * _STEP + words[k : k + n])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            own = np.sort(rolled[a : b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            value = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                value = _mix(value * _STEP + words[k : k + 1])
            out.append(_mix(value + np.uint64(1)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def exact_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as numbers, equal just where the shingles' words are, byte for byte; no hash is compared.

    Words are numbered by their bytes; runs of words by the numbers of a shorter run and the next word.
    Texts with fewer words than ``size`` have a number of their own: such a text has the same set as
    another only if both are in one class.
    """
    coded, first = _encoded(column)
    words = coded.indices.to_numpy().astype(np.int64)
    n = max(len(words) - size + 1, 0)
    names = words[:n]
    for k in range(1, size):
        names = np.unique(names * len(coded.dictionary) + words[k : k + n], return_inverse=True)[1]
    out = []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        out.append(np.unique(names[a : b - size + 1]) if b - a >= size else np.full(int(b > a), -1 - i))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of many universal hashes (multiply, add, upper half) of each set; (sets, hashes) of uint32."""
    out = np.full((len(sets), len(_FACTORS)), 0xFFFFFFFF, np.uint32)
    sizes = np.array([len(s) for s in sets])
    some = np.flatnonzero(sizes)
    if len(some):
        values = np.concatenate([sets[i] for i in some])
        first = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        hashed = np.empty_like(values)
        for j, (factor, term) in enumerate(zip(_FACTORS, _TERMS)):
            np.multiply(values, factor, out=hashed)
            np.add(hashed, term, out=hashed)
            out[some, j] = np.minimum.reduceat(hashed, first) >> np.uint64(32)
    return out


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row ``doc_id, key, n, node, sig``. ``node`` names the shingle set, so that equal sets are one; null without words."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column(2))
            sig = signatures(sets)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "big", signed=True) if len(s) else None for s in sets]
            new = [pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), pa.array([row.tobytes() if len(s) else None for row, s in zip(sig, sets)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new], ["doc_id", "key", "n", "node", "sig"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, key long, n long, node long, sig binary")


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(octets(batch.column(2))[1], np.uint32).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
        value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sig.shape[:2])
        for k in range(ROWS):
            value = _mix(value * _STEP + sig[:, :, k])
        take = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(value.reshape(-1).view(np.int64)), batch.column(0).take(take), batch.column(1).take(take)], ["band", "rep", "node"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures agree on enough places; their share is the estimate."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(octets(batch.column(i))[1], np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            like = (a == b).mean(axis=1)
            keep = pa.array(np.flatnonzero(like >= SIGNATURE_SHARE))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(like[keep.to_numpy()])], ["a", "b", "like"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose whole shingle sets are similar enough, in whole numbers."""
    for batch in portions(portions(batches, "ta", 1 << 20), "tb", 1 << 20):
        keep, n = [], batch.num_rows
        sets = exact_sets(pa.concat_arrays([batch.column(2), batch.column(3)]))
        for i, (x, y) in enumerate(zip(sets[:n], sets[n:])):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= PERCENT * (len(x) + len(y) - both):
                keep.append(i)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])


def stars(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a, b)``: alternating large-star and small-star until nothing changes.

    Each step is a minimum per node and a join with it, both by plain shuffles; no node's neighbours
    are gathered. Edges are written to the shared folder after each round.
    """
    state = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while True:
        # Done when all are stars: one edge from each node, and none from a centre.
        many = state.groupBy("u").count().filter("count > 1").select("u")
        inner = state.select(F.col("v").alias("u")).distinct().join(state.select(F.col("u").alias("w")), F.col("u") == F.col("w")).select("u")
        if many.unionByName(inner).isEmpty():
            break
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.w).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))  # v < u in every edge
        joined = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        state = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return cut(state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``t_node, text`` of the documents that stand for ``wanted`` (rep, rep_key, node); one row each, repeated rows too."""
    rows = docs.select(F.col(id_col).alias("t_id"), text_key(text_col).alias("t_key"), F.col(text_col).alias("text"))
    met = rows.join(small(wanted), F.col("t_id").eqNullSafe(F.col("rep")) & (F.col("t_key") == F.col("rep_key")))
    return met.groupBy(F.col("node").alias("t_node")).agg(F.min("text").alias("text"))


def _beside(pairs: DataFrame, values: DataFrame, node: str, value: str) -> DataFrame:
    """``pairs(a, b)`` with the values of both ends, as ``{value}a`` and ``{value}b``.

    Each end meets its value in a shuffled join. An end of very many pairs (the centre of a large group)
    has its value copied once for each ``HUB`` of them, and its pairs dealt over the copies.
    """
    for end, other in (("b", "a"), ("a", "b")):
        ends = values.select(F.col(node).alias("v_node"), F.col(value).alias(f"{value}{end}"))
        hubs = pairs.groupBy(F.col(end).alias("hub")).agg(F.ceil(F.count("*") / HUB).cast("int").alias("copies")).filter("copies > 1")
        if hubs.isEmpty():
            pairs = pairs.join(ends, F.col(end) == F.col("v_node")).drop("v_node")
            continue
        hubs = small(cut(hubs))
        salt = F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("copies")).cast("int"))
        dealt = pairs.join(hubs, F.col(end) == F.col("hub"), "left").withColumn("salt", salt).drop("hub", "copies")
        salted = ends.join(hubs, F.col("v_node") == F.col("hub"), "left")
        salted = salted.withColumn("v_salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("hub", "copies")
        pairs = dealt.join(salted, (F.col(end) == F.col("v_node")) & (F.col("salt") == F.col("v_salt"))).drop("v_node", "v_salt", "salt")
    return pairs.select("a", "b", f"{value}a", f"{value}b")


def _confirmed(docs: DataFrame, pairs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ends = pairs.select(F.col("a").alias("x")).unionByName(pairs.select(F.col("b").alias("x"))).distinct()
    wanted = cut(classes.select("rep", "rep_key", "node").join(ends, F.col("node") == F.col("x"), "left_semi"))
    texts = _texts(docs, wanted, id_col, text_col).withColumnRenamed("text", "t")
    return cut(_beside(pairs, texts, "t_node", "t").mapInArrow(_confirm, "a long, b long").distinct())


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return cut(_beside(pairs, classes.select("node", F.col("sig").alias("s")), "node", "s").mapInArrow(_agree, "a long, b long, like double"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, n_shingles, root, component_id``.

    Texts are folded (A-Z), words are runs of what is no white space, sets are distinct shingles of
    five words (all words if fewer). Documents with equal sets are one class, so copies cost no pairs.
    Classes that share a band of their signature are candidates. Each class is first paired with its
    band's class of the smallest id, not with all others; candidates are verified by signatures, then
    confirmed on the full sets, byte for byte, the best one of each class first. The others follow only
    if they would join two components. In bands that still hold several components, a second centre
    does the same; what is left meets across components by a prefix-filtered join of differences from that
    centre (``_prefix_pairs``), so that no link is lost to the choice of the centres. Components come from alternating large-star and
    small-star; ``component_id`` is the smallest id in the component.

    Null and empty texts, and texts without words, have no shingles and are alone. Repeated rows, and
    ties in any hash, end in the same component. Ids may be of any type that has an order. Rows whose
    id is null take part; a component with only null ids has a null id. An empty table gives an empty result.
    """
    signed = cut(sign(docs, id_col, text_col))
    first = F.min(F.struct("doc_id", "key"))
    classes = cut(signed.filter("node is not null").groupBy("node").agg(first.alias("first"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n").alias("n")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.key").alias("rep_key"), "least", "sig", "n"))
    whole = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    rep = F.coalesce(F.col("least").cast("long"), F.lit(2**63 - 1)) if whole else F.xxhash64("least")
    bands = classes.select(rep.alias("rep"), "node", "sig").mapInArrow(_band_rows, "band long, rep long, node long")
    centres = bands.groupBy("band").agg(F.min(F.struct("rep", "node")).alias("centre"), F.count("*").alias("size")).filter("size > 1").select(F.col("band").alias("c_band"), F.col("centre.node").alias("centre"), "size")
    # Only bands that several classes share go on.
    shared = cut(bands.join(centres, F.col("band") == F.col("c_band")).select("band", "node", "centre", "size"))
    star = cut(shared.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    left = _verified(star, classes)
    # Best candidate of each class first: what it links need not be confirmed again.
    best = cut(left.groupBy("b").agg(F.max(F.struct("like", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    links = _confirmed(docs, best, classes, id_col, text_col)
    roots = stars(links)
    placed = _placed(docs, shared, roots, classes, id_col, text_col)
    # The class of a band that has the most of what others have, too, is the best second centre.
    rows = _reaching(shared, placed, roots, classes)
    second = cut(rows.groupBy("band").agg(F.max(F.struct(F.col("reach") / F.col("n"), "node", "root", "reach", "n")).alias("c")).select(F.col("band").alias("band2"), "c"))
    near = rows.join(small(second), F.col("band") == F.col("band2")).filter((F.col("root") != F.col("c.root")) & _enough("reach", "n", "c.reach", "c.n"))
    near = cut(near.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct())
    rest = _across(left.select("a", "b").join(best.select(F.col("a").alias("x"), F.col("b").alias("y")), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti"), roots)
    links = cut(links.unionByName(_confirmed(docs, cut(rest.unionByName(_verified(near, classes).select("a", "b")).distinct()), classes, id_col, text_col)))
    roots = stars(links)
    rows = _reaching(shared, placed, roots, classes)
    members = rows.join(small(second), F.col("band") == F.col("band2")).select(F.col("c.node").alias("centre"), "node", "root", "n").distinct()
    more = _verified(_prefix_pairs(placed, members), classes).select("a", "b")
    if not more.isEmpty():
        roots = stars(links.unionByName(_confirmed(docs, more, classes, id_col, text_col)))
    nodes = classes.select("node", "least")
    nodes = nodes.join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.select(F.col("node").alias("m_node"), "root").join(ids, "root").select("m_node", "root", "component_id")
    rows = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), "node").join(named, F.col("node") == F.col("m_node"), "left")
    return rows.select("doc_id", "key", "n_shingles", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias("n"), F.col("root").alias(f"root_{end}")), F.col(end) == F.col("n"), "left").drop("n")
    return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", 1 << 20):
        sets = shingle_sets(batch.column(1))
        take = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(sets).view(np.int64))], ["t_node", "shingle"])


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``band, node, root`` of the bands of three classes or more (a band of two is its star) that hold several components."""
    rows = shared.filter("size > 2").select("band", "node")
    rows = rows.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = rows.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select(F.col("band").alias("mixed"))
    return rows.join(small(cut(mixed)), F.col("band") == F.col("mixed"), "left_semi")


def _placed(docs: DataFrame, shared: DataFrame, roots: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``t_node, shingle`` of the classes in mixed bands."""
    involved = _mixed(shared, roots).select(F.col("node").alias("x")).distinct()
    wanted = cut(classes.select("rep", "rep_key", "node").join(involved, F.col("node") == F.col("x"), "left_semi"))
    return cut(_texts(docs, wanted, id_col, text_col).mapInArrow(_shingle_rows, "t_node long, shingle long").distinct())


def _reaching(shared: DataFrame, placed: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """``band, node, root, n, reach`` of the classes in mixed bands that can be linked across components.

    A shingle that only one component has is in no intersection across components; ``reach`` counts a
    class's shingles that others have. Less than ``PERCENT`` of its own and it can't be linked. The bound is
    exact, and it spares a large family of copies that were edited too much to be linked from
    being compared pair by pair.
    """
    rows = cut(_mixed(shared, roots))
    own = placed.join(rows.select("node", "root").distinct(), F.col("t_node") == F.col("node")).select("node", "root", "shingle")
    common = own.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select(F.col("shingle").alias("c"))
    reach = own.join(common, F.col("shingle") == F.col("c"), "left_semi").groupBy("node").agg(F.count("*").alias("reach"))
    reach = reach.join(classes.select(F.col("node").alias("x"), "n"), F.col("node") == F.col("x")).filter(100 * F.col("reach") >= PERCENT * F.col("n")).select(F.col("node").alias("x"), "n", "reach")
    return cut(rows.join(reach, F.col("node") == F.col("x")).drop("x"))


def _enough(reach: str, n: str, reach2: str, n2: str):
    """Whether the intersection that the sizes need is within reach: 100 * both >= PERCENT * (n + n2 - both)."""
    return (100 + PERCENT) * F.least(reach, reach2) >= PERCENT * (F.col(n) + F.col(n2))


def _prefix_pairs(placed: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes from different components that can still be linked, all of them; ``members``: ``centre, node, root, n``.

    An exact prefix-filtered join on differences. Each class is described by its difference from its
    centre: the shingles that just one of the two has. A link bounds the pair's own difference by
    ``limit = (n + n2) * (100 - PERCENT) / (100 + PERCENT)``, so the two descriptions, of sizes d and d2,
    share at least ``k = (d + d2 - limit) / 2`` shingles. Where that asks for none, both are so near the centre that
    each is linked with it, thus in one component already: k is 1 at least. In the order of rarity
    within the centre's group, the first shared shingle is among the first ``held - k + 1`` of each, and
    its places leave room for k. Only shingles that several components hold in their descriptions count.

    The shingles that a large family has in common, which would bring all of it together, are in no description; an
    edit that two members don't share brings none together. So pairs grow with likely links.
    """
    span = members.groupBy("centre").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select(F.col("centre").alias("m_centre"))
    members = cut(members.join(span, F.col("centre") == F.col("m_centre"), "left_semi").filter("node != centre"))
    own = members.join(placed, F.col("node") == F.col("t_node")).select("centre", "node", "root", "n", "shingle")
    its = members.join(placed, F.col("centre") == F.col("t_node")).select("centre", "node", "root", "n", "shingle")
    differ = own.unionByName(its).groupBy("centre", "node", "root", "n", "shingle").agg(F.count("*").alias("times")).filter("times = 1").drop("times")
    differ = cut(differ.withColumn("d", F.count("*").over(Window.partitionBy("centre", "node"))))
    common = differ.groupBy("centre", "shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("df")).filter("low != high").select("centre", "shingle", "df")
    ranked = differ.join(common, ["centre", "shingle"]).withColumn("held", F.count("*").over(Window.partitionBy("centre", "node")))
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("centre", "node").orderBy("df", "shingle"))).drop("df")
    ranked = cut(ranked)
    other = ranked.select(*(F.col(c).alias(f"{c}2") for c in ranked.columns))
    k = F.greatest(F.lit(1), F.ceil(((100 + PERCENT) * (F.col("d") + F.col("d2")) - (100 - PERCENT) * (F.col("n") + F.col("n2"))) / (2 * (100 + PERCENT))))
    sizes = 100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2")
    prefix = (F.col("place") <= F.col("held") - k + 1) & (F.col("place2") <= F.col("held2") - k + 1)
    room = F.least("place", "place2") + F.least(F.col("held") - F.col("place"), F.col("held2") - F.col("place2")) >= k
    same = (F.col("centre") == F.col("centre2")) & (F.col("shingle") == F.col("shingle2"))
    met = ranked.join(other, same & (F.col("root") != F.col("root2")) & (F.col("node") < F.col("node2")) & sizes & prefix & room)
    return cut(met.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id; all columns of ``docs``. Repeated rows leave one, the first by ``in_order``."""
    found = cut(components(docs, id_col, text_col))
    stays = found.filter(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "root").agg(F.min("key").alias("key"))
    alone = found.filter("root is null").select("doc_id", "key").distinct()
    stays = stays.select("doc_id", "key").unionByName(alone).select(F.col("doc_id").alias("_id2"), F.col("key").alias("_key2")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    rows = rows.join(stays, F.col("id").eqNullSafe(F.col("_id2")) & (F.col("key") == F.col("_key2")), "left_semi")
    if not found.groupBy("doc_id", "key").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "key").orderBy(*in_order(docs, "row.")))).filter("n = 1")
    return rows.select("row.*")
