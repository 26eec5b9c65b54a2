"""Benchmark decontamination: a prefix-filtered set join in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, text_key

#: What separates words after A-Z became a-z: all but digits, a-z and characters from U+0080.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 13, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: str) -> Column:
    """The words of a text; null has none. Only A-Z change case, so ``lower`` serves ASCII texts alone."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, BREAK), "")


def _shingles(words: str, size: int) -> Column:
    """Hash of the ``size`` words from each place on, null where fewer are left."""

    def at(w: Column, i: Column) -> Column:
        parts = [w, *(F.get(F.col(words), i + k) for k in range(1, size))]
        return F.when(i + size <= F.size(words), F.xxhash64(*parts))

    return F.transform(F.col(words), at)


def windows(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """Distinct windows ``(words, items)``: ``window`` consecutive words of an item, or all of a shorter one."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), tokens(text_col).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0)))
    cuts = items.select("item", "all", F.explode(starts).alias("start"))
    return cuts.select("item", F.slice("all", F.col("start") + 1, window).alias("words")).groupBy("words").agg(F.collect_set("item").alias("items"))


def _met(words: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``doc_id, key, n, first, hit, s, pos, hash``: the shingles that ``wanted`` has, and each row's first place, with its number of words.

    One pass: the words are split once for all sizes.
    """
    # posexplode would have the optimizer put a filter on the array's size below it, with the words split anew for each of them
    hashes = F.concat(*(_shingles("words", s) for s in sizes)) if sizes else F.array().cast("array<long>")
    each = words.withColumn("n", F.size("words")).withColumn("hashes", hashes).select("doc_id", "key", "n", F.posexplode_outer("hashes").alias("i", "hash"))
    each = each.withColumn("first", F.coalesce("i", F.lit(0)) == 0).filter(F.col("first") | F.col("hash").isNotNull())
    some = F.col("hash").isNotNull()
    each = each.withColumn("s", F.when(some, F.element_at(F.array(*map(F.lit, sizes or [0])), (F.expr("i div greatest(n, 1)") + 1).cast("int"))).otherwise(0))
    # A row without a shingle gets a key of its own, so that they don't meet in one task.
    each = each.select("doc_id", "key", "n", "first", "s", (F.col("i") % F.greatest("n", F.lit(1))).alias("pos"), F.when(some, F.col("hash")).otherwise(F.xxhash64("doc_id", "key")).alias("hash"))
    met = each.join(wanted.withColumn("hit", F.lit(True)), ["hash", "s"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return met.filter("first or hit").select("doc_id", "key", "n", "first", "hit", "s", "pos", "hash")


def annotate(docs: DataFrame, benchmark: DataFrame, one_in: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Each row's id and ``key``, with ``n_words, n_hit, n_items, items`` (sorted) and ``contaminated``.

    Documents and windows are sets of word shingles with places. A window is contained if all its
    shingles stand in the document at one alignment, so any one of them is a necessary prefix: windows
    are joined on their rarest shingle, counted over all documents. A candidate must leave room for
    the window (length and positional bounds). It is verified on the words themselves: those at its place,
    as many as the window has, must be the window's. Windows with fewer words than a shingle are one
    shingle of their length. No hash decides a hit.

    The documents' shingles meet the benchmark's before any shuffle, if those are few enough to be
    broadcast; else in a shuffled join. A word is hit once however many windows cover it. Contaminated:
    at least one word hit, and hits are at least one in ``one_in`` words.

    Null and empty texts, and items without words, have no windows; a document without words is clean, and
    so is each where a table is empty or all items are null. Repeated rows give equal rows.
    """
    wins = cut(windows(benchmark, item_col, item_text, window).withColumn("len", F.size("words")).withColumn("win", F.monotonically_increasing_id()))
    sizes = sorted(r[0] for r in wins.select(F.least("len", F.lit(shingle)).alias("s")).distinct().collect())  # at most `shingle` numbers
    parts = benchmark.sparkSession.createDataFrame([], "win long, len int, offset int, hash long, s int")
    for s in sizes:
        own = wins.filter(F.least("len", F.lit(shingle)) == s)
        parts = parts.unionByName(own.select("win", "len", F.posexplode_outer(_shingles("words", s)).alias("offset", "hash")).filter("hash is not null").withColumn("s", F.lit(s)))
    parts = cut(parts)
    wanted = small(parts.select("hash", "s").distinct(), 2_000_000)
    words = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"), tokens(text_col).alias("words"))
    met = cut(_met(words, wanted, sizes))
    found = met.filter("hit").select("doc_id", "key", "n", "s", "pos", "hash")

    # The rarest shingle of each window; one that no document has rules its window out.
    seen = found.groupBy("hash", "s").agg(F.count("*").alias("df"))
    ranked = parts.join(seen, ["hash", "s"], "left").groupBy("win", "len", "s").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("hash"), F.col("offset"))).alias("rarest"))
    prefix = small(cut(ranked.filter("rarest.df > 0").select("len", "s", "rarest.hash", "rarest.offset").distinct()))
    start = F.col("pos") - F.col("offset")
    room = (F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n"))
    places = found.join(prefix, ["hash", "s"]).withColumn("start", start).filter(room).select("doc_id", "key", F.struct("start", "len").alias("place"))
    places = cut(places.groupBy("doc_id", "key").agg(F.collect_set("place").alias("places")))

    # The words at those places; only the documents concerned are split again.
    mine = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    again = words.join(small(places.select(F.col("doc_id").alias("d"), F.col("key").alias("k"))), mine, "left_semi")
    placed = again.join(places.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "places"), mine).select("doc_id", "key", "words", F.explode("places").alias("place"))
    slices = placed.select("doc_id", "key", "place", F.slice("words", F.col("place.start") + 1, F.col("place.len")).alias("words"))
    whole = slices.join(small(wins.select("words", "items")), "words")
    end = lambda x: x["start"] + x["len"]
    step = lambda a, x: F.struct((a["n"] + F.greatest(end(x) - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], end(x)).alias("end"))
    covered = F.aggregate(F.array_sort(F.collect_set("place")), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])
    hits = whole.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(covered.cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    out = met.filter("first").select("doc_id", "key", F.col("n").cast("long").alias("n_words")).join(hits, mine, "left").drop("d", "k")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    hit = (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    return out.withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", hit)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", any_hit: bool = False, **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated; all their columns, repeated rows included.

    ``any_hit`` drops every document that holds a window, so that long ones don't carry passages through.
    """
    bad = annotate(docs, benchmark, id_col=id_col, text_col=text_col, **options).filter("n_hit > 0" if any_hit else "contaminated").select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_key(text_col).alias("key"))
    return rows.join(small(cut(bad)), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_anti").select("row.*")
