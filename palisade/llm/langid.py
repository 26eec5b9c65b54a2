"""Language identification by a bit-sliced Bloom filter over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, cut, octets, portions

#: Bytes that go to a Python worker at once, and bytes of text that it works on at once.
_SENT, _PORTION = 2 << 20, 1 << 20
#: Byte n-grams that are looked up.
ORDERS = (2, 3, 4)
_SPACE = 32
#: Odd multipliers of the filter's hash functions.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: ASCII letters stay, other ASCII is a space, bytes of other letters stay.
_LETTERS = np.full(256, _SPACE, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of the texts in lower case, with one space for each run of what isn't a letter and at both ends."""
    at, data = octets(pc.utf8_lower(column.fill_null("")))
    n = len(at) - 1
    spaced = np.full(len(data) + n + 1, _SPACE, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(at))] = _LETTERS[data]
    gap = spaced == _SPACE
    keep = np.ones(len(spaced), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    return np.cumsum(keep)[at + np.arange(n + 1)] - 1, spaced[keep]


def _values(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the n-gram at each place as a 32-bit number; orders go from 2 to 4."""
    wide = data.astype(np.uint32)
    value = wide
    for order in range(2, max(ORDERS) + 1):
        n = max(len(wide) - order + 1, 0)
        value = (value[:n] << np.uint32(8)) | wide[order - 1 : order - 1 + n]
        yield order, value


@dataclass(frozen=True)
class LanguageFilter:
    """One bit per language in each cell: ANDing the cells of an n-gram gives all languages that have it.

    ``cells`` is (words, 2**bits): language ``l`` is bit ``l % 64`` of word ``l // 64`` (with up to
    eight languages a word is a byte); ``false`` is each language's rate of false positives, its
    share of set bits to the power of ``hashes``.
    """

    languages: tuple[str, ...]
    cells: np.ndarray
    hashes: int
    false: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray], bits: int = 18, hashes: int = 2) -> LanguageFilter:
        cells = np.zeros(((len(languages) + 63) // 64 or 1, 1 << bits), np.uint8 if len(languages) <= 8 else np.uint64)
        false = np.zeros(len(languages))
        for l, name in enumerate(languages):
            mark = np.zeros(1 << bits, bool)
            for place in cls._places(grams[name], bits, hashes):
                mark[place] = True
            cells[l // 64][mark] |= cells.dtype.type(1 << (l % 64))
            false[l] = mark.mean() ** hashes
        return cls(tuple(languages), cells, hashes, false)

    @staticmethod
    def _places(values: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
        for k in range(hashes):
            mixed = (values ^ (values >> np.uint32(15))) * np.uint32(_MULTIPLIERS[k])
            yield mixed >> np.uint32(32 - bits)

    def masks(self, values: np.ndarray, word: int) -> np.ndarray:
        """The bitmask of the languages that have each n-gram."""
        out = None
        for place in self._places(values, self.cells.shape[1].bit_length() - 1, self.hashes):
            out = self.cells[word][place] if out is None else out & self.cells[word][place]
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and share of known n-grams of each text."""
        at, data = _grams(column)
        n = len(at) - 1
        hits, total = np.zeros((n, len(self.languages))), np.zeros(n)
        for order, values in _values(data):
            # n-grams of a text: from the space before it to the space after it
            start, end = np.minimum(at[:-1], len(values)), np.minimum(np.maximum(at[1:] + 2 - order, at[:-1]), len(values))
            total += end - start
            for word in range(len(self.cells)):
                masks = self.masks(values, word)
                for l in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    sums = np.zeros(len(masks) + 1, np.int32)
                    np.cumsum((masks >> masks.dtype.type(l % 64)) & masks.dtype.type(1), out=sums[1:])
                    hits[:, l] += sums[end] - sums[start]
        # What false positives add to a language that truly has t of N n-grams: (N - t) * false.
        true = np.clip((hits - total[:, None] * self.false) / (1 - self.false), 0, None)
        best = true.argmax(axis=1) if len(self.languages) else np.zeros(n, int)
        top = true[np.arange(n), best]
        score = np.divide(top, true.sum(axis=1), out=np.zeros(n), where=true.sum(axis=1) > 0)
        known = np.divide(top, total, out=np.zeros(n), where=total > 0)
        return [self.languages[b] for b in best], score, np.clip(known, 0, 1)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, "text", _PORTION):
        at, data = _grams(batch.column(0))
        langs = batch.column(1).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(langs.indices.to_numpy() == code)
            for order, values in _values(data):
                own = np.concatenate([values[at[r] : max(at[r], min(at[r + 1] + 2 - order, len(values)))] for r in rows])
                found, counts = np.unique(own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int64) | (order << 32)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1500, grams: int = 30_000, share: float = 0.2, seed: int = 5, languages: int = 1000) -> LanguageFilter:
    """Fit the filter on a bounded sample: of each language the ``per_language`` labelled rows, not held
    out, with the smallest keyed hash of the id, one row for each id.

    A language has an n-gram if it is among its ``grams`` most frequent ones (n-grams as frequent as the
    first that is not are left out, too) and at least ``share`` times as frequent in it as in the language where it is
    most frequent. Languages go by how many n-grams were seen, then by name: ties in ``predict`` go to
    the first. Without labelled text the filter has no language, and every text is ``und``. More than
    ``languages`` of them are an error: the sample and the filter are sized by them.

    No language is sorted in one task: only hashes below a cut-off that follows from the language's size are,
    and the n-grams' cut-off comes from the numbers of n-grams by frequency.
    """
    arrow_batches(docs.sparkSession, size=_SENT)
    ok = F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col)
    labelled = docs.filter(ok).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))
    names = labelled.select("lang").distinct().limit(languages + 1).collect()
    if len(names) > languages:
        raise ValueError(f"{lang_col} has more than {languages} values")
    span = 2**31
    keyed = labelled.select("lang", "id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(span)).alias("h")).distinct()
    # A quarter more than wanted by their hashes, and a hundred: the rows that can be among the smallest, whatever a language's size.
    share_of = keyed.groupBy("lang").agg((F.lit(span * (1.25 * per_language + 100)) / F.count("*")).alias("below")).withColumnRenamed("lang", "l")
    few = keyed.join(F.broadcast(share_of), F.col("lang") == F.col("l")).filter("h < below")
    chosen = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("rank") <= per_language)
    sample = labelled.join(F.broadcast(chosen.select("lang", "id")), ["lang", "id"], "left_semi").groupBy("lang", "id").agg(F.min("text").alias("text"))
    counts = cut(sample.select("text", "lang").mapInArrow(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = counts.groupBy("lang", "n").agg(F.count("*").alias("grams")).withColumn("sum", F.sum("grams").over(Window.partitionBy("lang").orderBy(F.desc("n"))))
    least = levels.filter(F.col("sum") <= grams).groupBy("lang").agg(F.min("n").alias("least")).withColumnRenamed("lang", "l")
    got = counts.join(F.broadcast(least), F.col("lang") == F.col("l")).filter("n >= least").select("lang", "gram", "n").toPandas()  # languages times grams at most
    if got.empty:
        return LanguageFilter.build([], {})
    got["f"] = got["n"] / got.groupby("lang")["n"].transform("sum")
    got = got[got["f"] >= share * got.groupby("gram")["f"].transform("max")]
    sizes = got.groupby("lang")["n"].sum()
    names = sorted(sizes.index, key=lambda name: (-sizes[name], name))
    return LanguageFilter.build(names, {name: part["gram"].to_numpy().astype(np.uint32) for name, part in got.groupby("lang")})


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (the language's share of all languages' corrected counts) and
    ``known`` (the share of the text's n-grams that the language has) to every row.

    Null text and text without a letter give ``und``, 0 and 0; so does every text if the model has no
    language. A text whose n-grams no language has, or a tie, goes to the language seen most in
    training. Whole texts are read. Columns of those names are replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark, size=_SENT)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "known")]
    # A string column among those kept goes to Python once and serves both ends.
    kept = text_col in keep and dict(docs.dtypes)[text_col] == "string"
    sent, name = (docs.select(*keep), text_col) if kept else (docs.select(*keep, F.col(text_col).alias("_text")), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in portions(batches, name, _PORTION):
            texts = batch.column(batch.schema.get_field_index(name))
            letters = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
            if model.languages:
                names, score, known = model.predict(texts)
            else:
                names, score, known, letters = [], np.zeros(len(letters)), np.zeros(len(letters)), np.zeros(len(letters), bool)
            names = [name if ok else "und" for name, ok in zip(names, letters)] if names else ["und"] * len(letters)
            new = [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, known, 0.0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, "lang_pred", "score", "known"])

    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "known": F.lit(0.0)}).schema
    return sent.mapInArrow(run, schema)
