"""Media columns: text as lossless WebP images of 8-bit grey samples, and features of what is read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import webp
from .common import arrow_batches, octets, portions

WIDTH = 64
#: Samples in one image; longer payloads are several images in a row.
PART = WIDTH * webp.MOST
_GREY = np.uint32(0x00010101)


def to_media(payload: bytes) -> bytes:
    """WebP files, one for each part of a payload whose length is a positive multiple of 64: rows of 64 grey samples.

    Up to 16 different samples make a palette with bundled pixels; else the three equal colours are
    one, by subtracting green, and repeats of the sample before become references.
    """
    out = []
    for at in range(0, len(payload), PART):
        samples = np.frombuffer(payload, np.uint8, min(PART, len(payload) - at), at)
        few = np.count_nonzero(np.bincount(samples, minlength=256)) <= 16
        out.append(webp.encode(samples * _GREY | np.uint32(0xFF000000), WIDTH, (("palette",),) if few else (("green",),)))
    return b"".join(out)


def images(media: bytes) -> Iterator[tuple[np.ndarray, int, int]]:
    """Pixels, width and height of each file of a media value."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield webp.decode(media[at : at + size])
        at += size


def from_media(media: bytes) -> np.ndarray:
    """The samples of all images; ValueError if one isn't grey."""
    parts = []
    for pixels, _, _ in images(media):
        samples = (pixels & np.uint32(255)).astype(np.uint8)
        if not (samples * _GREY | np.uint32(0xFF000000) == pixels).all():
            raise ValueError("an image that isn't grey")
        parts.append(samples)
    return np.concatenate(parts)


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row without its text, with ``n_bytes`` (of the UTF-8 text) and ``media``.

    Null is the empty text. Bytes 0 are appended up to a positive multiple of 64, so empty text is one
    row of zeros. Equal texts give equal media; texts of any length are stored whole; columns of those
    names are replaced.
    """
    arrow_batches(docs.sparkSession, 1000)
    keep = [c for c in docs.columns if c not in (text_col, "n_bytes", "media")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_text", 1 << 20):
            at, data = octets(batch.column(batch.num_columns - 1))
            whole = data.tobytes()
            texts = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            media = [to_media(t + bytes(-len(t) % WIDTH if t else WIDTH)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def pixel_arrays(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Every row without its media, with ``images``: per file ``width, height`` and ``pixels`` (red, green, blue, alpha bytes in rows).

    Any lossless WebP can be read: all transforms, references, colour cache and groups of prefix codes.
    Null gives null; a value that can't be read gives an empty array and the reason in ``problem``.
    """
    arrow_batches(df.sparkSession, 100)
    keep = [c for c in df.columns if c not in (media_col, "images", "problem")]
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())]))

    def read(media: bytes | None) -> tuple[list | None, str | None]:
        try:
            # Little-endian numbers are blue, green, red, alpha.
            return media if media is None else [{"width": w, "height": h, "pixels": p.view(np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]].tobytes()} for p, w, h in images(media)], None
        except (ValueError, IndexError) as e:
            return [], str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_media", 1 << 20):
            rows = [read(m) for m in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], [*keep, "images", "problem"])

    schema = T.StructType([*df.select(*keep).schema.fields, *T.StructType.fromDDL("images array<struct<width:int,height:int,pixels:binary>>, problem string").fields])
    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, schema)


def describe(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Every row without its media, with what its samples are: ``payload_bytes, payload_sha256, tail_crc32`` (of the
    last 64), ``media_bytes, media_sha256`` and ``feature`` (samples' mean, deviation, entropy, zeros and rows)."""
    arrow_batches(df.sparkSession, 1000)
    added = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    keep = [c for c in df.columns if c != media_col and c not in added]

    def row(media: bytes) -> tuple:
        samples = from_media(media)
        payload, counts = samples.tobytes(), np.bincount(samples, minlength=256)
        share = counts[counts > 0] / len(samples)
        mean = float((counts * np.arange(256)).sum()) / len(samples)
        spread = float((counts * (np.arange(256) - mean) ** 2).sum() / len(samples)) ** 0.5
        feature = f"mean={mean:.4f};std={spread:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};zeros={counts[0]};rows={len(samples) // WIDTH}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "_media", 1 << 20):
            rows = zip(*map(row, batch.column(batch.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(rows, added.values()))], [*keep, *added])

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(c, kinds[t]) for c, t in added.items())])
    return df.select(*keep, F.col(media_col).alias("_media")).mapInArrow(run, schema)
