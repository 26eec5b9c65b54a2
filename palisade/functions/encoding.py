"""Encoded segments: detection, decoding and redaction in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import catalog
from .regex import extract, java, let, matches, positions

_KIND = "array<struct<type:string,original:string,decoded:string,position:int,length:int,suspicious:boolean>>"
# What encoded segments look like.
_BASE64 = r"[A-Za-z0-9+/]{20,}={0,2}"
_URL = r"(?:%[0-9A-Fa-f]{2}){3,}"
_HEX = r"(?:\\x[0-9A-Fa-f]{2}){4,}"
_ESCAPES = r"(?:\\u[0-9A-Fa-f]{4}){3,}"


def _segments(text: Column, kind: str, pattern: str, decode) -> Column:
    found, at = extract(text, pattern), positions(text, pattern)

    def of(x: Column, i: Column) -> Column:
        valid, decoded = decode(x)
        suspicious = F.coalesce(matches(decoded, java(catalog.DECODED_WORDS)), F.lit(False))
        return F.when(valid, F.struct(F.lit(kind).alias("type"), x.alias("original"), decoded.alias("decoded"), F.get(at, i).alias("position"), F.length(x).alias("length"), suspicious.alias("suspicious")))

    return F.when(matches(text, pattern), F.filter(F.transform(found, of), lambda d: d.isNotNull())).otherwise(F.array().cast(_KIND))


def _base64(least: int):
    def decode(x: Column) -> tuple[Column, Column]:
        core = F.rtrim(x, F.lit("="))
        need = F.pmod(-F.length(core), F.lit(4))
        whole = (F.length(x) >= least) & (F.length(core) % 4 != 1) & (F.length(x) - F.length(core) >= need)
        data = F.when(whole, F.try_to_binary(F.concat(core, F.repeat(F.lit("="), need)), F.lit("base64")))
        digits = F.hex(data)
        ascii_ = F.coalesce(matches(digits, "^(?:[0-7][0-9A-F])*$"), F.lit(False))
        printable = matches(digits, "^(?:[2-6][0-9A-F]|7[0-9A-E]|09|0A|0D)*$")
        return ascii_, F.when(ascii_ & printable, F.decode(data, "UTF-8"))

    return decode


def _url(x: Column) -> tuple[Column, Column]:
    decoded = F.try_url_decode(x)
    return F.coalesce(decoded != x, F.lit(False)), decoded


def _hex(x: Column) -> tuple[Column, Column]:
    return F.lit(True), F.decode(F.unhex(F.replace(x, F.lit("\\x"), F.lit(""))), "ISO-8859-1")


def _escapes(x: Column) -> tuple[Column, Column]:
    # Lone surrogates have no text in Spark: such segments show U+FFFD in their place.
    safe = F.regexp_replace(x, r"(?i)\\ud[89a-f][0-9a-f]{2}", r"\\ufffd")
    return F.lit(True), F.decode(F.unhex(F.replace(safe, F.lit("\\u"), F.lit(""))), "UTF-16BE")


def detections(text: Column, min_base64_length: int = 20, decode_base64: bool = True, decode_url: bool = True) -> Column:
    """``array<struct<type,original,decoded,position,length,suspicious>>``: base64, url, hex, unicode_escape, each in place order."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    if decode_base64:
        parts.append(_segments(text, "base64", _BASE64, _base64(min_base64_length)))
    if decode_url:
        parts.append(_segments(text, "url", _URL, _url))
    parts += [_segments(text, "hex", _HEX, _hex), _segments(text, "unicode_escape", _ESCAPES, _escapes)]
    return F.flatten(F.array(*parts))


def rewrite(text: Column, found: Column, redact: str | None = "[ENCODED DATA]") -> Column:
    """The text with its detections replaced from right to left, by ``redact`` or, if None, by what they decode to.

    Where segments overlap, a later replacement cuts into the one made before, as slices at the
    original places do.
    """
    by = lambda d: F.coalesce(d["decoded"], d["original"]) if redact is None else F.lit(redact)
    keyed = F.transform(found, lambda d, i: F.struct((-d["position"]).alias("k"), i.alias("i"), d["position"].alias("p"), (d["position"] + d["length"]).alias("e"), by(d).alias("by")))
    # substr counts from 1; a start after the end gives the empty text
    step = lambda t, d: F.concat(F.substr(t, F.lit(1), d["p"]), d["by"], F.substr(t, d["e"] + 1, F.greatest(F.length(t) - d["e"], F.lit(0))))
    return F.when(F.size(found) > 0, F.aggregate(F.array_sort(keyed), text, step)).otherwise(text)


def detect(text: Column, action: str = "flag", redact: str = "[ENCODED DATA]", **options) -> Column:
    """``struct<has_encoding,encoding_types,detections,processed_text>``; types are sorted; action: flag, decode or redact."""
    found = F.struct(detections(text, **options).alias("d"))

    def finish(x: Column) -> Column:
        processed = F.lit(None).cast("string") if action == "flag" else F.when(F.size(x["d"]) > 0, rewrite(text, x["d"], redact if action == "redact" else None))
        kinds = F.array_sort(F.array_distinct(F.transform(x["d"], lambda d: d["type"])))
        return F.struct((F.size(x["d"]) > 0).alias("has_encoding"), kinds.alias("encoding_types"), x["d"].alias("detections"), processed.alias("processed_text"))

    return let(found, finish)


def contains_encoded(text: Column) -> Column:
    return F.size(detections(text)) > 0


def contains_suspicious(text: Column) -> Column:
    return F.exists(detections(text), lambda d: d["suspicious"])


def redact_all(text: Column, replacement: str = "[ENCODED DATA]") -> Column:
    return F.coalesce(detect(text, "redact", replacement)["processed_text"], text)


def decode_all(text: Column) -> Column:
    return F.coalesce(detect(text, "decode")["processed_text"], text)
