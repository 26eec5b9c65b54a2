import hashlib
import zlib

import numpy as np
import pytest

from palisade.llm import media, webp

RNG = np.random.default_rng(0)
SMOOTH = (np.add.outer(np.arange(40) * 3, np.arange(50) * 2) % 256).astype(np.uint32)
IMAGE = (0xFF000000 | (SMOOTH << 16) | (SMOOTH // 2 << 8) | (255 - SMOOTH)).ravel().astype(np.uint32)
IMAGE[::37] ^= 0x00112233
IMAGE[5:400] = IMAGE[4]


def trip(pixels, width, **options):
    back, w, h = webp.decode(webp.encode(pixels, width, **options))
    assert (w, h) == (width, len(pixels) // width) and (back == pixels).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    trip(IMAGE, 50, transforms=(("predictor", 3, mode),))


@pytest.mark.parametrize("cache", [0, 1, 2, 5, 11])
def test_colour_cache_and_references(cache):
    trip(IMAGE, 50, transforms=(), cache=cache)
    trip(IMAGE, 50, transforms=(("cross", 4, 20, 200, 50), ("green",)), cache=cache, back=50)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 16, 17, 100, 256])
def test_palettes(n):
    trip(RNG.integers(0, 2**32, n, dtype=np.uint32)[RNG.integers(0, n, 51 * 9)], 51, transforms=(("palette",),))


def test_long_streams():
    trip(RNG.integers(0, 2**32, 90_000, dtype=np.uint32), 300, transforms=())
    trip(RNG.choice(np.array([7, 9, 300, 90000, 2**31 + 5], np.uint32), 300_000, p=[0.9, 0.05, 0.03, 0.01, 0.01]), 400, transforms=())
    trip(np.resize(RNG.integers(0, 2**32, 64, dtype=np.uint32), 64 * 500), 64, transforms=(), back=64)
    trip(np.array([5], np.uint32), 1, transforms=())


def test_groups_of_prefix_codes():
    """A stream with an entropy image, written by hand: two tiles, each with codes of single symbols."""
    w = webp._Writer()
    for value, n in ((0x2F, 8), (8 - 1, 14), (4 - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        w.bits(value, n)
    ((values, sizes),) = webp._write_image(w, np.array([0xFF000000, 0xFF000100], np.uint32), False, 2)  # groups 0 and 1
    for v, s in zip(values.tolist(), sizes.tolist()):
        w.bits(v, s)
    for green in (10, 20):
        for symbol in (green, 1, 2, 255, 0):
            lengths = [0] * 280
            lengths[symbol] = 1
            webp._write_code(w, lengths)
    body = w.value.to_bytes((w.at + 7) // 8, "little")
    data = b"RIFF" + (12 + len(body)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    pixels, width, height = webp.decode(data)
    expect = np.where(np.arange(32) % 8 < 4, 0xFF010A02, 0xFF011402)
    assert (width, height) == (8, 4) and (pixels == expect).all()


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\x04\0\0\0WEBP", webp.encode(IMAGE, 50)[:200]])
def test_broken_files(data):
    with pytest.raises((ValueError, IndexError)):
        webp.decode(data)


def test_code_lengths_are_complete_and_bounded():
    for counts in ([1, 1], [5], [2**i for i in range(40)], RNG.integers(0, 100, 280).tolist()):
        lengths = webp.code_lengths(counts)
        assert max(lengths) <= 12
        if sum(c > 0 for c in counts) > 1:
            assert sum(2.0**-n for n in lengths if n) == 1


def test_store_and_describe(docs, rows, empty, clashing):
    got = media.describe(media.store(docs)).collect()
    expect = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        expect.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(expect, key=str)
    same = {}
    for r in got:
        same.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert media.describe(media.store(empty)).count() == 0 and media.describe(media.store(clashing)).count() == len(rows)


def test_long_payloads_are_several_images():
    payload = RNG.integers(32, 127, media.PART + 640, dtype=np.uint8).tobytes()
    stored = media.to_media(payload)
    assert len(list(media.images(stored))) == 2 and media.from_media(stored).tobytes() == payload


def test_pixel_arrays(spark):
    rows = [(0, bytearray(webp.encode(IMAGE, 50))), (1, None), (2, bytearray(b"no image"))]
    got = {r.id: r for r in media.pixel_arrays(spark.createDataFrame(rows, "id int, media binary")).collect()}
    image = got[0].images[0]
    rgba = np.frombuffer(bytes(image.pixels), np.uint8).reshape(-1, 4)
    assert (image.width, image.height) == (50, 40) and rgba[0].tolist() == [IMAGE[0] >> 16 & 255, IMAGE[0] >> 8 & 255, IMAGE[0] & 255, 255]
    assert got[1].images is None and got[2].images == [] and got[2].problem
