"""Lossless WebP in numpy: a decoder of the whole format, and an encoder.

Pixels are uint32 numbers, alpha, red, green, blue from the highest byte. Streams with one group of
prefix codes and no colour cache are decoded by table look-ups at all bit positions of a block at
once, with the true positions picked out by pointer doubling; others symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MOST = 1 << 14  # pixels in a row, and rows

# Fixed values of the format: the order of code length codes, and the offsets (x, y) of the first 120 distance codes.
_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
_NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
_CACHE_FACTOR = 0x1E35A7BD
_BLACK = 0xFF000000
_PREDICTOR, _CROSS, _SUBTRACT_GREEN, _PALETTE = range(4)


def _reversals(bits: int) -> np.ndarray:
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for k in range(bits):
        out |= (x >> k & 1) << (bits - 1 - k)
    return out


_REVERSED = [_reversals(b) for b in range(16)]
_EXTRA = [0 if c < 4 else (c - 2) >> 1 for c in range(40)]
_OFFSET = [c if c < 4 else (2 + (c & 1)) << ((c - 2) >> 1) for c in range(40)]
_EXTRA_OF, _OFFSET_OF = np.array(_EXTRA), np.array(_OFFSET, np.int64)


class Code:
    """A prefix code. ``table[bits]`` is symbol << 4 | length, by the next ``width`` bits of the stream."""

    def __init__(self, lengths: Sequence[int], single: int | None = None):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if single is not None or len(used) == 1:  # such a code takes no bits
            self.width, self.table = 0, np.array([int(used[0] if single is None else single) << 4], np.int32)
            return
        if not len(used):
            raise ValueError("a prefix code without symbols")
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order]
        self.width = int(size[-1])
        if int((1 << (self.width - size)).sum()) != 1 << self.width:
            raise ValueError("a prefix code that is not complete")
        self.table = np.repeat(order << 4 | size, 1 << (self.width - size))[_REVERSED[self.width]].astype(np.int32)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends early")
        return value & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        first = self.at >> 3
        value = int.from_bytes(self.data[first : first + 3], "little") >> (self.at & 7)
        entry = int(code.table[value & ((1 << code.width) - 1)])
        self.at += entry & 15
        return entry >> 4

    def code(self, symbols: int) -> Code:
        if self.bits(1):
            two, wide = self.bits(1), self.bits(1)
            one = self.bits(8 if wide else 1)
            if not two:
                return Code([], one)
            lengths = np.zeros(max(symbols, 256), int)
            lengths[one] = lengths[self.bits(8)] = 1
            return Code(lengths)
        own = [0] * 19
        for k in range(4 + self.bits(4)):
            own[_LENGTH_ORDER[k]] = self.bits(3)
        code = Code(own)
        most = 2 + self.bits(2 + 2 * self.bits(3)) if self.bits(1) else symbols
        lengths, last = [], 8
        while len(lengths) < symbols and most:
            most -= 1
            s = self.symbol(code)
            if s < 16:
                lengths.append(s)
                last = s or last
            else:
                lengths += [last if s == 16 else 0] * ((3, 3, 11)[s - 16] + self.bits((2, 3, 7)[s - 16]))
        if len(lengths) > symbols:
            raise ValueError("too many code lengths")
        return Code(lengths + [0] * (symbols - len(lengths)))

    def number(self, prefix: int) -> int:
        return _OFFSET[prefix] + self.bits(_EXTRA[prefix]) + 1

    def image(self, width: int, height: int, main: bool = False) -> np.ndarray:
        cache = self.bits(4) if self.bits(1) else 0
        tiles, tile_bits, groups = None, 0, 1
        if main and self.bits(1):
            tile_bits = self.bits(3) + 2
            tiles = self.image(-(-width >> tile_bits), -(-height >> tile_bits)) >> 8 & 0xFFFF
            groups = int(tiles.max()) + 1
        codes = [[self.code(n) for n in (280 + (1 << cache if cache else 0), 256, 256, 256, 40)] for _ in range(groups)]
        if groups == 1 and not cache:
            return self.fast(codes[0], width, width * height)
        return self.slow(codes, width, width * height, cache, tiles, tile_bits)

    @staticmethod
    def distance(code: int, width: int) -> int:
        if code > 120:
            return code - 120
        x, y = _NEAR[code - 1]
        return max(1, x + y * width)

    def slow(self, groups: list[list[Code]], width: int, n: int, cache: int, tiles: np.ndarray | None, tile_bits: int) -> np.ndarray:
        out, seen, k, stored = [0] * n, [0] * (1 << cache), 0, 0
        across = -(-width >> tile_bits)
        while k < n:
            own = groups[0 if tiles is None else int(tiles[(k // width >> tile_bits) * across + (k % width >> tile_bits)])]
            s = self.symbol(own[0])
            if s < 256:
                red, blue, alpha = (self.symbol(own[c]) for c in (1, 2, 3))
                out[k] = alpha << 24 | red << 16 | s << 8 | blue
                k += 1
            elif s < 280:
                length = self.number(s - 256)
                back = self.distance(self.number(self.symbol(own[4])), width)
                if back > k or k + length > n:
                    raise ValueError("a reference leaves the image")
                for _ in range(length):
                    out[k] = out[k - back]
                    k += 1
            else:
                while stored < k:
                    seen[(_CACHE_FACTOR * out[stored] & 0xFFFFFFFF) >> (32 - cache)] = out[stored]
                    stored += 1
                out[k] = seen[s - 280]
                k += 1
        return np.array(out, np.uint32)

    def fast(self, codes: list[Code], width: int, n: int, block: int = 1 << 15) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        green, others, far = codes[0], codes[1:4], codes[4]
        plain = not any(c.width for c in others)
        constant = int(others[2].table[0]) >> 4 << 24 | int(others[0].table[0]) >> 4 << 16 | int(others[1].table[0]) >> 4
        if not green.width and plain and int(green.table[0]) >> 4 < 256:
            out[:] = constant | int(green.table[0]) >> 4 << 8
            return out
        backs = bool(((green.table >> 4) >= 256).any())
        k, data = 0, np.frombuffer(self.data, np.uint8)
        while k < n:
            first = self.at >> 3
            if self.at >= 8 * len(data):
                raise ValueError("the stream ends early")
            part = np.zeros(min(block, len(data) - first) + 24, np.uint32)
            have = data[first : first + len(part)]
            part[: len(have)] = have
            # What follows each bit position: 25 bits at least.
            word = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
            whole = len(word) - 12 if first + len(part) < len(data) else len(word)
            stream = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
            entry = green.table[stream & np.uint32((1 << green.width) - 1)]
            size = entry & 15
            limit = len(stream) - 1
            if not plain:
                at = np.arange(len(stream)) + size
                pixel = entry >> 4 << 8
                for code, shift in zip(others, (16, 0, 24)):
                    e = code.table[stream[np.minimum(at, limit)] & np.uint32((1 << code.width) - 1)]
                    pixel, at = pixel | (e >> 4).astype(np.int64) << shift, at + (e & 15)
                size = np.where(entry >> 4 < 256, at - np.arange(len(stream)), size)
            if backs:
                refs = np.flatnonzero(entry >> 4 >= 256)
                prefix = (entry[refs] >> 4) - 256
                at = refs + (entry[refs] & 15)
                length = _OFFSET_OF[prefix] + (stream[np.minimum(at, limit)] & ((1 << _EXTRA_OF[prefix]) - 1).astype(np.uint32)) + 1
                at = np.minimum(at + _EXTRA_OF[prefix], limit)
                e = far.table[stream[at] & np.uint32((1 << far.width) - 1)]
                prefix, at = e >> 4, np.minimum(at + (e & 15), limit)
                # Extra bits of a distance can be more than one word holds from its position: two reads.
                low = stream[at] & np.uint32(0xFFFF)
                high = stream[np.minimum(at + 16, limit)] & np.uint32(0xFFFF)
                extra = (low.astype(np.int64) | high.astype(np.int64) << 16) & ((1 << _EXTRA_OF[prefix]) - 1)
                code = _OFFSET_OF[prefix] + extra + 1
                size = size.copy()
                size[refs] = at + _EXTRA_OF[prefix] - refs
            jumps = [np.minimum(np.arange(len(stream)) + size, limit).astype(np.int32)]
            for _ in range(4):
                jumps.append(jumps[-1][jumps[-1]])
            start, end, sixteen = self.at - 8 * first, 8 * whole, jumps[4]
            heads, p, most = [], start, (n - k + 15) // 16
            while p < end and len(heads) < most:
                heads.append(p)
                step = sixteen.item(p)
                if step == p:
                    break
                p = step
            places = np.array(heads, np.int32)[:, None]
            for level in (3, 2, 1, 0):
                places = np.stack([places, jumps[level][places]], axis=2).reshape(len(heads), -1)
            places = places.ravel()
            places = places[: np.searchsorted(places, end)][: n - k]
            symbols = entry[places] >> 4
            if not backs or not (symbols >= 256).any():
                out[k : k + len(places)] = symbols.astype(np.uint32) << np.uint32(8) | np.uint32(constant) if plain else pixel[places].astype(np.uint32)
                k += len(places)
            else:
                is_ref = symbols >= 256
                which = np.searchsorted(refs, places[is_ref])
                lengths = np.ones(len(places), np.int64)
                lengths[is_ref] = length[which]
                ends = k + np.cumsum(lengths)
                taken = min(int(np.searchsorted(ends, n)) + 1, len(places))
                places, symbols, is_ref, ends, lengths = places[:taken], symbols[:taken], is_ref[:taken], ends[:taken], lengths[:taken]
                if ends[-1] > n:
                    raise ValueError("a reference leaves the image")
                lone = ~is_ref
                out[ends[lone] - 1] = symbols[lone].astype(np.uint32) << np.uint32(8) | np.uint32(constant) if plain else pixel[places[lone]].astype(np.uint32)
                for to, count, c in zip(ends[is_ref].tolist(), lengths[is_ref].tolist(), code[which].tolist()):
                    back, to = self.distance(c, width), to - count
                    if back > to:
                        raise ValueError("a reference leaves the image")
                    out[to : to + count] = np.resize(out[to - back : to], count) if back < count else out[to - back : to - back + count]
                k = int(ends[-1])
            self.at = 8 * first + int(places[-1]) + int(size[places[-1]])
            if self.at > 8 * len(data):
                raise ValueError("the stream ends early")
        return out


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = (channels & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left, top, right, corner):
    """The prediction from the pixels to the left, above, above to the right, above to the left; channels last."""
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode < 10:
        return ((left + corner) // 2, (left + top) // 2, (corner + top) // 2, (top + right) // 2)[mode - 6]
    if mode == 10:
        return ((left + corner) // 2 + (top + right) // 2) // 2
    if mode == 11:
        far_left = np.abs(top - corner).sum(axis=-1, keepdims=True)
        far_top = np.abs(left - corner).sum(axis=-1, keepdims=True)
        return np.where(far_left < far_top, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    mean = (left + top) // 2
    half = mean - corner
    return np.clip(mean + np.where(half >= 0, half // 2, -(-half // 2)), 0, 255)


def _unpredict(argb: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    c = _channels(argb).reshape(-1, width, 4)
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0] = np.cumsum(c[0], axis=0) & 255
    modes = (modes >> np.uint32(8) & np.uint32(15)).reshape(-1, -(-width >> bits))
    for y in range(1, len(c)):
        above, row = c[y - 1], c[y]
        row[0] = (row[0] + above[0]) & 255
        for tile, mode in enumerate(modes[y >> bits].tolist()):
            a, b = max(1, tile << bits), min(width, (tile + 1) << bits)
            if a >= b:
                continue
            # Above to the right of the last pixel is the first pixel of this row.
            right = np.concatenate([above[a + 1 : b + 1], row[:1]])[: b - a]
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):
                row[a:b] = (row[a:b] + _predict(mode, None, above[a:b], right, above[a - 1 : b - 1])) & 255 if mode not in (8, 9) else (row[a:b] + ((above[a - 1 : b - 1] if mode == 8 else right) + above[a:b]) // 2) & 255
            elif mode == 1:
                row[a - 1 : b] = np.cumsum(row[a - 1 : b], axis=0) & 255
            else:
                for x in range(a, b):
                    row[x] = (row[x] + _predict(mode, row[x - 1], above[x], right[x - a], above[x - 1])) & 255
    return _pixels(c).reshape(-1)


def _delta(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int32) * c.astype(np.int8).astype(np.int32)) >> 5


def _tile_of(width: int, height: int, bits: int) -> np.ndarray:
    across = -(-width >> bits)
    return ((np.arange(height) >> bits)[:, None] * across + (np.arange(width) >> bits)).ravel()


def _cross(argb: np.ndarray, width: int, tiles: np.ndarray, bits: int, sign: int) -> np.ndarray:
    c, t = _channels(argb), _channels(tiles)[_tile_of(width, len(argb) // width, bits)]
    green, red = c[:, 2], c[:, 1]
    new_red = (red + sign * _delta(t[:, 3], green)) & 255
    own = new_red if sign > 0 else red  # the decoder has the true red by then
    blue = c[:, 3] + sign * (_delta(t[:, 2], green) + _delta(t[:, 1], own))
    return _pixels(np.stack([c[:, 0], new_red, green, blue], axis=-1))


def _green(argb: np.ndarray, sign: int) -> np.ndarray:
    """Adds green to red and blue, or takes it away; both in one multiplication, masked to their bytes."""
    green = (argb >> np.uint32(8) & np.uint32(255)) * np.uint32(0x00010001)
    rest = argb & np.uint32(0x00FF00FF)
    changed = rest + green if sign > 0 else (rest | np.uint32(0x01000100)) - green
    return argb & np.uint32(0xFF00FF00) | changed & np.uint32(0x00FF00FF)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """Pixels in rows, width and height of a lossless WebP file; ValueError if it isn't one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    r = _Reader(data[at + 8 : at + 8 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("no lossless image")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("an unknown version")
    steps, now = [], width
    while r.bits(1):
        kind = r.bits(2)
        if kind in (_PREDICTOR, _CROSS):
            bits = r.bits(3) + 2
            steps.append((kind, now, bits, r.image(-(-now >> bits), -(-height >> bits))))
        elif kind == _PALETTE:
            n = r.bits(8) + 1
            colours = _pixels(np.cumsum(_channels(r.image(n, 1)), axis=0))
            steps.append((kind, now, _bundle_bits(n), colours))
            now = -(-now >> _bundle_bits(n))
        else:
            steps.append((kind, now, 0, None))
    argb = r.image(now, height, main=True)
    for kind, width_before, bits, own in reversed(steps):
        if kind == _PREDICTOR:
            argb = _unpredict(argb, width_before, own, bits)
        elif kind == _CROSS:
            argb = _cross(argb, width_before, own, bits, 1)
        elif kind == _SUBTRACT_GREEN:
            argb = _green(argb, 1)
        else:
            index = (argb >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
            if bits:
                per, deep = 1 << bits, 8 >> bits
                index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * np.uint32(deep)) & np.uint32((1 << deep) - 1)).reshape(height, -1)[:, :width_before]
            table = np.zeros(256, np.uint32)
            table[: len(own)] = own
            argb = table[index.ravel()]
    return argb, width, height


# Encoding


class _Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= int(value) << self.at
        self.at += n


def code_lengths(counts: Sequence[int], most: int = 12) -> list[int]:
    """Lengths of a prefix code, none above ``most``: two queues merge the least counts; if too deep, counts are flattened."""
    used = sorted((int(c), s) for s, c in enumerate(counts) if c)
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0][1]] = 1
    if len(used) < 2:
        return lengths
    while True:
        leaves, inner, parent = [c for c, _ in used], [], [0] * (2 * len(used) - 1)
        i = j = 0
        for made in range(len(used), 2 * len(used) - 1):
            total = 0
            for _ in range(2):
                if j >= len(inner) or (i < len(leaves) and leaves[i] <= inner[j]):
                    total += leaves[i]
                    parent[i] = made
                    i += 1
                else:
                    total += inner[j]
                    parent[len(used) + j] = made
                    j += 1
            inner.append(total)
        depth = [0] * len(parent)
        for node in range(len(parent) - 2, -1, -1):
            depth[node] = depth[parent[node]] + 1
        if max(depth) <= most:
            for (_, s), d in zip(used, depth):
                lengths[s] = d
            return lengths
        used = sorted(((c + 1) // 2, s) for c, s in used)


def _canonical(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol's bits as they stand in the stream, and their number; a lone symbol takes none."""
    lengths = np.asarray(lengths)
    used = np.flatnonzero(lengths)
    values, sizes = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    if len(used) > 1:
        order = used[np.lexsort((used, lengths[used]))]
        size = lengths[order]
        wide = int(size[-1])
        code = (np.cumsum(1 << (wide - size)) - (1 << (wide - size))) >> (wide - size)
        values[order] = _REVERSED[wide][code << (wide - size)]
        sizes[order] = size
    return values, sizes


def _write_code(w: _Writer, lengths: Sequence[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        w.bits(1, 1)
        w.bits(len(used) - 1, 1)
        w.bits(used[0] > 1, 1)
        w.bits(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.bits(used[1], 8)
        return
    steps, k, n = [], 0, len(lengths)
    while k < n:
        run = 1
        while k + run < n and lengths[k + run] == lengths[k] and run < 138:
            run += 1
        if lengths[k] == 0 and run >= 3:
            steps.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3))
            k += run
        else:
            steps.append((lengths[k], 0, 0))
            k += 1
    counts = [0] * 19
    for s, _, _ in steps:
        counts[s] += 1
    own = code_lengths(counts, 7)
    values, sizes = (x.tolist() for x in _canonical(own))
    w.bits(0, 1)
    last = max(k for k in range(19) if own[_LENGTH_ORDER[k]] or k < 4)
    w.bits(last - 3, 4)
    for k in range(last + 1):
        w.bits(own[_LENGTH_ORDER[k]], 3)
    w.bits(0, 1)
    for s, extra, wide in steps:
        w.bits(values[s], sizes[s])
        w.bits(extra, wide)


def _prefix(value: int) -> tuple[int, int, int]:
    """Prefix code, extra value and its number of bits, of a length or distance of 1 or more."""
    value -= 1
    if value < 4:
        return value, 0, 0
    top = value.bit_length() - 1
    half = value >> (top - 1) & 1
    return 2 * top + half, value & ((1 << (top - 1)) - 1), top - 1



def runs(argb: np.ndarray, back: int, least: int = 24) -> list[tuple[int, int]]:
    """Place and length of the stretches that repeat what is ``back`` pixels before; 4096 pixels at most each."""
    same = np.flatnonzero(np.diff(np.concatenate([[False], argb[back:] == argb[:-back], [False]]).astype(np.int8))) if len(argb) > back else np.zeros(0, int)
    out = []
    for a, b in zip(same[0::2].tolist(), same[1::2].tolist()):
        while b - a >= least:
            n = min(4096, b - a)
            out.append((a + back, n))
            a += n
    return out


def _write_image(w: _Writer, argb: np.ndarray, main: bool, width: int, cache: int = 0, back: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Header to ``w``; returns the arrays of values and sizes that follow. ``back``: distance of the references that are looked for."""
    refs = runs(argb, back) if back else []
    lone = np.ones(len(argb), bool)
    for at, n in refs:
        lone[at : at + n] = False
    places = np.flatnonzero(lone)
    pixels = argb[places]
    green = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    hits = np.zeros(len(places), bool)
    if cache:
        seen, slots = {}, ((np.uint64(_CACHE_FACTOR) * argb.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache)
        at_place = np.zeros(len(argb), bool)
        for k, (slot, pixel) in enumerate(zip(slots.tolist(), argb.tolist())):
            at_place[k] = seen.get(slot, 0) == pixel
            seen[slot] = pixel
        hits = at_place[places]
        green = np.where(hits, 280 + slots[places].astype(np.int64), green)
    channels = [(pixels[~hits] >> np.uint32(s) & np.uint32(255)).astype(np.int64) for s in (16, 0, 24)]
    lengths_of = [_prefix(n) for _, n in refs]
    far = _prefix(back + 120) if refs else (0, 0, 0)
    counts = np.bincount(green, minlength=280 + (1 << cache if cache else 0))
    for p, _, _ in lengths_of:
        counts[256 + p] += 1
    w.bits(bool(cache), 1)
    if cache:
        w.bits(cache, 4)
    if main:
        w.bits(0, 1)
    codes = []
    for count in (counts, *(np.bincount(c, minlength=256) for c in channels), np.bincount([far[0]] * len(refs), minlength=40)):
        lengths = code_lengths(count.tolist())
        _write_code(w, lengths)
        codes.append(_canonical(lengths))
    values, sizes = codes[0][0][green], codes[0][1][green]
    for (v, s), c in zip(codes[1:4], channels):
        if s.any():  # channels of one value take no bits
            full_v, full_s = np.zeros(len(green), np.uint64), np.zeros(len(green), np.int64)
            full_v[~hits], full_s[~hits] = v[c], s[c]
            values, sizes = values | full_v << sizes.astype(np.uint64), sizes + full_s
    if refs:
        v, s = [], []
        for p, extra, wide in lengths_of:
            bits, size = int(codes[0][0][256 + p]), int(codes[0][1][256 + p])
            bits, size = bits | extra << size, size + wide
            bits, size = bits | int(codes[4][0][far[0]]) << size, size + int(codes[4][1][far[0]])
            v.append(bits | far[1] << size)
            s.append(size + far[2])
        order = np.argsort(np.concatenate([places, [at for at, _ in refs]]), kind="stable")
        values, sizes = np.concatenate([values, np.array(v, np.uint64)])[order], np.concatenate([sizes, s])[order]
    return [(values, sizes)]


def _pack(header: _Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The header's bits, then all values, each of 64 bits at most, in so many bits."""
    ends = header.at + np.cumsum(sizes)
    words = np.zeros((int(ends[-1]) if len(ends) else header.at) // 64 + 2, np.uint64)
    head = header.value.to_bytes((header.at + 7) // 8 + 8, "little")
    head = np.frombuffer(head[: len(head) // 8 * 8], np.uint64)
    words[: len(head)] = head[: len(words)]
    at = ends - sizes
    some = sizes > 0
    at, values, sizes = at[some], values[some], sizes[some]
    if len(at):
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
        over = (at & 63) + sizes > 64
        if over.any():  # one value at most runs over from each word
            words[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return words.tobytes()[: (int(ends[-1] if len(ends) else header.at) + 7) // 8]


def encode(argb: np.ndarray, width: int, transforms: Sequence[tuple] = (("green",),), cache: int = 0, back: int = 1) -> bytes:
    """A lossless WebP file of the pixels, rows of ``width``.

    ``transforms`` in order: ("green",), ("palette",) for up to 256 colours, ("predictor", bits, mode)
    and ("cross", bits, red_to_blue, green_to_blue, green_to_red). ``cache``: bits of the colour cache;
    ``back``: distance in pixels of the repeats that become references, 0 for none.
    """
    argb = np.ascontiguousarray(argb, np.uint32)
    height = len(argb) // width
    if not 1 <= width <= MOST or not 1 <= height <= MOST or width * height != len(argb):
        raise ValueError("no such image")
    w, now = _Writer(), width
    w.bits(0x2F, 8)
    w.bits(width - 1, 14)
    w.bits(height - 1, 14)
    w.bits(bool(((argb >> np.uint32(24)) != 255).any()), 1)
    w.bits(0, 3)

    def small_image(pixels: np.ndarray, wide: int) -> None:
        for values, sizes in _write_image(w, pixels, False, wide):
            for v, s in zip(values.tolist(), sizes.tolist()):
                w.bits(v, s)

    for name, *own in transforms:
        w.bits(1, 1)
        if name == "green":
            w.bits(_SUBTRACT_GREEN, 2)
            argb = _green(argb, -1)
        elif name == "palette":
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("more than 256 colours")
            w.bits(_PALETTE, 2)
            w.bits(len(colours) - 1, 8)
            c = _channels(colours)
            small_image(_pixels(np.diff(c, axis=0, prepend=0)), len(colours))
            bits = _bundle_bits(len(colours))
            per, deep = 1 << bits, 8 >> bits
            wide = -(-now >> bits)
            index = np.pad(index.reshape(height, now), ((0, 0), (0, wide * per - now))).reshape(height, wide, per)
            index = (index << np.arange(per) * deep).sum(axis=2).ravel()
            argb, now = (index.astype(np.uint32) << np.uint32(8)) | np.uint32(_BLACK), wide
        elif name == "predictor":
            bits, mode = own
            w.bits(_PREDICTOR, 2)
            w.bits(bits - 2, 3)
            tiles = np.full(-(-now >> bits) * -(-height >> bits), _BLACK | mode << 8, np.uint32)
            small_image(tiles, -(-now >> bits))
            c = _channels(argb).reshape(height, now, 4)
            flat = c.reshape(-1, 4)
            expect = np.zeros_like(c)
            expect[0, 0] = [255, 0, 0, 0]
            expect[0, 1:] = c[0, :-1]
            expect[1:, 0] = c[:-1, 0]
            if height > 1 and now > 1:
                right = flat[1 : 1 + now * (height - 1)].reshape(height - 1, now, 4)
                expect[1:, 1:] = _predict(mode, c[1:, :-1], c[:-1, 1:], right[:, 1:], c[:-1, :-1])
            argb = _pixels((c - expect).reshape(-1, 4))
        elif name == "cross":
            bits, *t = own
            w.bits(_CROSS, 2)
            w.bits(bits - 2, 3)
            tiles = np.full(-(-now >> bits) * -(-height >> bits), _BLACK | t[0] << 16 | t[1] << 8 | t[2], np.uint32)
            small_image(tiles, -(-now >> bits))
            argb = _cross(argb, now, tiles, bits, -1)
        else:
            raise ValueError(name)
    w.bits(0, 1)
    ((values, sizes),) = _write_image(w, argb, True, now, cache, back)
    body = _pack(w, values, sizes)
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


__all__ = ["MOST", "code_lengths", "decode", "encode", "runs"]
