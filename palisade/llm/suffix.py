"""Removal of repeated byte strings by longest-previous-factor arrays over anchored suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, cut, octets, portions, text_key
from .resample import _INVERSE, _MULTIPLIER, _VALUES, powers

#: Bytes of a repeated string, and of the anchors inside it.
LENGTH, ANCHOR = 100, 50
_SIDE = LENGTH - ANCHOR
#: Contexts of one anchor that go into one suffix array; the suffixes of a larger group are dealt by the hash of their
#: first ``LENGTH`` bytes over many arrays: equal ones meet all the same.
GROUP = 16_000
#: Suffixes that a task gathers before it sends them on, and that make one array.
SUFFIXES = 400_000
#: Anchors that a task gathers before it sends them on, and contexts.
FLUSH, FLUSH_CONTEXTS = 1_000_000, 100_000
_ABSENT = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extremes(a: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The extreme of each ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        a = pick(a[:-size], a[size:])
        size *= 2
    return pick(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all texts: text, place in the text, hash, hash of the context, its first byte's distance.

    An anchor is a string of ``ANCHOR`` bytes whose hash is the least in a window of ``LENGTH`` bytes.
    Which ones a window has follows from its bytes alone, so equal windows have equal anchors.
    """
    n = len(data)
    if n < LENGTH:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64), empty
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers(_MULTIPLIER, n), out=sums[1:])
    back = powers(_INVERSE, n + 1)
    hashed = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: n - ANCHOR + 1]) | np.uint64(1)
    width = LENGTH - ANCHOR + 1
    least = _extremes(hashed, width, np.minimum)  # of the window from each place on
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least[text[: len(least)] != text[LENGTH - 1 :]] = 0  # no window runs over the end of a text
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(_extremes(np.concatenate([edge, least, edge]), width, np.maximum) == hashed)
    own = text[places]
    left = np.minimum(places - at[own], _SIDE)
    start, end = places - left, np.minimum(places + LENGTH, at[own + 1])
    context = _mix((sums[end] - sums[start]) * back[start] + (left * 1000 + end - places).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return own, places - at[own], hashed[places], context, left


def _pack(**arrays: np.ndarray) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes, **types) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(blob).read_next_batch()
    return {name: np.frombuffer(batch.column(name)[0].as_py(), kind) for name, kind in types.items()}


_ANCHORS = {"hash": np.uint32, "context": np.uint64, "text": np.int32, "pos": np.int64, "left": np.uint8, "size": np.uint8, "ids": np.int64, "keys": np.int64}


def _find_anchors(buckets: int):
    """Rows ``(bucket, blob, spans)``: anchors by bucket of their hash.

    Of equal contexts in one task only the first travels; the later ones are removed for sure, and
    travel as plain spans, dealt out evenly. So a string that a third of all texts share meets the
    task of its bucket once per sending task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, turn = 0, 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, turn
            ids, keys = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            shift = np.cumsum([0] + [len(h[0]) for h in held])
            text = np.concatenate([h[2] + s for h, s in zip(held, shift)])
            pos, hashed, context, left, size = (np.concatenate([h[i] for h in held]) for i in range(3, 8))
            held, count = [], 0
            order = np.lexsort((pos, keys[text], ids[text], context))
            same = np.concatenate([[False], (context[order][1:] == context[order][:-1]) & (hashed[order][1:] == hashed[order][:-1])])
            later = np.zeros(len(order), bool)
            later[order[same]] = True
            # The same place again, in a repeated row, is no later copy; it goes as the first does.
            first = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            twin = np.zeros(len(order), bool)
            twin[order] = same & (ids[text[order]] == ids[text[first]]) & (keys[text[order]] == keys[text[first]]) & (pos[order] == pos[first])
            sent, spans = ~later, later & ~twin
            bucket = (hashed >> np.uint64(32)) % np.uint64(buckets)
            rows = []
            for chosen, is_span in ((np.flatnonzero(sent), False), (np.flatnonzero(spans), True)):
                if is_span:
                    where = np.arange(len(chosen)) * 16 // max(len(chosen), 1) + turn
                    where = where * 7919 % buckets
                    turn += 16
                else:
                    where = bucket[chosen].astype(np.int64)
                by = np.argsort(where, kind="stable")
                cuts = np.flatnonzero(np.diff(where[by], prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
                    own = chosen[by[a:b]]
                    texts, index = np.unique(text[own], return_inverse=True)
                    rows.append((int(where[by[a]]), is_span, _pack(hash=(hashed[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), context=context[own] if not is_span else context[:0], text=index.astype(np.int32), pos=pos[own], left=left[own], size=size[own], ids=ids[texts], keys=keys[texts])))
            for a in range(0, len(rows), 64):
                part = rows[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part], pa.binary())], ["bucket", "spans", "blob"])

        for batch in portions(batches, "text", 1 << 20):
            at, data = octets(batch.column(2))
            text, pos, hashed, context, left = anchors(at, data)
            if len(text):
                ends = np.minimum(pos + LENGTH, np.diff(at)[text])
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), text, pos, hashed, context, left.astype(np.uint8), (ends - pos + left).astype(np.uint8)))
                count += len(text)
                if count >= FLUSH:
                    yield from send()
        if held:
            yield from send()

    return run


_MARKS = "id long, key long, kind int, pos long, size int, hash int"


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The rows of each bucket, without the bucket; rows come sorted by it, so one bucket is held at a time."""
    held, last = [], None
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and held:
                yield last, held
                held = []
            last = bucket
            held.append(row)
    if held:
        yield last, held


def _judge(group: int):
    """Marks of whole buckets: kind 0 is a span to remove; kind 1 an anchor whose contexts must be compared, as
    others have the same anchor in other contexts; kind 2 the same, of an anchor with more than ``group`` contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            for blob in (blob for spans, blob in held if spans):
                x = _unpack(blob, **_ANCHORS)
                yield _marks(x["ids"][x["text"]], x["keys"][x["text"]], 0, x["pos"] - x["left"], x["size"], x["hash"])
            parts = [_unpack(blob, **_ANCHORS) for spans, blob in held if not spans]
            if not parts:
                continue
            ids, keys = (np.concatenate([x[c][x["text"]] for x in parts]) for c in ("ids", "keys"))
            hashed, context, pos, left, size = (np.concatenate([x[c] for x in parts]) for c in ("hash", "context", "pos", "left", "size"))
            order = np.lexsort((pos, keys, ids, context, hashed))
            ids, keys, hashed, context, pos, left, size = (a[order] for a in (ids, keys, hashed, context, pos, left, size))
            new_hash = np.concatenate([[True], hashed[1:] != hashed[:-1]])
            new = new_hash | np.concatenate([[True], context[1:] != context[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            twin = ~new & (ids == ids[first]) & (keys == keys[first]) & (pos == pos[first])
            gone = ~new & ~twin
            yield _marks(ids[gone], keys[gone], 0, pos[gone] - left[gone], size[gone], hashed[gone])
            classes = np.bincount(np.cumsum(new_hash) - 1, weights=new)[np.cumsum(new_hash) - 1]
            for kind, chosen in ((1, new & (classes > 1) & (classes <= group)), (2, new & (classes > group))):
                yield _marks(ids[chosen], keys[chosen], kind, pos[chosen], size[chosen], hashed[chosen])

    return run


def _marks(ids, keys, kind, pos, size, hashed) -> pa.RecordBatch:
    n = len(ids)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys), pa.array(np.full(n, kind, np.int32)), pa.array(pos.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(hashed.view(np.int32) if hashed.dtype == np.uint32 else hashed)], ["id", "key", "kind", "pos", "size", "hash"])


_CONTEXTS = {"hash": np.uint32, "ids": np.int64, "keys": np.int64, "pos": np.int64, "left": np.uint8, "right": np.uint8, "bytes": np.uint8}
_WIDTH = _SIDE + LENGTH


def _cut_contexts(at: int, data: np.ndarray, length: int, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes around each anchor, in rows of one width, and how many of them are there to the left and right."""
    left, right = np.minimum(pos, _SIDE), np.minimum(length - pos, LENGTH)
    own = np.concatenate([np.zeros(_SIDE, np.uint8), data[at : at + length], np.zeros(LENGTH, np.uint8)])
    return own[pos[:, None] + np.arange(_WIDTH)], left, right


def _send_contexts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            ids, keys, hashed, pos, left, right, rows = (np.concatenate([h[i] for h in held]) for i in range(7))
            held, count = [], 0
            where = (hashed.astype(np.int64) * 2654435761 >> 7) % buckets
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
                own = by[a:b]
                blob = _pack(hash=hashed[own], ids=ids[own], keys=keys[own], pos=pos[own], left=left[own].astype(np.uint8), right=right[own].astype(np.uint8), bytes=rows[own])
                yield pa.RecordBatch.from_arrays([pa.array([int(where[own[0]])], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in portions(batches, "text", 4 << 20):
            at, data = octets(batch.column(2))
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values
            pos_all, hash_all = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(np.uint32)
            for i, (id_, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                pos, hashed = (x[offsets[i] : offsets[i + 1]] for x in (pos_all, hash_all))
                rows, left, right = _cut_contexts(int(at[i]), data, int(at[i + 1] - at[i]), pos)
                held.append((np.full(len(pos), id_), np.full(len(pos), key), hashed, pos, left, right, rows))
                count += len(pos)
            if count >= FLUSH_CONTEXTS:
                yield from send()
        if held:
            yield from send()

    return run


def _ranks(values: np.ndarray) -> np.ndarray:
    """Dense ranks of the values, in their shape."""
    return np.unique(values, return_inverse=True)[1].reshape(values.shape)


def _toward_smaller(place: np.ndarray, lcp: np.ndarray, most: int) -> np.ndarray:
    """Length that each suffix has in common with the nearest one before it, in suffix order, at a smaller place.

    ``lcp[i]`` is what suffixes i - 1 and i have in common; ``most`` bounds the suffixes in a row with a
    positive one. Minima over runs of 1, 2, 4, ... suffixes let all walks jump at once.
    """
    least, shared = [place], [lcp]
    while 1 << len(least) <= most:
        step = 1 << (len(least) - 1)
        least.append(np.concatenate([least[-1][:step], np.minimum(least[-1][step:], least[-1][:-step])]))
        shared.append(np.concatenate([shared[-1][:step], np.minimum(shared[-1][step:], shared[-1][:-step])]))
    at, length = np.arange(len(place)) - 1, lcp.copy()
    for level in range(len(least) - 1, -1, -1):
        walk = np.flatnonzero((at >= (1 << level) - 1) & (length > 0))
        walk = walk[least[level][at[walk]] > place[walk]]
        length[walk] = np.minimum(length[walk], shared[level][at[walk]])
        at[walk] -= 1 << level
    length[at < 0] = 0
    return length


def longest_previous_factors(rows: np.ndarray, valid: np.ndarray, place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array of suffixes, lengths up to ``LENGTH``: how much of each also starts at a smaller place.

    ``rows``: contexts, one a row; suffixes start at its first columns, as many as ``valid`` has, which tells those
    that have all their bytes. ``place``: where each starts in the corpus; ``group``: each row's
    anchor; suffixes of different ones are in different arrays. The suffix array comes from prefix
    doubling to ``LENGTH`` bytes, equal suffixes in the order of places; common lengths of neighbours
    are read off their bytes. The previous and next suffixes in this order with a smaller place have
    the longest factors, and the longer one counts. Among equal suffixes the previous one is such a place;
    the first of them has its own in other suffixes. A place that two contexts share is no copy of itself.
    """
    row, column = np.nonzero(valid)
    if not len(row):
        return np.zeros(valid.shape, np.uint8)
    wide = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(rows, 8, axis=1)).view(">u8")[:, :, 0]
    rank, size = _ranks(wide).astype(np.int64), 8
    while size < LENGTH:
        step = min(size, LENGTH - size)
        rank = _ranks(rank[:, : rank.shape[1] - step] * (int(rank.max()) + 1) + rank[:, step:]).astype(np.int64)
        size += step
    rank, place = rank[row, column], place[row, column]
    order = np.lexsort((place, rank, group[row]))
    own, rank, place = group[row][order], rank[order], place[order]
    new_group = np.concatenate([[True], own[1:] != own[:-1]])
    new = new_group | np.concatenate([[True], rank[1:] != rank[:-1]])
    again = ~new & np.concatenate([[False], place[1:] == place[:-1]])  # the same place in another context
    heads = np.flatnonzero(new)
    # Common lengths of neighbouring classes of equal suffixes, by their bytes.
    views = np.lib.stride_tricks.sliding_window_view(rows, LENGTH, axis=1)
    lcp = np.zeros(len(heads), np.uint8)
    linked = np.flatnonzero(~new_group[heads])
    for a in range(0, len(linked), 50_000):
        part = linked[a : a + 50_000]
        x, y = order[heads[part]], order[heads[part - 1]]
        lcp[part] = (views[row[x], column[x]] != views[row[y], column[y]]).argmax(axis=1)
    most = int(np.bincount(np.cumsum(new_group[heads]) - 1).max())
    before = _toward_smaller(place[heads], lcp, most)
    after = _toward_smaller(place[heads][::-1], np.concatenate([[0], lcp[:0:-1]]).astype(np.uint8), most)[::-1]
    factor = np.full(len(order), LENGTH, np.uint8)
    factor[heads] = np.maximum(before, after)
    # What repeats the place before it has the factor of the first of them.
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
    out = np.zeros(valid.shape, np.uint8)
    out[row[order], column[order]] = factor[first]
    return out


def _places_in_order(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Numbers of the texts, by (id, key), far enough apart for places in them."""
    order = np.lexsort((keys, ids))
    change = np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])])
    text = np.empty(len(ids), np.int64)
    text[order] = np.cumsum(change)
    return text << 40


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the windows in the contexts of whole buckets that occur earlier."""
    for _, held in _by_bucket(batches):
        parts = [_unpack(blob, **_CONTEXTS) for (blob,) in held]
        hashed, ids, keys, pos, left, right = (np.concatenate([x[c] for x in parts]) for c in list(_CONTEXTS)[:6])
        rows = np.concatenate([x["bytes"].reshape(-1, _WIDTH) for x in parts])
        order = np.lexsort((pos, keys, ids, hashed))
        edges = np.concatenate([np.flatnonzero(np.diff(hashed[order].astype(np.int64), prepend=-1)), [len(order)]])
        start = 0
        while start < len(edges) - 1:  # as many whole groups as make arrays of a bounded size
            end = max(start + 1, int(np.searchsorted(edges, edges[start] + SUFFIXES // (_SIDE + 1), "right")) - 1)
            own = order[edges[start] : edges[end]]
            start = end
            places = pos[own][:, None] - _SIDE + np.arange(_SIDE + 1)
            valid = (np.arange(_SIDE + 1) >= _SIDE - left[own].astype(int)[:, None]) & (LENGTH - _SIDE + np.arange(_SIDE + 1) <= right[own].astype(int)[:, None])
            factors = longest_previous_factors(rows[own], valid, _places_in_order(ids[own], keys[own])[:, None] + places, hashed[own])
            yield from _runs(ids[own], keys[own], places, factors >= LENGTH)


def _runs(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, reached: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of neighbouring windows, joined."""
    edge = np.diff(np.pad(reached.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    if len(row):
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(keys[row]), pa.array(places[row, first]), pa.array((last - first - 1 + LENGTH).astype(np.int32))], ["id", "key", "pos", "size"])


_SUFFIXES = {"sure": np.bool_, "ids": np.int64, "keys": np.int64, "pos": np.int64, "bytes": np.uint8}


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A hash of each row's ``LENGTH`` bytes."""
    wide = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    wide[:, :LENGTH] = rows
    out = np.zeros(len(rows), np.uint64)
    for word in wide.view(np.uint64).T:
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out


def _send_suffixes(buckets: int, most: int):
    """Rows ``(bucket, blob)``: the suffixes of large groups, dealt by the hash of their first bytes.

    Those with an earlier copy in the same task are repeats for sure and travel without their bytes, dealt out
    evenly; so a passage that a third of all texts share meets the task of its bucket once per sending.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            ids, keys, pos, rows = (np.concatenate([h[i] for h in held]) for i in range(4))
            held, count = [], 0
            where = _row_hashes(rows)
            sure = _repeated(ids, keys, pos, rows, where) >= LENGTH
            where = np.where(sure, np.arange(len(sure)).astype(np.uint64) * np.uint64(16) // np.uint64(max(len(sure), 1)), where) % np.uint64(buckets)
            by = np.lexsort((pos, keys, ids, sure, where))
            cuts = np.flatnonzero(np.diff(where[by].astype(np.int64), prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)]):
                own = by[a:b]
                blob = _pack(sure=sure[own], ids=ids[own], keys=keys[own], pos=pos[own], bytes=rows[own[~sure[own]]])
                yield pa.RecordBatch.from_arrays([pa.array([int(where[own[0]])], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for batch in portions(batches, "text", 1 << 20):
            at, data = octets(batch.column(2))
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.field(0).to_numpy()
            for i, (id_, key) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                text = data[at[i] : at[i + 1]]
                places = np.unique((flat[offsets[i] : offsets[i + 1]][:, None] - np.arange(_SIDE + 1)).ravel())
                places = places[(places >= 0) & (places + LENGTH <= len(text))]
                for a in range(0, len(places), most):
                    part = places[a : a + most]
                    held.append((np.full(len(part), id_), np.full(len(part), key), part, text[part[:, None] + np.arange(LENGTH)]))
                    count += len(part)
                    if count >= most:
                        yield from send()
        if held:
            yield from send()

    return run


def _repeated(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray, rows: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Longest previous factors of single suffixes; suffixes of one hash are one group."""
    return longest_previous_factors(rows, np.ones((len(rows), 1), bool), (_places_in_order(ids, keys) + pos)[:, None], hashed)[:, 0]


def _compare_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the dealt suffixes that occur earlier."""
    for _, held in _by_bucket(batches):
        parts = [_unpack(blob, **_SUFFIXES) for (blob,) in held]
        for x in parts:
            yield from _joined(x["ids"][x["sure"]], x["keys"][x["sure"]], x["pos"][x["sure"]])
        ids, keys, pos = (np.concatenate([x[c][~x["sure"]] for x in parts]) for c in ("ids", "keys", "pos"))
        rows = np.concatenate([x["bytes"].reshape(-1, LENGTH) for x in parts])
        hashed = _row_hashes(rows)
        order = np.argsort(hashed, kind="stable")
        edges = np.concatenate([np.flatnonzero(np.concatenate([[True], hashed[order][1:] != hashed[order][:-1]])) if len(order) else np.zeros(0, np.int64), [len(order)]])
        start, gone = 0, np.zeros(len(order), bool)
        while start < len(edges) - 1:
            end = max(start + 1, int(np.searchsorted(edges, edges[start] + SUFFIXES, "right")) - 1)
            own = order[edges[start] : edges[end]]
            gone[own] = _repeated(ids[own], keys[own], pos[own], rows[own], hashed[own]) >= LENGTH
            start = end
        yield from _joined(ids[gone], keys[gone], pos[gone])


def _joined(ids: np.ndarray, keys: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans of windows at places next to each other, joined."""
    if not len(ids):
        return
    order = np.lexsort((pos, keys, ids))
    ids, keys, pos = ids[order], keys[order], pos[order]
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (pos[1:] > pos[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.array(keys[first]), pa.array(pos[first]), pa.array((pos[last] - pos[first] + LENGTH).astype(np.int32))], ["id", "key", "pos", "size"])


def _of_documents(rows: DataFrame, marks: DataFrame, what: list[str]) -> DataFrame:
    """Documents with their marks in one array each; the small side of the join is built, the texts are only streamed."""
    own = marks.groupBy("id", "key").agg(F.collect_list(F.struct(*what)).alias("marks")).select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "marks")
    return rows.join(own.hint("shuffle_hash"), (F.col("id") == F.col("m_id")) & (F.col("key") == F.col("m_key"))).select("id", "key", "text", "marks")


def _numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with whole numbers in the order of their ids as ``_number``, null before all; and ``id, number`` if ids aren't whole numbers themselves.

    Such ids are ranked in ranges, each from where the one before it ends; no task sees all.
    """
    if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint"):
        return docs.withColumn("_number", F.coalesce(F.col(id_col).cast("long"), F.lit(_ABSENT))), None
    ids = cut(docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    before = ids.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    numbers = cut(ids.join(F.broadcast(before.select("part", "before")), "part").select("id", (own + F.col("before")).alias("number")))  # a row for each shuffle partition
    met = docs.join(numbers.select(F.col("id").alias("_i"), F.col("number").alias("_m")), F.col(id_col) == F.col("_i"), "left")
    return met.withColumn("_number", F.coalesce(F.col("_m").cast("long"), F.lit(_ABSENT))).drop("_i", "_m"), numbers


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: the documents as ``id, key, text``, and ``id, key, pos, size`` of bytes to remove, possibly overlapping. Ids are whole numbers."""
    spark = docs.sparkSession
    arrow_batches(spark, 1000)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_ABSENT)).alias("id"), text_key(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    buckets = 4 * partitions
    met = lambda df: df.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    found = rows.filter(F.octet_length("text") >= LENGTH).mapInArrow(_find_anchors(buckets), "bucket int, spans boolean, blob binary")
    marks = cut(met(found).mapInArrow(_judge(group), _MARKS))
    spans = marks.filter("kind = 0").select("id", "key", "pos", "size")
    contexts = _of_documents(rows, marks.filter("kind = 1"), ["pos", "hash"]).mapInArrow(_send_contexts(buckets), "bucket int, blob binary")
    spans = spans.unionByName(met(contexts).mapInArrow(_compare, "id long, key long, pos long, size int"))
    very_many = marks.filter("kind = 2")
    if not very_many.isEmpty():
        suffixes = _of_documents(rows, very_many, ["pos"]).mapInArrow(_send_suffixes(buckets, SUFFIXES), "bucket int, blob binary")
        spans = spans.unionByName(met(suffixes).mapInArrow(_compare_suffixes, "id long, key long, pos long, size int"))
    return rows, spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes).

    A byte goes if some string of 100 bytes that covers it also starts earlier: in a document of
    smaller id, or earlier in the same one; overlapping copies count; all is judged on the input.

    Equal windows of 100 bytes have equal anchors (strings of 50 bytes, least hash in the window), so
    windows meet in the bucket of an anchor's hash. Anchors in equal contexts (all bytes that
    windows around the anchor can have, by a 64-bit hash beside the anchor's own) are copies. Where an
    anchor stands in several contexts, the first of each is fetched and its windows go, as bytes, into a suffix
    array, whose longest-previous-factor array tells which have an earlier copy. Groups of more than
    ``group`` contexts are split: each suffix goes to the array of its first 100 bytes' hash.

    Null text is empty and nothing is removed; a null id comes before all others. Ids may be of any type that
    has an order. Rows of equal id and text: the first keeps what one row would, the others lose
    everything from 100 bytes on. Equal ids with other texts go by the texts' hash.
    """
    docs, numbers = _numbered(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id")
    id_col, text_col = "_number", "_text"
    rows, spans = repeated_spans(docs, id_col, text_col, group)
    own = spans.groupBy("id", "key").agg(F.collect_list(F.struct("pos", "size")).alias("marks")).select(F.col("id").alias("m_id"), F.col("key").alias("m_key"), "marks")
    met = rows.join(own.hint("shuffle_hash"), (F.col("id") == F.col("m_id")) & (F.col("key") == F.col("m_key")), "left").select("id", "key", "text", "marks")
    again = rows.groupBy("id", "key").count().filter("count > 1").isEmpty()
    met = met.withColumn("copy", F.lit(1) if again else F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text", 4 << 20):
            at, data = octets(batch.column(1))
            out = []
            for i, (marks, copy) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                text = data[at[i] : at[i + 1]]
                n = len(text)
                gone = np.zeros(n + 1, np.int32)
                if copy > 1 and n >= LENGTH:
                    gone[0], gone[n] = 1, -1
                elif marks.is_valid:
                    pos, size = (marks.values.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                    np.add.at(gone, pos, 1)
                    np.add.at(gone, pos + size, -1)
                else:
                    out.append((n, 0, 0, text.tobytes()))
                    continue
                removed = np.cumsum(gone[:-1]) > 0
                runs = int(np.count_nonzero(removed & ~np.concatenate([[False], removed[:-1]])))
                out.append((n, int(removed.sum()), runs, text[~removed].tobytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    done = met.select("id", "text", "marks", "copy").mapInArrow(run, schema)
    if numbers is None:
        return done.select(F.nullif("id", F.lit(_ABSENT)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
    named = numbers.select(F.col("id").alias("doc_id"), F.col("number").alias("m"))
    return done.join(named, F.col("id") == F.col("m"), "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
