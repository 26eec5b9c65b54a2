import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import suffix


def brute(rows, length=100):
    """Windows in the order of texts; the k-th row of equal id and text loses all from 100 bytes on."""
    seen, out, had = set(), [], set()
    for id_, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        if (id_, text or "") in had:
            gone = bytearray(b"\1" * len(b)) if len(b) >= length else gone
        else:
            for i in range(len(b) - length + 1):
                if b[i : i + length] in seen:
                    gone[i : i + length] = b"\1" * length
                seen.add(b[i : i + length])
        had.add((id_, text or ""))
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((id_, len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def result(df, **options):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(df, **options).collect()], key=str)


def ordered(spark, rows):
    """In the order that the operator defines: null first, ids, then the texts' hashes."""
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    return [tuple(r)[:2] for r in df.orderBy(F.asc_nulls_first("doc_id"), key).collect()]


def test_equals_brute_force(spark, docs, rows):
    assert result(docs) == sorted(brute(ordered(spark, rows)), key=str)


def test_other_partitions_and_fallback(spark, docs, rows, monkeypatch):
    expect = sorted(brute(ordered(spark, rows)), key=str)
    monkeypatch.setattr(suffix, "FLUSH", 50)
    monkeypatch.setattr(suffix, "FLUSH_CONTEXTS", 3)
    assert result(docs.repartition(2)) == expect


def test_groups_beyond_the_limit_are_split(spark, docs, rows, monkeypatch):
    """Every anchor with more than one context goes the way of the large groups; results are the same."""
    passage = "a passage of the same words that stands in many documents, each time between other words of its own, " * 2
    many = [(i, f"{i * 7919} before {i} " + passage + f" after {i} {i * 104729} " * 9) for i in range(40)] + [(40, passage + "\0" * 300), (41, "\0" * 150)]
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    expect = sorted(brute(many), key=str)
    assert result(df) == result(df, group=1) == expect
    monkeypatch.setattr(suffix, "SUFFIXES", 100)
    assert result(df, group=1) == expect
    assert result(docs, group=1) == sorted(brute(ordered(spark, rows)), key=str)


def test_string_ids(spark, rows):
    named = [(None if r[0] is None else f"a{r[0]:05}", r[1]) for r in rows]
    df = spark.createDataFrame(named, "doc_id string, text string")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    in_order = [tuple(r)[:2] for r in df.orderBy(F.asc_nulls_first("doc_id"), key).collect()]
    assert result(df) == sorted(brute(in_order), key=str)


def test_longest_previous_factors():
    """Against all pairs: how much each suffix has in common with any one at a smaller place."""
    rng = np.random.default_rng(3)
    for letters, n in ((1, 12), (2, 20), (3, 30)):
        rows = rng.integers(0, letters, (n, suffix._WIDTH)).astype(np.uint8) + 97
        rows[n // 2 :] = rows[rng.integers(0, n // 2, n - n // 2)]
        for r in range(n // 2, n):  # copies with one change
            rows[r, rng.integers(0, suffix._WIDTH)] = 120
        offsets = suffix._SIDE + 1
        valid = rng.random((n, offsets)) < 0.8
        group = rng.integers(0, 2, n)
        place = (rng.permutation(n)[:, None] << 40) + np.arange(offsets)
        place[1], rows[1], group[1] = place[0], rows[0], group[0]  # one context twice
        got = suffix.longest_previous_factors(rows, valid, place, group)
        for i, j in np.argwhere(valid)[:: 7]:
            best = 0
            for r in np.flatnonzero(group == group[i]):
                for k in np.flatnonzero(valid[r] & (place[r] < place[i, j])):
                    differ = rows[i, j : j + 100] != rows[r, k : k + 100]
                    best = max(best, int(differ.argmax()) if differ.any() else 100)
            assert got[i, j] == best
        assert not got[~valid].any()


@pytest.mark.parametrize("case", ["empty", "clashing"])
def test_edges(request, case, rows):
    df = request.getfixturevalue(case)
    assert len(result(df)) == (0 if case == "empty" else len(rows))
