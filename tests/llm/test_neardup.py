import random
import re

import numpy as np
import pyarrow as pa

from palisade.llm import neardup


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                group[root(i)] = root(j)
    ids = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[root(i)] = min(ids.get(root(i), r[0]), r[0])
    return sorted([(r[0], len(s), ids.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))], key=str)


def result(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in neardup.components(df).collect()], key=str)


def test_equals_brute_force(docs, rows):
    assert result(docs) == brute(rows)


def test_chains_and_near_copies(spark):
    """Families at the threshold, chains whose ends aren't similar, and copies of copies."""
    rng = random.Random(8)
    rows = []
    for f in range(12):
        w = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 90))]
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            k = rng.randrange(len(w))
            w = [*w[:k], f"n{f}x{len(rows)}", *w[k + 1 :]] if rng.random() < 0.8 else w
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == brute(rows)


def test_threshold_is_exact():
    a = " ".join(f"w{i}" for i in range(11))  # 7 shingles
    b = a + " x"  # 8 shingles, 7 shared: 87.5
    c = " ".join(f"w{i}" for i in range(3, 11))  # 4 of 7: 57
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([2, 3]), pa.array([a, a]), pa.array([b, c])], ["a", "b", "ta", "tb"])
    (out,) = neardup._confirm(iter([batch]))
    assert out.column(1).to_pylist() == [2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    sig = neardup.signatures([np.sort(x[:800]), np.sort(x[100:]), np.zeros(0, np.uint64)])
    assert abs((sig[0] == sig[1]).mean() - 700 / 900) < 0.12


def test_stars(spark):
    rng = random.Random(2)
    for edges in ([(i, i + 1) for i in range(60)], [(rng.randrange(200), rng.randrange(200)) for _ in range(150)], []):
        df = spark.createDataFrame(edges, "a long, b long")
        got = {r.node: r.root for r in neardup.stars(df).collect()}
        near = {}
        for a, b in edges:
            if a != b:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        expect = {}
        for n in sorted(near):
            if n not in expect:
                todo = [n]
                while todo:
                    x = todo.pop()
                    if x not in expect:
                        expect[x] = n
                        todo += near[x]
        assert got == expect


def test_dedup(docs, rows, empty, clashing):
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    texts = [r.text for r in got]
    groups = {c for i, n, c in brute(rows) if n}
    # one more: two texts have the same id, so two groups have the same smallest id
    assert sum(bool(shingles(t)) for t in texts) == len(groups) + 1
    assert neardup.dedup(empty).count() == 0 and neardup.components(empty).count() == 0
    assert neardup.dedup(clashing).count() == len(got)


def test_words_cannot_be_made_to_collide(spark):
    """Two words that a polynomial modulo 2**64 can't tell apart (Thue-Morse and its complement) are different words."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two {a} four five six"), (2, f"one two {b} four five six")]
    x, y = neardup.shingle_sets(pa.array([t for _, t in rows]))
    assert not set(x.tolist()) & set(y.tolist())
    x, y = neardup.exact_sets(pa.array([t for _, t in rows]))
    assert not set(x.tolist()) & set(y.tolist())
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_exact_sets_are_the_sets(rows):
    texts = [r[1] for r in rows][:80]
    sets = neardup.exact_sets(pa.array(texts, pa.string()))
    for s, t in zip(sets, texts):
        assert len(s) == len(shingles(t))
    for i in range(0, len(texts), 7):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) > 1:
                assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(shingles(texts[i]) & shingles(texts[j]))


def test_string_ids_equal_brute_force(spark, rows):
    named = [(None if r[0] is None else f"a{r[0]:04}", r[1]) for r in rows]
    assert result(spark.createDataFrame(named, "doc_id string, text string")) == brute(named)


def family(n, edits, seed, places=range(100)):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(places, rng.choice(edits)):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


def test_many_copies_below_the_threshold_make_few_candidates(spark, monkeypatch):
    """2,000 copies of one text, each with edits enough that no two are linked: pairs don't grow with their square."""
    rows = family(2000, (4, 5, 6), 5, range(4, 96, 6))  # far apart, so that each edit takes five shingles
    counts, plain = [], neardup._prefix_pairs

    def counted(placed, left):
        out = plain(placed, left)
        counts.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_prefix_pairs", counted)
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [g[2] for g in got] == [g[0] for g in got] and counts and counts[0] < 2000, counts


def test_copies_around_the_threshold_equal_brute_force(spark):
    rows = family(300, (0, 1, 2, 3), 6)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_hubs_are_dealt_over_copies(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(neardup, "HUB", 1)
    many = family(60, (1, 1, 2), 7)
    assert result(spark.createDataFrame(many, "doc_id long, text string")) == brute(many)


def test_repeated_rows_leave_the_same_one(spark):
    rows = [(1, "one two three four five six", c) for c in "abcdef"] + [(2, None, "x"), (2, None, "y")]
    names = "doc_id long, text string, _key string"
    one = neardup.dedup(spark.createDataFrame(rows, names).repartition(3)).collect()
    two = neardup.dedup(spark.createDataFrame(rows[::-1], names).repartition(2)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 2 and all(r._key for r in one)
