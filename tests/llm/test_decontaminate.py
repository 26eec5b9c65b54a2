import re

import pytest
from pyspark.sql import functions as F

from palisade.llm import decontaminate

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items):
    windows = {}
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for win, own in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= own
        out.append((r[0], len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    long = rows[70][1].split()
    items = [(0, " ".join(rows[0][1].split()[:30])), (1, "  One  "), (2, "two WORDS"), (3, None), (4, ""), (5, "!!"), (6, " ".join(long[3:17])), (7, " ".join(long[3:17])), (8, "é ü"), (9, "no such words anywhere in these rows at all my dear reader of tests"), (10, "river stone light")]
    return spark.createDataFrame(items, "item_id long, text string"), items


def result(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()], key=str)


def test_equals_brute_force(docs, rows, benchmark):
    df, items = benchmark
    assert result(decontaminate.annotate(docs, df)) == brute(rows, items)


def test_shuffled_way(docs, rows, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "small", lambda df, rows=0: df)
    df, items = benchmark
    assert result(decontaminate.annotate(docs, df)) == brute(rows, items)


def test_edges(docs, empty, clashing, rows, benchmark):
    df, items = benchmark
    none = df.limit(0)
    assert decontaminate.annotate(empty, df).count() == 0
    assert not any(r.contaminated for r in decontaminate.annotate(docs, none).collect())
    kept = decontaminate.decontaminate(clashing, df)
    assert kept.columns == clashing.columns and kept.count() == sum(not r[4] for r in brute(rows, items))


def test_passage_in_a_long_document(spark):
    """A passage of 20 words among 5,000 is under one in 20 words; the strict way drops the document all the same."""
    item = " ".join(f"item{i}" for i in range(20))
    rows = [(1, " ".join(f"w{i}" for i in range(2500)) + " " + item + " " + " ".join(f"v{i}" for i in range(2500))), (2, "clean words"), (3, None), (4, item.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"d": F.lit("x"), "key": F.lit("y"), "row": F.lit("z")})
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    kept = decontaminate.decontaminate(docs, items, any_hit=True)
    assert sorted((r.doc_id, r.d, r.key, r.row) for r in kept.collect()) == [(2, "x", "y", "z"), (3, "x", "y", "z")]


def test_plan_is_native(docs, benchmark):
    plan = decontaminate.annotate(docs, benchmark[0])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert F is not None
