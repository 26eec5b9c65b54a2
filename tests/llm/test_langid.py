import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import langid

SYLLABLES = {"xx": "ba lo mi ter san on".split(), "yy": "krü ßen dro wal tig nch".split(), "zz": "éa ño que llo ció rra".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)

    def text(lang):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))

    rows = [(i, text(lang), lang) for i in range(600) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "xx"), (1001, "", "xx"), (1002, "123 !!", "yy"), (1003, rows[0][1], None), (None, rows[0][1], "xx"), (1004, "Q", "yy"), rows[3], (1005, text("zz") * 3000, "zz")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_held_out_accuracy(labelled):
    df, rows = labelled
    got = langid.identify(df, langid.train(df, per_language=100)).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[1004].lang_pred in SYLLABLES and by[1005].lang_pred == "zz" and by[1003].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 and 0 <= r.known <= 1 for r in got)


def test_label_and_id_are_no_input(labelled):
    df, _ = labelled
    model = langid.train(df)
    from pyspark.sql import functions as F

    a = sorted((r.text or "", r.lang_pred, r.score) for r in langid.identify(df, model).collect())
    b = sorted((r.text or "", r.lang_pred, r.score) for r in langid.identify(df.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.lit(1)), model).collect())
    assert a == b


def test_filter_returns_all_languages():
    import numpy as np

    grams = {"a": np.array([1, 2, 3], np.uint32), "b": np.array([3, 4], np.uint32)}
    m = langid.LanguageFilter.build(["a", "b"], grams)
    assert m.masks(np.array([1, 2, 3, 4], np.uint32), 0).tolist() == [1, 1, 3, 2]
    many = {f"l{i}": np.array([i, 1000], np.uint32) for i in range(70)}
    m = langid.LanguageFilter.build(list(many), many)
    assert m.cells.shape[0] == 2 and m.masks(np.array([1000], np.uint32), 1)[0] == (1 << 6) - 1


def test_edges(spark, docs, empty, clashing, rows):
    model = langid.train(docs)
    assert langid.identify(empty, model).count() == 0
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    out = langid.identify(clashing, model)
    assert out.count() == len(rows) and out.columns[-3:] == ["lang_pred", "score", "known"]


def test_predictions_equal_naive_counts(labelled):
    """Language, score and share of known n-grams against sets of n-grams, one text at a time, with the filter's own false positives."""
    import numpy as np
    import pyarrow as pa

    df, rows = labelled
    model = langid.train(df, per_language=100)
    texts = [t for _, t, _ in rows if t][:120] + ["É!!ba", "ba  lo\nmi", "ß"]
    names, scores, known = model.predict(pa.array(texts))
    bits = model.cells.shape[1].bit_length() - 1

    def has(value):
        out = set(range(len(model.languages)))
        for place in model._places(np.array([value], np.uint32), bits, model.hashes):
            out &= {l for l in out if int(model.cells[l // 64][place[0]]) >> (l % 64) & 1}
        return out

    for t, name, score, share in zip(texts, names, scores, known):
        data = bytearray(b" ")
        for c in t.lower().encode():
            c = c if c >= 128 or 97 <= c <= 122 else 32
            if not (c == 32 and data[-1] == 32):
                data.append(c)
        data += b"" if data[-1] == 32 else b" "
        grams = [int.from_bytes(data[i : i + k], "big") for k in langid.ORDERS for i in range(len(data) - k + 1)]
        hits = np.zeros(len(model.languages))
        for g in grams:
            for l in has(g):
                hits[l] += 1
        true = np.clip((hits - len(grams) * model.false) / (1 - model.false), 0, None)
        assert name == model.languages[int(true.argmax())]
        assert abs(score - (true.max() / true.sum() if true.sum() else 0)) < 1e-9 and abs(share - min(1, true.max() / max(len(grams), 1))) < 1e-9


def test_dirty_labels_are_an_error(spark):
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 20"):
        langid.train(df, languages=20)


def test_the_sample_is_bounded(spark):
    """The rows with the smallest hashes, one for each id, however they are dealt and however often an id is repeated."""
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(60)), "xy"[i % 2]) for i in range(4000)]
    df = spark.createDataFrame(rows + [rows[7]] * 3000, "doc_id long, text string, lang string")
    one, two = (langid.train(d, per_language=50, grams=100) for d in (df.repartition(4), df.coalesce(1)))
    assert one.languages == two.languages and (one.cells == two.cells).all()
    few = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    keys = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(2**31)).alias("h")).distinct().collect()}
    sample = [r for lang in "xy" for r in sorted((r for r in few if r[2] == lang), key=lambda r: keys[r[0]])[:50]]
    three = langid.train(spark.createDataFrame(sample, "doc_id long, text string, lang string"), grams=100)
    assert (three.cells == one.cells).all()


def test_text_goes_to_python_once(spark, labelled):
    """Workers and Arrow buffers hold each text once, in small batches; the result is that of a text sent beside the kept columns."""
    df, rows = labelled
    model = langid.train(df, per_language=100)
    out = langid.identify(df, model)
    sent = out._jdf.queryExecution().analyzed().children().head().output()
    assert [sent.apply(i).name() for i in range(sent.length())] == df.columns
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 2 << 20
    beside = langid.identify(df.withColumnRenamed("text", "known"), model, "known")
    assert beside.columns == ["doc_id", "lang", "lang_pred", "score", "known"]
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score, r.known)
    assert sorted(map(key, out.collect())) == sorted(map(key, beside.collect()))
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(i), t or "") for i, t, _ in rows)
