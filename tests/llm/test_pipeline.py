from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "copies"] and 0 < out.count() < docs.count()
    assert out.filter("copies < 1 or copies > 3 or text is null").count() == 0
    assert out.groupBy("doc_id").count().filter("count > 1").count() == 0


def test_stages_take_nulls_and_nothing(spark, sf_dir, docs, empty):
    for df in (docs, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, sf_dir)
            assert out.columns == df.columns and out.count() <= df.count()
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() <= df.count()


def test_language_keeps_clean_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.count() >= docs.filter(F.col("text").rlike(r"\p{L}")).count() * 0.98


def test_names():
    assert [f"op{n}_" in " ".join(queries.QUERIES) for n in range(1, 11)] == [True] * 10


def test_stages_keep_clashing_columns(spark, sf_dir, clashing):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, sf_dir)
        assert out.columns == clashing.columns, name
        assert out.filter("root = 'x' and key = 'x' and lang_pred = 'x' and n_entities = 'x'").count() == out.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, clashing, sf_dir)
    assert dict(last.dtypes)["copies"] == "int" and last.filter("root = 'x'").count() == last.count()


def test_stages_equal_brute_force(spark, sf_dir, docs, rows):
    """Near duplicates and benchmark passages, the stages that decide by exact rules, on the whole fixture."""
    from test_decontaminate import brute as windows
    from test_neardup import brute as groups
    from test_neardup import shingles

    keep = {c for _, n, c in groups(rows) if n}
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert {r.doc_id for r in out if shingles(r.text)} == keep
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    planted = [(i, f"before {t} after " + "word " * (5000 if i % 2 else 3)) for i, t in items[:20]] + [(100 + r[0], r[1]) for r in rows if r[0] is not None]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in planted], "doc_id long, text string, lang string, source string, n_chars long")
    clean = sorted(r[0] for r in windows(planted, items) if r[2] == 0)
    assert sorted(r.doc_id for r in corpus_pipeline.benchmark_passages(spark, df, sf_dir).collect()) == clean
