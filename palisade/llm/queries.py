"""Queries of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, langid, licenses, media, mixing, neardup, pii, resample, suffix
from .common import table


def pii_key(spark: SparkSession) -> bytes:
    """The secret of the surrogates: the session's ``spark.palisade.pii.key``. The registered queries and the pipeline have one of their own for test tables, where it is unset."""
    return spark.conf.get("spark.palisade.pii.key", "the registered queries' own key, no secret").encode()


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    took = mixing.assign_copies(table(spark, sf_dir, "documents"))
    return took.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return named.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "known")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))
    return done.select("doc_id", "text", "n_entities", F.array_join(F.array_sort(F.transform(F.map_entries("pii"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("types"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return resample.resample(docs.select("doc_id", "text"), labels).drop("text")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_main_text": op6_html_main_text,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_webp_media": op10_webp_media,
}

#: DuckDB SQL, for the queries that SQL can express.
ORACLE: dict[str, str] = {
    "op5_decontaminate": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        bw AS (SELECT item, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i, w FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM bw),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        m AS (SELECT r, item, i, win.n FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
        h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op9_near_duplicates": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
        o AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
        e AS (SELECT a, b FROM o JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        t AS (SELECT r AS a, r AS b FROM d UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
        m AS (SELECT t.a AS r, min(d.doc_id) AS component_id FROM t JOIN d ON d.r = t.b GROUP BY t.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM d JOIN m USING (r) LEFT JOIN n USING (r)""",
}
