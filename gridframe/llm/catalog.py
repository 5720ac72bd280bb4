"""Queries of the training-data operators: one per operator, over whole tables.

Each is a thin wrapper that reads its table, applies the operator with its
production parameters and derives the result columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import decontaminate, exact_dedup, html, language, lexical, licenses, lm_score, near_dup, packing, token_links, topk, toxicity, urls
from gridframe.llm import text as T


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"), keep=["doc_id"])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", T.held_out("doc_id"))
    return language.identify(rows, language.fit(docs), keep=["doc_id", "held_out"])


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urls.train(urls.labelled_urls(spark))
    return urls.judge(_read(spark, sf_dir, "pages"), weights, keep=["page_id"])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.backoff_scores(_read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = docs.withColumn("held_out", T.held_out("doc_id"))
    return toxicity.classify(rows, toxicity.fit(docs, _read(spark, sf_dir, "labels")), keep=["doc_id", "held_out"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op12_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_links.link_scores(_read(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_decontaminate": op2_decontaminate,
    "op3_near_dup": op3_near_dup,
    "op4_topk": op4_topk,
    "op5_html": op5_html,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_toxicity": op9_toxicity,
    "op10_packing": op10_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_token_links": op12_token_links,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle_sql(),
    "op4_topk": """
        WITH v AS (
            SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum([z[1] * z[2] for z in list_zip(q.e, c.e)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op11_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
            FROM documents
        )
        SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
               row_number() OVER best = 1 AS kept, sha256(bare) AS text_sha256
        FROM t
        WINDOW best AS (PARTITION BY bare ORDER BY chars DESC, doc_id NULLS LAST)
    """,
    "op13_lexical": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), totals AS (
            SELECT count(*) AS all_docs, CAST(sum(len(words)) AS BIGINT) AS all_words FROM d WHERE len(words) > 0
        ), lengths AS (
            SELECT r, doc_id, 100 - 25 + (25 * len(words) * all_docs) // all_words AS m FROM d, totals WHERE len(words) > 0
        ), tfs AS (
            SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(words) AS t FROM d) GROUP BY r, t
        ), weights AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * max(all_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tfs, totals GROUP BY t
        ), items AS (
            SELECT row_number() OVER () AS item, item_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), asked AS (
            SELECT item, item_id, t, count(*) AS n FROM (SELECT item, item_id, unnest(words) AS t FROM items) GROUP BY item, item_id, t
        ), scored AS (
            SELECT item, item_id, r, doc_id, CAST(sum(n * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM asked JOIN weights USING (t) JOIN tfs USING (t) JOIN lengths USING (r)
            GROUP BY item, item_id, r, doc_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
