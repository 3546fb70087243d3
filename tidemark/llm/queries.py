"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard, licenses, packing, quality, secrets, substrings, toxicity, vectors
from tidemark.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "word_bpe_49k.json"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_toxicity, op3_bpe, op4_ngram_jaccard_join, op5_substring_dedup,
        op6_secret_scans, op7_exact_top_k, op8_quality, op9_near_neighbours, op10_license_scans,
    )
}

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
        ), g AS (
            SELECT doc_id, unnest(list_distinct(
                CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s
            FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS MATERIALIZED (
            SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
        ), e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, least(d.doc_id, min(r.b)) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op5_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
        v AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 20], ' ')) AS h FROM w, unnest(range(0, greatest(len(ws) - 19, 0))) AS t(s)),
        f AS (SELECT h, min((doc_id, s)) AS head FROM v GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, s + k AS p FROM v JOIN f USING (h), range(0, 20) AS t(k) WHERE (doc_id, s) != head),
        m AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
        x AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN m USING (doc_id))
        SELECT doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN len(ps) = 0 THEN ws ELSE list_filter(ws, lambda u, j: NOT list_contains(ps, j - 1)) END, ' ')) AS kept_sha256
        FROM x""",
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
