"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language, licences, lines, minhash, near_vectors, packing, pivot_search, quality, toxicity
from .shared import tables

TOKENIZER = "byte_bpe_50k.json"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(tables(spark, sf_dir, "embeddings"), similarity=0.95)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(tables(spark, sf_dir, "documents")).select("doc_id", "text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_layout(tables(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language.fit(docs, ~held_out)
    out = language.identify(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    out = quality.score(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "p_text", "p_meta", "score", "keep")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(tables(spark, sf_dir, "documents")).drop("spans")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    out = toxicity.fit_and_score(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted", "neighbours")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables(spark, sf_dir, "embeddings")
    # a vector with a component that is null or not finite is null, as floor() would make a number of it
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = rows.select("vec_id", F.when(~bad, F.transform("embedding", lambda x: F.floor(x.cast("double") * 64).cast("double"))).alias("v"))
    return pivot_search.top_k(scaled, F.col("vec_id") % 20 == 0, k=20, id_col="vec_id", vector_col="v")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(tables(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(tables(spark, sf_dir, "documents"), k=3, similarity=0.85)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), n AS (SELECT a, count(*) AS n FROM link GROUP BY a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, c.c = v.vec_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""

OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w
), same AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep, len(s)::BIGINT AS n, s FROM s WHERE len(s) > 0
), one AS (
  SELECT doc_id, n, unnest(s) AS x FROM same WHERE doc_id = rep
), few AS (
  -- a pair at the threshold shares a shingle among the first of each set in the order of their rarity
  SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM one)
), head AS (
  SELECT doc_id, n, x FROM few WHERE place <= n - ceil(0.85 * n) + 1
), maybe AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM head a JOIN head b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), pair AS (
  SELECT m.a, m.b FROM maybe m JOIN same p ON p.doc_id = m.a JOIN same q ON q.doc_id = m.b
  WHERE 185 * len(list_intersect(p.s, q.s)) >= 85 * (p.n + q.n)
), link AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM same WHERE doc_id = rep UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, coalesce(c.c, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN same ON same.doc_id = s.doc_id LEFT JOIN c ON c.a = same.rep
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_line_dedup,
        op3_packing,
        op4_language_id,
        op5_quality_classifier,
        op6_license_scans,
        op7_toxicity,
        op8_exact_top_k,
        op9_bpe,
        op10_minhash_near_dedup,
    )
}
ORACLES: dict[str, str] = {"op1_embedding_near_dedup": OP1_SQL, "op8_exact_top_k": OP8_SQL, "op10_minhash_near_dedup": OP10_SQL}
