"""The thin opN_ queries over the operators of this subpackage, with production parameters, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenlake.llm import bpe, conversation_sql, conversation_trie, cross_polytope, jaccard_join, kneser_ney, licenses, packing, quality, rans, repair, suffix_dedup, voronoi_knn, warc
from provenlake.llm.common import documents, vocabulary


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir), length=100)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.group_documents(documents(spark, sf_dir), words=3, per=90)


def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_knn.search(documents(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl that the pages make, resolved; headers as sorted text."""
    found = warc.resolve_revisits(warc.captures(documents(spark, sf_dir, "pages")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.withColumn("headers", headers)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.train_and_score(documents(spark, sf_dir))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(documents(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), end_id=1)


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(documents(spark, sf_dir, "conversations"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(documents(spark, sf_dir, "conversations"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_voronoi_knn": op5_voronoi_knn,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_rans_ids": op9_rans_ids,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_structure_repair": op11_structure_repair,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_license_scan": op13_license_scan,
}

_CANONICAL = r"""
    SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM (
      SELECT *,
        regexp_replace(regexp_replace(lower(regexp_extract(url, '{parts}', 2)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_extract(url, '{parts}', 3), '/$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, '{parts}', 4), '^\?', ''), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '{tracking}'))), '&') AS kept
      FROM page)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_structure_repair": conversation_sql.STRUCTURE_REPAIR,
    "op12_prefix_trie": conversation_sql.PREFIX_TRIE,
    "op13_license_scan": conversation_sql.LICENSE_SCAN,
    "op6_warc_revisits": rf"""
WITH page AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id IS NOT NULL),
own AS ({_CANONICAL.format(parts=warc.URL_PARTS, tracking=warc.TRACKING)}),
dated AS (SELECT *, strftime(make_timestamp(page_id * 60000000), '%Y-%m-%d %H:%M:%S') AS day, '"' || substr(digest, 1, 16) || '"' AS tag FROM own),
asked AS (
  SELECT r.*, o.page_id AS o_page, o.digest AS o_digest, o.tag AS o_tag, o.day AS o_day
  FROM (SELECT *, (page_id + 1000) * 60 + 30 AS at FROM dated) r ASOF LEFT JOIN (SELECT *, page_id * 60 AS at FROM dated WHERE canonical IS NOT NULL) o
  ON r.canonical = o.canonical AND r.at > o.at),
judged AS (
  SELECT *, CASE WHEN o_page IS NULL THEN 'no_original'
    WHEN page_id % 4 = 3 THEN 'no_validator'
    WHEN CASE page_id % 4 WHEN 0 THEN tag = o_tag WHEN 1 THEN day = o_day ELSE digest = o_digest END THEN 'resolved' ELSE 'validator_mismatch' END AS resolution
  FROM asked)
SELECT page_id * 2 + 1 AS record_id, canonical, resolution, o_page * 2 AS original_id, o_page * 60 AS original_at,
  CASE WHEN resolution = 'resolved' THEN o_digest END AS digest,
  CASE WHEN resolution = 'resolved' THEN CASE page_id % 4
    WHEN 0 THEN 'content-type=text/html;date=again;etag=W/' || tag || ';last-modified=' || o_day
    WHEN 1 THEN 'content-type=text/html;date=' || o_day || ';etag=' || o_tag || ';last-modified=' || day
    ELSE 'content-type=text/html;date=again;etag=' || o_tag || ';last-modified=' || o_day END END AS headers
FROM judged""",
    "op5_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS double))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS bigint) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5""",
}
