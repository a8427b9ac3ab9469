"""Queries and oracle SQL of the training-data operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import html_extract, jaccard_join, license_scan, lm_scoring, packing, piece_sampling, pivot_index, quality_classifier, quality_rules, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark, _table(spark, sf_dir, "pages"), url_filter.RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(spark, _table(spark, sf_dir, "documents"), quality_classifier.held_out(F.col("doc_id"), 7, 2))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op4_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(spark, docs, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.score_documents(spark, docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality_classifier.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(spark, _table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    path = F.concat_ws("/", part("source"), part("lang"), F.concat(part("doc_id"), F.lit(".txt")))
    return license_scan.scan_licences(spark, _table(spark, sf_dir, "documents"), path)


def op9_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = piece_sampling.encode_documents(_table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "lossless")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(spark, _table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_html_extraction": op3_html_extraction,
    "op4_pivot_index": op4_pivot_index,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_piece_sampling": op9_piece_sampling,
    "op10_packing": op10_packing,
}

_RULES_SQL = """(VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')) AS r(action, rhost, rpath)"""

_OP1 = rf"""
WITH RECURSIVE src AS (
  SELECT page_id, url, html, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM src
), tags AS (
  SELECT url, host, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM parts WHERE url IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))
), targets AS (
  SELECT url, host, trim(replace(CASE
    WHEN regexp_matches(tag, '(?is)\srel\s*=\s*["'']?[^"''>]*canonical') THEN regexp_extract(tag, '(?is)\shref\s*=\s*["'']?([^"''>\s]*)', 1)
    WHEN regexp_matches(tag, '(?is)\shttp-equiv\s*=\s*["'']?\s*refresh') THEN regexp_extract(tag, '(?is)url\s*=\s*[''"]?([^''">]*)', 1) END, '&amp;', '&')) AS raw FROM tags
), links AS (
  SELECT url, CASE WHEN contains(raw, '://') THEN raw WHEN raw LIKE '//%' THEN 'http:' || raw WHEN raw LIKE '/%' THEN 'http://' || host || raw END AS target FROM targets WHERE raw <> ''
), urls AS (SELECT DISTINCT u FROM (SELECT url AS u FROM links WHERE target IS NOT NULL UNION ALL SELECT target FROM links WHERE target IS NOT NULL)
), nodes AS (
  SELECT u, substr(u, position('://' IN u) + 3) AS rest FROM urls
), known AS (
  SELECT u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS k FROM nodes
), edges AS (
  SELECT x.k AS a, y.k AS b FROM links l JOIN known x ON x.u = l.url JOIN known y ON y.u = l.target
  UNION SELECT y.k, x.k FROM links l JOIN known x ON x.u = l.url JOIN known y ON y.u = l.target
), reach(a, b) AS (SELECT k, k FROM known UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), decided AS (
  SELECT k, arg_max(action, length(rhost || rpath)) AS action FROM known JOIN {_RULES_SQL} ON (known.host = rhost OR known.host LIKE '%.' || rhost) AND starts_with(known.path, rpath) GROUP BY u, k
), aliased AS (
  SELECT a AS k, bool_or(action = 'block') AND NOT bool_or(action = 'allow') AS blocked FROM reach JOIN decided ON decided.k = reach.b GROUP BY a
), ruled AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM parts JOIN {_RULES_SQL} ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, q.rule, coalesce(q.action, CASE WHEN a.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN ruled q ON q.page_id = p.page_id LEFT JOIN aliased a ON a.k = p.host || p.tail
"""

ORACLE = {"op1_url_filter": _OP1}
