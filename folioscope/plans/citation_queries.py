"""Queries on citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import citations as c
from folioscope.functions.numbers import page_range
from folioscope.functions.text import contained, token_set
from folioscope.operators import citations
from folioscope.plans.catalog import query
from folioscope.plans.tables import MENTIONS_SQL, mentions, table

_RANGES = """ranges AS (SELECT item_id, key, string_agg(CASE WHEN a = b THEN cast(a AS varchar) ELSE a || '-' || b END, ', ' ORDER BY a) AS listed, sum(b - a + 1) AS n FROM (
  SELECT item_id, key, min(page) AS a, max(page) AS b FROM (SELECT item_id, key, page, page - row_number() OVER (PARTITION BY item_id, key ORDER BY page) AS run FROM (SELECT DISTINCT item_id, key, page FROM with_key WHERE page IS NOT NULL)) GROUP BY item_id, key, run) GROUP BY item_id, key)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.describe_mentions(mentions(spark, sf_dir))


@query(f"WITH {MENTIONS_SQL} SELECT ord, key, year, volume FROM with_key")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("ord", "key", "year", "volume")


@query(f"WITH {MENTIONS_SQL}, {_RANGES} SELECT k.item_id, k.key, arg_min(raw, ord) AS raw, bool_or(page IS NULL) AS unnumbered, bool_and(is_partial) AS partial, coalesce(any_value(listed), '') AS pages FROM with_key k LEFT JOIN ranges r USING (item_id, key) GROUP BY 1, 2")
def citation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.aggregate_mentions(_keyed(spark, sf_dir))
    return found.select("item_id", "key", "raw", "unnumbered", "partial", F.regexp_replace(page_range(F.col("pages"), F.lit(False)), "^pp?\\. ", "").alias("pages"))


@query(f"""WITH {MENTIONS_SQL}, {_RANGES}, g AS (SELECT item_id, key, arg_min(year, ord) AS year, arg_min(comparison_text, ord) AS ct, arg_min(lower(regexp_extract(raw, '^[A-Za-z]+')), ord) AS author, bool_or(page IS NULL) AS un FROM with_key GROUP BY 1, 2)
SELECT item_id, key, row_number() OVER (PARTITION BY item_id ORDER BY author, coalesce(year, 9999), ct, key) AS number,
  CASE WHEN n IS NULL THEN CASE WHEN un THEN 'unnumbered' ELSE '' END ELSE CASE WHEN n = 1 AND NOT un THEN 'p. ' ELSE 'pp. ' END || listed || CASE WHEN un THEN ', unnumbered' ELSE '' END END AS range FROM g LEFT JOIN ranges USING (item_id, key)""")
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.aggregate_mentions(_keyed(spark, sf_dir))
    return citations.bibliography(found).select("item_id", "key", F.col("number").cast("long").alias("number"), "range")


_STRINGS = ["Weber, M. (1920). *Gesammelte*, Bd. 1. Mohr", "Dupont. *Oeuvres*, tome iv. Paris", "Sen, S. 1981. Poverty, pp. 1850", "Meyer. Some Work. fol. 1200", "Doe (2019). doi: 10.1234/abc.5, text", "Marx, K. (1976 [1867]). *Kapital*"]


def _case(key: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(key % len(values) == i, v).otherwise(out)
    return out


_YEARS, _VOLUMES, _DOIS = [1920, None, 1981, None, 2019, 1867], [1, 4, None, None, None, None], [None, None, None, None, "10.1234/abc.5", None]


def _case_sql(values: list, kind: str) -> str:
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {v!r}" for i, v in enumerate(values) if v is not None) + f" ELSE cast(NULL AS {kind}) END"


@query(f"SELECT o_orderkey, {_case_sql(_YEARS, 'integer')} AS year, {_case_sql(_VOLUMES, 'integer')} AS volume, {_case_sql(_DOIS, 'varchar')} AS doi FROM orders")
def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _case(F.col("o_orderkey"), _STRINGS)
    return table(spark, sf_dir, "orders").select("o_orderkey", c.year(raw).alias("year"), c.volume(raw).alias("volume"), c.doi(raw).alias("doi"))


@query(f"""WITH {MENTIONS_SQL}, g AS (SELECT item_id, key, arg_min(comparison_text, ord) AS ct, year, bool_and(is_partial) AS partial FROM with_key GROUP BY item_id, key, year),
t AS (SELECT *, list_distinct(regexp_extract_all(ct, '[a-z0-9]{{2,}}')) AS tok FROM g)
SELECT a.item_id, a.key AS a, b.key AS b, len(list_intersect(a.tok, b.tok)) AS common, len(list_filter(a.tok, lambda x: NOT list_contains(b.tok, x))) = 0 AS inside
FROM t a JOIN t b ON a.item_id = b.item_id AND a.year IS NOT DISTINCT FROM b.year AND a.key < b.key""")
def block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _keyed(spark, sf_dir).groupBy("item_id", "key", "year").agg(F.min_by("comparison_text", "ord").alias("ct"))
    left = g.select("item_id", "year", F.col("key").alias("a"), token_set(F.col("ct")).alias("ta"))
    right = g.select(F.col("item_id").alias("i"), F.col("year").alias("y"), F.col("key").alias("b"), token_set(F.col("ct")).alias("tb"))
    pairs = left.join(right, (F.col("item_id") == F.col("i")) & F.col("year").eqNullSafe(F.col("y")) & (F.col("a") < F.col("b")))
    return pairs.select("item_id", "a", "b", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"), contained(F.col("ta"), F.col("tb")).alias("inside"))


@query(f"""WITH {MENTIONS_SQL}, g AS (SELECT item_id, key, arg_min(comparison_text, ord) AS ct, year, lower(regexp_extract(any_value(raw), '^[A-Za-z]+')) AS author, bool_and(is_partial) AS partial, bool_or(page IS NULL) AS un FROM with_key GROUP BY item_id, key, year),
t AS (SELECT *, list_distinct(regexp_extract_all(ct, '[a-z0-9]{{2,}}')) AS tok FROM g),
p AS (SELECT a.item_id, a.key AS pkey, min(b.key) AS key, count(*) AS n, bool_or(a.un) AS un FROM t a JOIN t b ON a.item_id = b.item_id AND a.author = b.author AND a.year IS NOT DISTINCT FROM b.year AND a.partial AND NOT b.partial AND len(list_filter(a.tok, lambda x: NOT list_contains(b.tok, x))) = 0 GROUP BY 1, 2),
u AS (SELECT item_id, key, bool_or(un) AS more FROM p WHERE n = 1 GROUP BY 1, 2)
SELECT t.item_id, t.key, t.un OR coalesce(u.more, false) AS unnumbered FROM t LEFT JOIN u USING (item_id, key) WHERE NOT t.partial""")
def partial_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.resolve_partials(citations.aggregate_mentions(_keyed(spark, sf_dir))).select("item_id", "key", "unnumbered")


@query("""WITH g AS (SELECT cast(o_custkey AS varchar) AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1/' || (o_orderkey % 5) WHEN o_orderkey % 3 = 1 THEN 'url:http://w/' || (o_orderkey % 4) ELSE 'key:' || o_orderkey END AS id, o_orderkey AS ord, cast(o_orderkey % 40 + 1 AS integer) AS page FROM orders)
SELECT item_id, min(ord) AS ord, count(DISTINCT page) AS n_pages FROM g GROUP BY item_id, id""")
def identifier_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cited = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), k.cast("string").alias("key"), F.array((k % 40 + 1).cast("int")).alias("pages"), F.lit(False).alias("unnumbered"), F.when(k % 3 == 0, F.concat(F.lit(" 10.1/"), (k % 5).cast("string"))).alias("doi"), F.when(k % 3 == 1, F.concat(F.lit("http://w/"), (k % 4).cast("string"))).alias("url"), k.alias("ord"))
    return citations.merge_identical(cited).select("item_id", "ord", F.size("pages").cast("long").alias("n_pages"))


@query("""WITH w AS (SELECT p_partkey, 'Notes on ' || p_name || ' Handbuch, *Nations*' AS text, 1990 + p_size % 5 AS y, CASE WHEN p_partkey % 5 = 0 THEN 'Nations' WHEN p_partkey % 5 = 1 THEN 'The Notes' ELSE 'On the ' || p_name END AS title, 1990 + p_partkey % 9 AS fy, CASE WHEN p_partkey % 3 = 0 THEN 'Händ Bùch' ELSE 'X Handbuch' END AS author FROM part),
t AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS mine, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]{4,}')) AS theirs FROM w)
SELECT p_partkey, abs(y - fy) <= 2 AND (abs(y - fy) <= 1 OR author = 'X Handbuch') AND CASE len(theirs) WHEN 0 THEN false WHEN 1 THEN title = 'Nations' ELSE len(list_intersect(mine, theirs)) >= 2 AND 2 * len(list_intersect(mine, theirs)) >= len(theirs) END AS ok FROM t""")
def work_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), F.col("p_partkey")
    title = F.when(k % 5 == 0, "Nations").when(k % 5 == 1, "The Notes").otherwise(F.concat(F.lit("On the "), F.col("p_name")))
    author = F.when(k % 3 == 0, "Händ Bùch").otherwise("X Handbuch")
    ok = citations.verified(F.concat(F.lit("Notes on "), F.col("p_name"), F.lit(" Handbuch, *Nations*")), 1990 + F.col("p_size") % 5, title, 1990 + k % 9, F.array(author))
    return part.select("p_partkey", ok.alias("ok"))


@query()
def fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.bibliography(citations.consolidate(mentions(spark, sf_dir))).select("item_id", "key", "number", "range", F.size("variants").alias("variants"))


@query()
def work_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = citations.aggregate_mentions(_keyed(spark, sf_dir)).withColumns({"doi": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    works = cited.where("not partial").select("key", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("doi"), F.concat(F.lit("http://w/"), F.col("key")).alias("url"), F.get(c.title_spans(F.col("raw")), F.lit(0)).alias("title"), F.col("year").alias("publication_year"), F.array(F.lit("A Author1")).alias("authors"), F.lit("Press").alias("venue")).dropDuplicates(["key"])
    return citations.lookup_works(cited, works, max_misses=3).select("item_id", "key", "url", F.col("metadata.title").alias("title"))
