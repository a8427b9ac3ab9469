"""Document tables derived from the test tables by expressions that both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as pages of documents: a third of numbers shifted, a fifth missing, small quantities as spreads."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    kind = F.when(F.col("l_suppkey") % 5 == 0, "none").when(F.col("l_returnflag") == "R", "roman").otherwise("arabic")
    number = F.col("l_linenumber") + F.when(F.col("l_partkey") % 7 == 0, 3).otherwise(0)
    return line.select(F.col("l_orderkey").cast("string").alias("item_id"), (F.row_number().over(order) - 1).alias("idx"), F.when(kind != "none", number).cast("int").alias("number"), kind.alias("number_type"), (F.col("l_quantity") < 3).alias("spread"), F.col("l_linestatus").alias("section"))


PAGES_SQL = """pages_in AS (
  SELECT cast(l_orderkey AS varchar) AS item_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS integer) AS idx,
    CASE WHEN l_suppkey % 5 <> 0 THEN cast(l_linenumber + CASE WHEN l_partkey % 7 = 0 THEN 3 ELSE 0 END AS integer) END AS number,
    CASE WHEN l_suppkey % 5 = 0 THEN 'none' WHEN l_returnflag = 'R' THEN 'roman' ELSE 'arabic' END AS number_type,
    l_quantity < 3 AS spread, l_linestatus AS section FROM lineitem
), positioned AS (
  SELECT *, CASE WHEN spread THEN 2 ELSE 1 END AS span,
    coalesce(sum(CASE WHEN spread THEN 2 ELSE 1 END) OVER (PARTITION BY item_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS vpos FROM pages_in
), flagged AS (
  SELECT *, CASE WHEN number - lag(number) OVER w = lag(span) OVER w AND vpos - lag(vpos) OVER w = lag(span) OVER w THEN 0 ELSE 1 END AS fresh
  FROM positioned WHERE number IS NOT NULL WINDOW w AS (PARTITION BY item_id, section ORDER BY idx)
), in_runs AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id, section ORDER BY idx) AS run FROM flagged
), page_runs AS (SELECT item_id, section, run, count(*) AS length, min(idx) AS start, arg_min(number, idx) AS number, arg_min(vpos, idx) AS vpos FROM in_runs GROUP BY 1, 2, 3
), page_anchors AS (
  SELECT item_id, section, number AS anchor_number, vpos AS anchor_vpos FROM (SELECT *, row_number() OVER (PARTITION BY item_id, section ORDER BY length DESC, start) AS r FROM page_runs) WHERE r = 1
), near AS (
  SELECT *, lag(idx) OVER w AS bi, lead(idx) OVER w AS ai, lag(number) OVER w AS bn, lead(number) OVER w AS an, lag(number_type) OVER w AS bt, lead(number_type) OVER w AS at_, lag(span) OVER w AS bs
  FROM positioned WINDOW w AS (PARTITION BY item_id ORDER BY idx)
), guessed AS (
  SELECT *, CASE WHEN number IS NULL AND bi = idx - 1 AND ai = idx + 1 AND bt = at_ AND bt IN ('arabic', 'roman') AND an - bn = bs + span THEN bn + bs END AS guess FROM near
), freed AS (
  SELECT g.*, g.guess IS NOT NULL AND NOT EXISTS (SELECT 1 FROM positioned p WHERE p.item_id = g.item_id AND p.number = g.guess AND p.number_type = g.bt) AS free FROM guessed g
), filled AS (
  SELECT *, free AND row_number() OVER (PARTITION BY item_id, CASE WHEN guess IS NOT NULL THEN bt END, guess ORDER BY free DESC, idx) = 1 AS inferred FROM freed
)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations made of orders, customers and parts: an item per customer, variants in case and mark by the order's key."""
    orders, part = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part.select("p_partkey", "p_name", "p_size"), F.col("o_orderkey") % 50 == F.col("p_partkey"))
    name = F.when(F.col("o_orderkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    raw = F.concat(F.lit("Author"), (F.col("o_custkey") % 7).cast("string"), F.lit(" ("), F.year("o_orderdate").cast("string"), F.lit("). *"), name, F.lit("*, vol. "), F.col("p_size").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "&more.").otherwise(" and more"), F.when(F.col("o_orderkey") % 5 == 0, " (Oxford University Press, pp. 12-34)").when(F.col("o_orderkey") % 5 == 1, " Génin").otherwise(""))
    return joined.select(F.col("o_custkey").cast("string").alias("item_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey") % 40 + 1).cast("int").alias("page"), raw.alias("raw"), (F.col("o_orderkey") % 4 == 0).alias("is_partial"))


MENTIONS_SQL = """mentions_in AS (
  SELECT cast(o_custkey AS varchar) AS item_id, o_orderkey AS ord, CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_orderkey % 40 + 1 AS integer) END AS page,
    'Author' || cast(o_custkey % 7 AS varchar) || ' (' || cast(year(o_orderdate) AS varchar) || '). *' || CASE WHEN o_orderkey % 3 = 0 THEN upper(p_name) ELSE p_name END || '*, vol. ' || cast(p_size AS varchar) || CASE WHEN o_orderkey % 2 = 0 THEN '&more.' ELSE ' and more' END || CASE o_orderkey % 5 WHEN 0 THEN ' (Oxford University Press, pp. 12-34)' WHEN 1 THEN ' Génin' ELSE '' END AS raw,
    o_orderkey % 4 = 0 AS is_partial
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN part ON o_orderkey % 50 = p_partkey
), keyed AS (
  SELECT *, trim(regexp_replace(regexp_replace(replace(replace(strip_accents(lower(replace(raw, ' (Oxford University Press, pp. 12-34)', ''))), '&', ' and '), '*', ' * '), '[,.:;()]', ' ', 'g'), '\\s+', ' ', 'g')) AS comparison_text, cast(regexp_extract(raw, '\\((\\d{4})\\)', 1) AS integer) AS year, cast(regexp_extract(raw, 'vol\\. (\\d+)', 1) AS integer) AS volume FROM mentions_in
), with_key AS (SELECT *, md5(comparison_text || '|y=' || coalesce(cast(year AS varchar), 'None') || '|v=' || coalesce(cast(volume AS varchar), 'None')) AS key FROM keyed
)"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as token usage: provider from the type, key and tool from the user, model from the JSON property."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    provider = F.when(F.col("event_type") == "click", "openai").when(F.col("event_type") == "purchase", "anthropic").when(F.col("user_id") % 17 == 0, None).otherwise("google")
    model = F.element_at(F.array(*[F.lit(m) for m in ("gpt-4.1-mini", "gpt-4.1", "openai/gpt-4o", "gpt-5.55", "some-local-model")]), (k % 5 + 1).cast("int"))
    return e.select("event_id", "ts", F.concat(F.lit("tool"), (F.col("user_id") % 2).cast("string")).alias("tool"), provider.alias("provider"), F.concat(F.lit("KEY"), (F.col("user_id") % 3).cast("string")).alias("key_env"), model.alias("model"), F.floor(F.col("value") * 100).cast("long").alias("tokens"))


USAGE_SQL = """usage_in AS (
  SELECT event_id, ts, 'tool' || cast(user_id % 2 AS varchar) AS tool, CASE WHEN event_type = 'click' THEN 'openai' WHEN event_type = 'purchase' THEN 'anthropic' WHEN user_id % 17 = 0 THEN NULL ELSE 'google' END AS provider,
    'KEY' || cast(user_id % 3 AS varchar) AS key_env,
    (['gpt-4.1-mini', 'gpt-4.1', 'openai/gpt-4o', 'gpt-5.55', 'some-local-model'])[cast(cast(json_extract_string(props, '$.k') AS integer) % 5 + 1 AS integer)] AS model, cast(floor(value * 100) AS bigint) AS tokens FROM events
)"""

#: Pools of the examples: (provider, pool, prefix).
POOLS = [("openai", "small", "gpt-4.1-mini"), ("openai", "large", "gpt-4.1"), ("openai", "large", "gpt-4o"), ("openai", "large", "gpt-5"), ("openai", "small", "gpt-5-mini"), ("anthropic", "large", "gpt-4")]
POOLS_SQL = "pools(provider, pool, prefix) AS (VALUES " + ", ".join(str(p) for p in POOLS) + ")"
