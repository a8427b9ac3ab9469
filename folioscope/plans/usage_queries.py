"""Queries on usage, limits and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import models
from folioscope.operators import usage
from folioscope.plans.catalog import query
from folioscope.plans.tables import POOLS, POOLS_SQL, USAGE_SQL, table, usage_events

_DAY = "cast(ts - INTERVAL 1 MINUTE AS date)"
_TEXT_DAY = f"cast({_DAY} AS varchar)"
_POOLED = f"""{USAGE_SQL}, {POOLS_SQL}, named AS (SELECT *, split_part(lower(model), '/', -1) AS nm FROM usage_in),
hits AS (SELECT event_id, pool, row_number() OVER (PARTITION BY event_id ORDER BY length(prefix) DESC) AS r FROM named JOIN pools p ON p.provider = named.provider AND (nm = prefix OR (starts_with(nm, prefix) AND substr(nm, length(prefix) + 1, 1) IN ('-', '.', ':', '@')))),
pooled AS (SELECT u.*, h.pool FROM usage_in u LEFT JOIN hits h ON h.event_id = u.event_id AND r = 1),
daily AS (SELECT {_TEXT_DAY} AS day, tool, provider, key_env, pool, cast(sum(tokens) AS bigint) AS tokens FROM pooled WHERE tokens > 0 GROUP BY ALL)"""


def _pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pools = spark.createDataFrame(POOLS, "provider string, pool string, prefix string")
    return usage.derive_pool(usage_events(spark, sf_dir), pools)


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.daily_usage(_pooled(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {_POOLED} SELECT event_id, pool FROM pooled")
def pool_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pooled(spark, sf_dir).select("event_id", "pool")


@query(f"WITH {_POOLED} SELECT * FROM daily")
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(spark, sf_dir)


@query(f"""WITH {_POOLED} SELECT day, 'all' AS grain, NULL AS tool, NULL AS provider, NULL AS key_env, NULL AS pool, cast(sum(tokens) AS bigint) AS tokens FROM daily GROUP BY day
UNION ALL SELECT day, 'tool', tool, NULL, NULL, NULL, cast(sum(tokens) AS bigint) FROM daily GROUP BY day, tool
UNION ALL SELECT day, 'bucket', NULL, provider, key_env, pool, cast(sum(tokens) AS bigint) FROM daily WHERE provider IS NOT NULL AND key_env IS NOT NULL GROUP BY day, provider, key_env, pool""")
def usage_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.snapshot(_daily(spark, sf_dir))


@query(f"""WITH {_POOLED}, c AS (SELECT day, provider, key_env, pool, cast(sum(tokens) AS bigint) AS used FROM daily WHERE provider IS NOT NULL AND key_env IS NOT NULL GROUP BY ALL),
k AS (SELECT c.*, CASE WHEN provider = 'openai' AND pool = 'large' THEN 100000 WHEN pool = 'small' THEN 50000 WHEN pool = 'large' THEN 70000 END AS cap FROM c)
SELECT day, provider, key_env, pool, used, cast(cap AS bigint) AS cap, cast(CASE WHEN cap IS NOT NULL THEN greatest(cap - used, 0) END AS bigint) AS remaining, CASE WHEN cap > 0 THEN 100.0 * used / cap END AS percent FROM k""")
def pool_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = spark.createDataFrame([("openai", "large", 100_000)], "provider string, pool string, cap long")
    defaults = spark.createDataFrame([("small", 50_000), ("large", 70_000)], "pool string, cap long")
    return usage.pool_statistics(_daily(spark, sf_dir), caps, defaults)


@query(f"""WITH RECURSIVE {_POOLED}, b AS (SELECT {_TEXT_DAY} AS day, event_id AS seq, CASE WHEN provider IS NULL THEN 'unattributed' ELSE provider || '|' || key_env || '|' || coalesce(pool, '') END AS bucket, tokens AS estimate, CASE WHEN provider = 'openai' THEN 100000 END AS cap FROM pooled),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY day ORDER BY seq) AS i FROM b),
walk AS (
  SELECT DISTINCT day, cast(0 AS bigint) AS i, cast(NULL AS bigint) AS seq, cast(NULL AS varchar) AS bucket, cast(0 AS bigint) AS total, cast(MAP {{}} AS MAP(varchar, bigint)) AS own, false AS fits_budget, false AS fits_pool FROM b
  UNION ALL
  SELECT day, i, seq, bucket, CASE WHEN fb AND fp THEN total + estimate ELSE total END, CASE WHEN fb AND fp THEN map_concat(own, MAP {{bucket: mine + estimate}}) ELSE own END, fb, fp FROM (
    SELECT *, total + estimate <= 1000000 AS fb, cap IS NULL OR mine + estimate <= cap AS fp FROM (
      SELECT n.day, n.i, n.seq, n.bucket, n.estimate, n.cap, w.total, w.own, coalesce(w.own[n.bucket], 0) AS mine FROM walk w JOIN n ON n.day = w.day AND n.i = w.i + 1)))
SELECT seq, bucket, fits_budget, fits_pool, fits_budget AND fits_pool AS admitted FROM walk WHERE i > 0""")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pooled(spark, sf_dir)
    asked = e.select(usage.budget_day(F.col("ts")).alias("day"), F.col("event_id").alias("seq"), usage.bucket(F.col("provider"), F.col("key_env"), F.col("pool")).alias("bucket"), F.col("tokens").alias("estimate"), F.when(F.col("provider") == "openai", 100_000).alias("cap"))
    return usage.admit(asked, 1_000_000).select("seq", "bucket", "fits_budget", "fits_pool", "admitted")


@query(f"WITH {USAGE_SQL} SELECT key_env, cast(floor(list_reduce(list_prepend(25000.0::double, list(cast(tokens AS double) ORDER BY event_id)), lambda a, x: 0.3 * x + (1 - 0.3) * a)) AS bigint) AS estimate, count(*) AS n FROM usage_in WHERE tokens > 0 GROUP BY key_env")
def moving_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = usage.moving_estimate(usage_events(spark, sf_dir), ["key_env"], "event_id", "tokens")
    return out.select("key_env", F.floor("estimate").alias("estimate"), F.col("n").cast("long").alias("n"))


@query(f"""WITH {USAGE_SQL}, w AS (SELECT event_id, count(*) OVER (PARTITION BY key_env ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS in_600s, count(*) OVER (PARTITION BY key_env ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_3600s FROM usage_in)
SELECT *, in_600s <= 2 AND in_3600s <= 8 AS within FROM w""")
def limiter_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = usage_events(spark, sf_dir).select("event_id", "ts", F.col("key_env").alias("key"))
    return usage.window_load(asked, [(2, 600), (8, 3600)]).select("event_id", "in_600s", "in_3600s", "within")


@query()
def penalty_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("tokens") % 5 == 0, "limited").when(F.col("tokens") % 3 == 0, "other").otherwise("ok")
    return usage.penalty_factor(usage_events(spark, sf_dir).select(F.col("key_env").alias("key"), F.col("event_id").alias("seq"), outcome.alias("outcome")))


@query("""SELECT event_id, cast(floor(1000 * least(120.0, 0.5 * pow(2.0, least(event_id % 12, 64)) + 0.25)) AS bigint) AS backoff_ms, event_id % 12 < 8 OR value < 100 AS again, CASE WHEN event_id % 12 > 5 THEN greatest(value * 1.5, 0.25) ELSE value END AS wait FROM events""")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 12
    ms = F.floor(1000 * usage.backoff(n, F.lit(0.5), F.lit(2.0), F.lit(120.0), F.lit(0.25)))
    factor = F.when(n > 5, 1.5).otherwise(1.0)
    return table(spark, sf_dir, "events").select("event_id", ms.alias("backoff_ms"), usage.keeps_trying(n, F.lit(8), F.col("value"), F.lit(100.0)).alias("again"), usage.wait_seconds(F.col("value"), factor).alias("wait"))


_MESSAGES = ["Read timed out", "Connection reset", "Rate limit reached", "quota used up", "Internal error", "model overloaded", "bad request"]
_KINDS = ["timeout", "timeout", "rate_limit", "rate_limit", "server_error", "server_error", "other"]


@query("SELECT event_id, kind, kind <> 'other' AS retryable FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'rate_limit' WHEN event_id % 11 = 0 THEN 'server_error' ELSE ([" + ", ".join(f"'{k}'" for k in _KINDS) + "])[event_id % 7 + 1] END AS kind FROM events)")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    status = F.when(k % 13 == 0, 429).when(k % 11 == 0, 503)
    message = F.get(F.array(*map(F.lit, _MESSAGES)), (k % 7).cast("int"))
    found = usage.error_class(status, message)
    return table(spark, sf_dir, "events").select("event_id", found["kind"].alias("kind"), found["retryable"].alias("retryable"))


@query(f"""SELECT event_id, {_TEXT_DAY} AS day, cast({_DAY} + INTERVAL 1 DAY + INTERVAL 1 MINUTE AS timestamp) AS reset, cast(epoch_us({_DAY} + INTERVAL 1 DAY + INTERVAL 1 MINUTE) - epoch_us(ts) AS bigint) // 1000000 AS seconds FROM events""")
def budget_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", usage.budget_day(ts).cast("string").alias("day"), usage.next_reset(ts).alias("reset"), usage.seconds_to_reset(ts).cast("long").alias("seconds"))


@query(f"""WITH {USAGE_SQL}, b AS (SELECT event_id, CASE WHEN provider IS NULL THEN 'unattributed' ELSE provider || '|' || key_env || '|' END AS bucket FROM usage_in)
SELECT event_id, bucket, CASE WHEN bucket <> 'unattributed' THEN split_part(bucket, '|', 2) END AS key_env FROM b""")
def bucket_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = usage_events(spark, sf_dir).select("event_id", usage.bucket(F.col("provider"), F.col("key_env"), F.lit(None).cast("string")).alias("bucket"))
    return made.select("event_id", "bucket", usage.parse_bucket(F.col("bucket"))["key_env"].alias("key_env"))


@query(f"""WITH {_POOLED}, s AS (SELECT day, tool, sum(tokens) AS known FROM daily GROUP BY ALL), t AS (SELECT day, tool, known + CASE WHEN tool = 'tool0' THEN 1000 ELSE -50 END AS total FROM s)
SELECT * FROM daily UNION ALL SELECT day, tool, NULL, NULL, NULL, cast(greatest(total - known, 0) AS bigint) FROM t JOIN s USING (day, tool) WHERE total > known""")
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    totals = daily.groupBy("day", "tool").agg(F.sum("tokens").alias("s")).select("day", "tool", (F.col("s") + F.when(F.col("tool") == "tool0", 1000).otherwise(-50)).alias("total"))
    return usage.reconcile(totals, daily)


@query(f"""WITH {_POOLED}, d AS (SELECT day, tool, provider, key_env, pool, tokens FROM daily UNION ALL SELECT day, tool, provider, key_env, pool, greatest(tokens - 20000, 0) FROM daily), m AS (SELECT day, tool, provider, key_env, pool, sum(tokens) AS tokens FROM d GROUP BY ALL)
SELECT m.day, m.tool, m.provider, m.key_env, m.pool, cast(greatest(m.tokens, 30000) AS bigint) AS tokens FROM m""")
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir)
    merged = usage.merge_deltas(daily, daily.withColumn("tokens", F.col("tokens") - 20_000))
    return usage.merge_seed(merged, daily.withColumn("tokens", F.lit(30_000).cast("long")))


@query(f"""WITH {USAGE_SQL} SELECT DISTINCT model, CASE WHEN contains(model, '/') THEN 'openrouter' WHEN starts_with(model, 'gpt') THEN 'openai' ELSE 'unknown' END AS capability_provider, CASE WHEN contains(model, '/') THEN 'openrouter' ELSE 'openai' END AS client_provider, CASE WHEN contains(model, '/') THEN 'openrouter' WHEN starts_with(model, 'gpt-4.1') THEN 'gpt-4.1' ELSE 'unknown' END AS family FROM usage_in""")
def model_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = usage_events(spark, sf_dir).select("model").distinct()
    registry = spark.createDataFrame([(1, "gpt-4.1", "gpt-4.1", {"supports_vision": "true"}), (2, "gpt-4", "gpt-4", {})], "ord int, prefix string, family string, flags map<string,string>")
    known = models.capabilities(names, registry)
    return known.select("model", F.col("provider").alias("capability_provider"), models.client_provider(F.col("model")).alias("client_provider"), "family")


@query(f"""WITH {USAGE_SQL} SELECT event_id, cast(CASE WHEN event_id % 4 = 0 THEN tokens ELSE tokens // 2 + tokens // 3 END + CASE WHEN event_id % 2 = 0 THEN 0 ELSE tokens // 5 + 7 END AS bigint) AS total, greatest(event_id % 900, greatest(1, cast(round_even(tokens / 7.0, 0) AS bigint))) AS reserved FROM usage_in""")
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = F.col("event_id"), F.col("tokens")
    part = lambda n: F.floor(t / n)
    total = usage.total_tokens(F.when(k % 4 == 0, t).otherwise(0), part(2), part(3), part(5), F.lit(7), k % 2 == 0)
    return usage_events(spark, sf_dir).select("event_id", total.cast("long").alias("total"), usage.reserve_amount(k % 900, t / 7.0).alias("reserved"))


@query(f"""WITH {USAGE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key_env ORDER BY event_id DESC) AS r FROM usage_in) SELECT key_env, avg(tokens) AS recent FROM r WHERE r <= 50 GROUP BY key_env""")
def recent_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key_env").orderBy(F.desc("event_id")))
    return usage_events(spark, sf_dir).withColumn("r", rank).where("r <= 50").groupBy("key_env").agg(F.avg("tokens").alias("recent"))


@query("SELECT key, count(*) AS requests, count(*) FILTER (bad) AS errors, avg(value) AS mean_wait FROM (SELECT user_id % 7 AS key, event_id % 5 = 0 AS bad, value FROM events) GROUP BY key")
def limiter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("key"), F.when(F.col("event_id") % 5 == 0, "limited").otherwise("ok").alias("outcome"), F.col("value").alias("wait"))
    return usage.limiter_statistics(asked).drop("error_share")


@query("SELECT user_id AS key, max(ts + to_seconds(event_id % 400)) AS until FROM events GROUP BY user_id")
def lookup_latches(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", (F.col("event_id") % 400).alias("retry_after"))
    return usage.latched_until(marks)


@query(f"""WITH {_POOLED}, t AS (SELECT day, cast(sum(tokens) AS bigint) AS used FROM daily GROUP BY day) SELECT day, used, greatest(0, 5000000 - used) AS remaining, 100.0 * used / 5000000 AS percent, used >= 5000000 AS exhausted FROM t""")
def usage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _daily(spark, sf_dir).groupBy("day").agg(F.sum("tokens").alias("used"))
    found = usage.usage_statistics(F.col("used"), F.lit(5_000_000), F.lit(True))
    return days.select("day", "used", found["remaining"].alias("remaining"), found["percent"].alias("percent"), found["exhausted"].alias("exhausted"))
