"""Token usage: buckets, pools, daily budgets, snapshots, admission, averages and request limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Limiter factors, penalty, threshold and ceiling; first estimate and weight of the moving average.
SHRINK, GROW_LIMITED, GROW_OTHER, OTHER_AFTER, MOST, PENALTY = 0.9, 1.5, 1.2, 2, 5.0, 0.5
FIRST_ESTIMATE, NEWEST_WEIGHT = 25_000.0, 0.3


def budget_day(ts: Column) -> Column:
    """A day begins at 00:01 UTC."""
    return F.to_date(ts - F.expr("interval 1 minute"))


def next_reset(ts: Column) -> Column:
    return F.date_add(budget_day(ts), 1).cast("timestamp_ntz") + F.expr("interval 1 minute")


def seconds_to_reset(ts: Column) -> Column:
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", ts.cast("timestamp_ntz"), next_reset(ts)))


def compile_pools(config: DataFrame) -> DataFrame:
    """``(provider, pool, prefix)`` of a table (provider, pools map<string, array<string>>): trimmed lower case, blanks dropped."""
    flat = config.select(F.lower(F.trim("provider")).alias("provider"), F.explode("pools").alias("pool", "names")).select("provider", "pool", F.explode("names").alias("prefix"))
    return flat.select("provider", "pool", F.lower(F.trim("prefix")).alias("prefix")).where("prefix <> ''").distinct()


def derive_pool(models: DataFrame, pools: DataFrame) -> DataFrame:
    """Adds ``pool``: that of the longest prefix of the model's name which ends at a separator; a router's part is cut off."""
    name = F.element_at(F.split(F.lower(F.trim("model")), "/"), -1)
    distinct = models.select("provider", "model").distinct().withColumn("_name", name)
    dim = pools.select(F.col("provider").alias("_p"), "prefix", "pool")
    after = F.substring(F.col("_name"), F.length("prefix") + 1, F.lit(1))
    fits = (F.lower("provider") == F.col("_p")) & F.col("_name").startswith(F.col("prefix")) & ((F.col("_name") == F.col("prefix")) | after.isin("-", ".", ":", "@"))
    best = distinct.join(dim, fits).groupBy("provider", "model").agg(F.max_by("pool", F.struct(F.length("prefix"), "pool")).alias("pool"))
    m = best.select(F.col("provider").alias("_bp"), F.col("model").alias("_bm"), "pool")
    return models.join(m, (F.col("provider") == F.col("_bp")) & (F.col("model") == F.col("_bm")), "left").drop("_bp", "_bm")


def bucket(provider: Column, key_env: Column, pool: Column) -> Column:
    """``provider|key|pool``, or ``unattributed`` without provider or key."""
    return F.when(provider.isNull() | key_env.isNull(), "unattributed").otherwise(F.concat_ws("|", provider, key_env, F.coalesce(pool, F.lit(""))))


def parse_bucket(text: Column) -> Column:
    parts = F.split(text, "\\|")
    return F.when(F.size(parts) == 3, F.struct(parts[0].alias("provider"), parts[1].alias("key_env"), F.nullif(parts[2], F.lit("")).alias("pool")))


def daily_usage(events: DataFrame) -> DataFrame:
    """Tokens per day, tool, provider, key and pool; non-positive ones don't count."""
    return events.where("tokens > 0").groupBy(budget_day(F.col("ts")).alias("day"), "tool", "provider", "key_env", "pool").agg(F.sum("tokens").alias("tokens"))


def snapshot(usage: DataFrame) -> DataFrame:
    """Totals of a day at three grains in one pass: all, by tool, by bucket across tools (unattributed left out)."""
    keys = ["day", "tool", "provider", "key_env", "pool"]
    sets = usage.groupingSets([["day"], ["day", "tool"], ["day", "provider", "key_env", "pool"]], *keys)
    grain = F.when(F.col("_grain") == 15, "all").when(F.col("_grain") == 7, "tool").otherwise("bucket")
    out = sets.agg(F.grouping_id().alias("_grain"), F.sum("tokens").alias("tokens")).select("day", grain.alias("grain"), *keys[1:], "tokens")
    return out.where("grain <> 'bucket' or (provider is not null and key_env is not null)")


def reconcile(totals: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows plus an unattributed remainder where a tool's total exceeds them; totals never fall below their rows."""
    sums = rows.groupBy("day", "tool").agg(F.sum("tokens").alias("known"))
    both = totals.join(sums, ["day", "tool"], "full")
    rest = both.withColumn("tokens", F.greatest(F.coalesce("total", F.lit(0)) - F.coalesce("known", F.lit(0)), F.lit(0))).where("tokens > 0")
    none = F.lit(None).cast("string")
    return rows.select("day", "tool", "provider", "key_env", "pool", "tokens").unionByName(rest.select("day", "tool", none.alias("provider"), none.alias("key_env"), none.alias("pool"), "tokens"))


def merge_deltas(usage: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds deltas (negative ones as 0) to a usage table."""
    keys = ["day", "tool", "provider", "key_env", "pool"]
    return usage.select(*keys, "tokens").unionByName(deltas.select(*keys, F.greatest("tokens", F.lit(0)).alias("tokens"))).groupBy(*keys).agg(F.sum("tokens").alias("tokens"))


def merge_seed(usage: DataFrame, seed: DataFrame) -> DataFrame:
    """Largest of both, so that seeding twice changes nothing."""
    keys = ["day", "tool", "provider", "key_env", "pool"]
    return usage.select(*keys, "tokens").unionByName(seed.select(*keys, "tokens")).groupBy(*keys).agg(F.max("tokens").alias("tokens"))


def pool_statistics(usage: DataFrame, caps: DataFrame, defaults: DataFrame) -> DataFrame:
    """Per bucket: used, cap (own, else the pool label's default, else none), remaining, percent. Cap tables are small dimensions."""
    used = usage.where("provider is not null and key_env is not null").groupBy("day", "provider", "key_env", "pool").agg(F.sum("tokens").alias("used"))
    own = caps.select("provider", "pool", F.col("cap").alias("own_cap"))
    joined = used.join(own, ["provider", "pool"], "left").join(defaults.select("pool", F.col("cap").alias("default_cap")), "pool", "left")
    cap = F.coalesce("own_cap", "default_cap")
    return joined.select("day", "provider", "key_env", "pool", "used", cap.alias("cap"), F.when(cap.isNotNull(), F.greatest(cap - F.col("used"), F.lit(0))).alias("remaining"), F.when(cap > 0, 100.0 * F.col("used") / cap).alias("percent"))


def admit(requests: DataFrame, limit: int, used: int = 0, scope: str = "all", pool_caps: bool = True) -> DataFrame:
    """Admits requests (day, seq, bucket, estimate, cap and, if present, pooled) in order, as reservations are made.

    Only what is admitted is reserved: a request that doesn't fit leaves room for a smaller one after it. The day's budget
    binds every request with ``scope="all"``; with ``"pooled"`` it binds requests without a bucket and those of a pool. A
    null cap is no cap, a null estimate is 0; without a column ``pooled`` every bucket is a pool's. Each decision needs
    those before it in its day, so a day is one sorted stream that is read in batches; what is held is one sum a bucket.
    """
    if scope not in ("all", "pooled"):
        raise ValueError(f"scope is all or pooled, not {scope}")
    room = limit - used
    has_pooled = "pooled" in requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        day, total, own = None, 0, {}
        for batch in batches:
            days, buckets, estimates, caps = (batch.column(n).to_pylist() for n in ("day", "bucket", "estimate", "cap"))
            pools = batch.column("pooled").to_pylist() if has_pooled else [True] * len(days)
            gates: list[tuple[bool, bool]] = []
            for this, bucket, estimate, cap, pooled in zip(days, buckets, estimates, caps, pools, strict=True):
                if this != day:
                    day, total, own = this, 0, {}
                estimate = estimate or 0
                free = scope == "pooled" and bucket is not None and not pooled
                gate = free or total + estimate <= room, not pool_caps or not pooled or cap is None or own.get(bucket, 0) + estimate <= cap
                if all(gate):
                    total += estimate
                    own[bucket] = own.get(bucket, 0) + estimate
                gates.append(gate)
            more = [pa.array([a for a, _ in gates], pa.bool_()), pa.array([b for _, b in gates], pa.bool_()), pa.array([a and b for a, b in gates], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "fits_budget", "fits_pool", "admitted"])

    schema = T.StructType([*requests.schema.fields, *(T.StructField(n, T.BooleanType()) for n in ("fits_budget", "fits_pool", "admitted"))])
    return requests.repartition("day").sortWithinPartitions("day", "seq").mapInArrow(run, schema)


def moving_estimate(samples: DataFrame, by: list[str], order: str, value: str, first: float = FIRST_ESTIMATE, weight: float = NEWEST_WEIGHT) -> DataFrame:
    """Exponentially weighted mean of each key's positive samples in order, begun at ``first``."""
    rows = samples.where(F.col(value) > 0).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v")))).alias("s"))
    return rows.select(*by, F.aggregate("s", F.lit(first), lambda a, x: weight * x["v"] + (1 - weight) * a).alias("estimate"), F.size("s").alias("n"))


def reserve_amount(hint: Column, estimate: Column) -> Column:
    return F.greatest(F.coalesce(hint, F.lit(0)), F.greatest(F.lit(1), F.bround(estimate).cast("long")))


def window_load(requests: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """For each request and each window of (n, seconds): how many of its key fall into the window up to it, and whether all windows hold."""
    out, fits = requests, F.lit(True)
    for n, seconds in windows:
        frame = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).rangeBetween(-seconds, 0)
        name = f"in_{seconds}s"
        out = out.withColumn(name, F.count(F.lit(1)).over(frame))
        fits = fits & (F.col(name) <= n)
    return out.withColumn("within", fits)


def penalty_factor(outcomes: DataFrame) -> DataFrame:
    """Limiter factor of each key after its outcomes (``ok``, ``limited``, ``other``) in order of ``seq``: a fold."""
    rows = outcomes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "outcome"))).alias("s"))
    start = F.struct(F.lit(1.0).alias("f"), F.lit(0).alias("errors"))

    def step(a: Column, x: Column) -> Column:
        errors = F.when(x["outcome"] == "ok", 0).otherwise(a["errors"] + 1)
        grown = F.when(x["outcome"] == "limited", a["f"] * GROW_LIMITED).when(errors > OTHER_AFTER, a["f"] * GROW_OTHER).otherwise(a["f"])
        return F.struct(F.when(x["outcome"] == "ok", F.greatest(F.lit(1.0), a["f"] * SHRINK)).otherwise(F.least(F.lit(MOST), grown)).alias("f"), errors.alias("errors"))

    return rows.select("key", F.aggregate("s", start, step, lambda a: a["f"]).alias("factor"), F.size("s").alias("n"))


def wait_seconds(wait: Column, factor: Column) -> Column:
    """Wait of a request under a factor: scaled, and never below the penalty of the factor's excess."""
    return F.when(factor > 1, F.greatest(wait * factor, (factor - 1) * PENALTY)).otherwise(wait)


def backoff(attempt: Column, base: Column, multiplier: Column, cap: Column, jitter: Column) -> Column:
    return F.least(cap, base * F.pow(multiplier, F.least(attempt, F.lit(64))) + jitter)


def error_class(status: Column, message: Column) -> Column:
    """struct(retryable, kind): by status first, then by words of the message."""
    low = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: low.rlike("|".join(words))
    kind = F.when(status == 429, "rate_limit").when((status >= 500) & (status < 600), "server_error").when(has("timeout", "timed out", "connect"), "timeout")
    kind = kind.when((has("rate") & has("limit")) | has("quota", "resource_exhausted", "resource has been exhausted"), "rate_limit")
    kind = kind.when((has("server") & has("error")) | has("internal error", "overloaded", "capacity", "502", "503", "504"), "server_error").otherwise("other")
    return F.struct((kind != "other").alias("retryable"), kind.alias("kind"))


def keeps_trying(attempt: Column, most: Column, elapsed: Column, window: Column) -> Column:
    return (attempt < most) | (elapsed < window)


def token_count(value: Column) -> Column:
    """Whole tokens of a number or numeric text; booleans, negatives and other texts are null."""
    number = value.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (number >= 0), F.bround(number).cast("long"))


def total_tokens(total: Column, given: Column, made: Column, cache_read: Column, cache_made: Column, folded: Column) -> Column:
    """Reported total, or input plus output; cache tokens are added unless the report folds them in."""
    z = F.lit(0)
    return F.coalesce(F.nullif(total, z), F.coalesce(given, z) + F.coalesce(made, z)) + F.when(F.coalesce(folded, F.lit(False)), 0).otherwise(F.coalesce(cache_read, z) + F.coalesce(cache_made, z))


def effective_used(shared: Column, degraded: Column, combined: Column, unsynced: Column, own: Column) -> Column:
    return F.when(shared & ~degraded, combined + unsynced).otherwise(own)


def limiter_statistics(requests: DataFrame) -> DataFrame:
    """Per key: requests, errors, share of errors, mean wait. ``requests``: key, outcome, wait."""
    bad = F.col("outcome") != "ok"
    return requests.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.count_if(bad).alias("errors"), (F.count_if(bad) / F.count(F.lit(1))).alias("error_share"), F.coalesce(F.avg("wait"), F.lit(0.0)).alias("mean_wait"))


def latched_until(marks: DataFrame) -> DataFrame:
    """Per key the time until which look-ups rest: the latest mark (key, ts, retry_after seconds)."""
    return marks.groupBy("key").agg(F.max(F.timestamp_add("SECOND", F.col("retry_after").cast("int"), F.col("ts"))).alias("until"))


def usage_rows(usage: DataFrame) -> DataFrame:
    """Positive rows in a fixed order."""
    return usage.where("tokens > 0").orderBy("tool", "provider", "key_env", F.coalesce("pool", F.lit("")))


def usage_statistics(used: Column, limit: Column, enabled: Column) -> Column:
    """struct(remaining, percent, exhausted): the limit itself and nothing used where limiting is off."""
    left = F.when(enabled, F.greatest(F.lit(0), limit - used)).otherwise(limit)
    return F.struct(left.alias("remaining"), F.when(enabled & (limit > 0), 100.0 * used / limit).otherwise(0.0).alias("percent"), (enabled & (used >= limit)).alias("exhausted"))
