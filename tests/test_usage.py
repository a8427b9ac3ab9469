import datetime

import pytest
from pyspark.sql import functions as F

from folioscope.functions import models
from folioscope.operators import usage
from folioscope.plans.tables import POOLS
from folioscope.streaming import usage as streams


@pytest.mark.parametrize(("provider", "model", "pool"), [("openai", "gpt-4.1-mini", "small"), ("openai", "gpt-4.1", "large"), ("openai", "gpt-4o-2024-08-06", "large"), ("openai", "gpt-5.55", "large"), ("openai", "openai/gpt-4o", "large"), ("openai", "some-local-model", None), ("custom", "gpt-4o", None), ("openai", None, None), ("openai", "gpt-4onic", None)])
def test_pools(spark, provider, model, pool):
    df = spark.createDataFrame([(provider, model)], "provider string, model string")
    assert usage.derive_pool(df, spark.createDataFrame(POOLS, "provider string, pool string, prefix string")).first().pool == pool


def test_pool_configuration(spark):
    config = spark.createDataFrame([("MyHost ", {"standard": [" my-model", "my-model-large", " "]})], "provider string, pools map<string,array<string>>")
    models_ = spark.createDataFrame([("myhost", "my-model-v2")], "provider string, model string")
    assert usage.derive_pool(models_, usage.compile_pools(config)).first().pool == "standard"


def test_days_and_reset(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, 0, 30),), (datetime.datetime(2024, 1, 1, 0, 1),)], "ts timestamp_ntz")
    got = df.select(usage.budget_day(F.col("ts")).cast("string"), usage.seconds_to_reset(F.col("ts"))).collect()
    assert [tuple(r) for r in got] == [("2023-12-31", 30), ("2024-01-01", 86400)]


def test_caps_and_admission(spark):
    asked = spark.createDataFrame([("d", 1, "a", 600, 1000), ("d", 2, "a", 400, 1000), ("d", 3, "a", 1, 1000), ("d", 4, "b", 5, 1000), ("d", 5, "c", 9999, None)], "day string, seq int, bucket string, estimate int, cap int")
    assert [r.admitted for r in usage.admit(asked, 5000).orderBy("seq").collect()] == [True, True, False, True, False]
    # a large request that is refused leaves room for a small one, and a day begins anew
    later = spark.createDataFrame([("d", 1, "a", 6000, None), ("d", 2, "a", 4000, None), ("d", 3, "b", 1001, None), ("d", 4, "b", 1000, None), ("e", 1, "b", 5000, None), ("e", 2, "b", None, None)], "day string, seq int, bucket string, estimate int, cap int")
    assert [r.admitted for r in usage.admit(later, 5000).orderBy("day", "seq").collect()] == [False, True, False, True, True, True]
    # scope: unpooled buckets are free of the day's budget, unstamped requests aren't; caps can be off
    scoped = spark.createDataFrame([("d", 1, "a", 900, 500, True), ("d", 2, "free", 9000, 1, False), ("d", 3, None, 200, None, False), ("d", 4, "a", 500, 500, True)], "day string, seq int, bucket string, estimate int, cap int, pooled boolean")
    run = lambda **more: [r.admitted for r in usage.admit(scoped, 1000, **more).orderBy("seq").collect()]
    assert run() == [False, False, True, True]
    assert run(scope="pooled") == [False, True, False, False]
    assert run(scope="pooled", pool_caps=False) == [True, True, False, False]
    assert usage.admit(scoped.limit(0), 1000).collect() == []


def test_bucket_round_trip(spark):
    df = spark.createDataFrame([("p", "k", "x"), ("p", "k", None), (None, "k", "x")], "p string, k string, l string").select(usage.bucket(F.col("p"), F.col("k"), F.col("l")).alias("b"))
    assert [r.b for r in df.collect()] == ["p|k|x", "p|k|", "unattributed"]
    assert [r[0] and tuple(r[0]) for r in df.select(usage.parse_bucket(F.col("b"))).collect()] == [("p", "k", "x"), ("p", "k", None), None]


def test_estimates_and_factors(spark):
    rows = [("k", 1, 1000.0), ("k", 2, 0.0), ("k", 3, 2000.0)]
    got = usage.moving_estimate(spark.createDataFrame(rows, "key string, seq int, t double"), ["key"], "seq", "t").first()
    assert got.estimate == pytest.approx(0.3 * 2000 + 0.7 * (0.3 * 1000 + 0.7 * 25000)) and got.n == 2
    outcomes = spark.createDataFrame([("k", i, o) for i, o in enumerate(["limited", "other", "other", "ok"])], "key string, seq int, outcome string")
    assert usage.penalty_factor(outcomes).first().factor == pytest.approx(1.5 * 1.2 * 0.9)


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [tuple(one(usage.error_class(F.lit(s).cast("int"), F.lit(m)))) for s, m in [(429, ""), (503, ""), (None, "read timeout"), (None, "Rate limit"), (None, "quota"), (None, "server error"), (400, "bad")]] == [(True, "rate_limit"), (True, "server_error"), (True, "timeout"), (True, "rate_limit"), (True, "rate_limit"), (True, "server_error"), (False, "other")]
    assert [one(usage.token_count(F.lit(x))) for x in ("12", "2.5", "x", "-1")] == [12, 2, None, None]
    assert one(usage.backoff(F.lit(3), F.lit(0.5), F.lit(2.0), F.lit(120.0), F.lit(0.0))) == 4.0 and one(usage.wait_seconds(F.lit(0.0), F.lit(2.0))) == 0.5
    names = ["anthropic:x", "vendor/model", "claude-3", "gemini-2", "o3-mini", "mystery"]
    assert [one(models.client_provider(F.lit(n))) for n in names] == ["anthropic", "openrouter", "anthropic", "google", "openai", "openai"]
    assert [one(models.capability_provider(F.lit(n))) for n in names[1:]] == ["openrouter", "anthropic", "google", "openai", "unknown"]
    assert one(models.image_family(F.lit("openrouter"), F.lit("google/gemini"))) == "google"
    assert one(models.merge_flags(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))) == {"a": "1", "b": "3"}


def events(spark, tmp_path, rows):
    spark.createDataFrame(rows, "ts timestamp, tool string, provider string, key_env string, pool string, tokens long, outcome string").write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")


def run(df, mode, name, spark):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    rows = [(at(0, 0), "t", "p", "k", "x", 5, "ok"), (at(0, 2), "t", "p", "k", "x", 7, "limited"), (at(9, 0), "t", "p", "k", "x", 11, "other")]
    stream = events(spark, tmp_path, rows)
    assert sorted((str(r.day), r.tokens) for r in run(streams.daily_counter(stream), "complete", "daily", spark)) == [("2023-12-31", 5), ("2024-01-01", 18)]
    assert run(streams.moving_estimates(stream), "update", "means", spark)[-1].n == 3
    assert run(streams.penalty_factors(stream), "update", "factors", spark)[-1].factor == 1.5
    query = stream.writeStream.foreachBatch(streams.ledger_batches(f"{tmp_path}/ledger")).option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(f"{tmp_path}/ledger").agg(F.sum("tokens")).first()[0] == 23
