"""Names of models and providers: inference, image families, capabilities by a registry of prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefixes of provider names, keys' variable names, prefixes of OpenAI models.
CLIENT_PREFIXES = [("openai", ["gpt-5", "gpt-4", "o1", "o3", "o4", "text-"]), ("anthropic", ["claude-"]), ("google", ["gemini-"])]
KEY_ENVS = {"openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY", "openrouter": "OPENROUTER_API_KEY"}
OPENAI_NAMES = ["gpt", "o1", "o3", "o4", "text-", "chatgpt"]
PROVIDERS = ["openai", "anthropic", "google", "openrouter", "custom"]


def _starts(name: Column, prefixes: list[str]) -> Column:
    return name.rlike("^(" + "|".join(p.replace("-", "\\-") for p in prefixes) + ")")


def capability_provider(model: Column) -> Column:
    m = F.lower(F.trim(model))
    return F.when(m.contains("/"), "openrouter").when(m.startswith("claude") | m.contains("anthropic"), "anthropic").when(m.startswith("gemini") | m.contains("google"), "google").when(_starts(m, OPENAI_NAMES), "openai").otherwise("unknown")


def client_provider(model: Column) -> Column:
    """Explicit ``provider:`` first, then a slash, then the prefix table; OpenAI by default."""
    explicit = F.lower(F.get(F.split(model, ":"), F.lit(0)))
    low = F.lower(model)
    out = F.when(model.contains(":") & explicit.isin(PROVIDERS), explicit).when(model.contains("/"), "openrouter")
    for provider, prefixes in CLIENT_PREFIXES:
        out = out.when(_starts(low, prefixes), provider)
    return out.otherwise("openai")


def image_family(provider: Column, model: Column) -> Column:
    p, m = F.lower(provider), F.lower(F.coalesce(model, F.lit("")))
    return F.when(p.isin("custom", "google", "anthropic", "openai"), p).when(m.contains("gemini") | m.contains("google/"), "google").when(m.contains("claude") | m.contains("anthropic/"), "anthropic").otherwise("openai")


def image_section(family: Column) -> Column:
    return F.concat(F.when(family == "openai", "api").otherwise(family), F.lit("_image_processing"))


def key_env(provider: Column, custom: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KEY_ENVS.items() for x in pair])
    return F.coalesce(custom, table[provider])


def capabilities(models: DataFrame, registry: DataFrame) -> DataFrame:
    """First registry entry (ord, prefix, family, flags map<string,string>) that the model's name starts with.

    Reasoning models of the o-series need a look at what does not follow; other names get the conservative profile.
    """
    name = F.lower(F.trim("model"))
    distinct = models.select("model").distinct().withColumn("_m", name)
    hit = distinct.join(registry.withColumnRenamed("prefix", "_p"), F.col("_m").startswith(F.col("_p")))
    best = hit.groupBy("model").agg(F.min_by(F.struct("family", "flags"), "ord").alias("_b"))
    o3 = (F.col("_m") == "o3") | F.col("_m").rlike("^o3-(?!mini|pro)")
    special = F.when(o3, "o3").when(F.col("_m").startswith("o1-pro"), "o1-pro").when(F.col("_m").startswith("o1") & ~F.col("_m").startswith("o1-mini"), "o1").when(F.col("_m").contains("/"), "openrouter").otherwise("unknown")
    plain = F.create_map(F.lit("supports_vision"), F.lit("false"), F.lit("supports_structured_output"), F.lit("false"), F.lit("supports_temperature"), F.lit("true"))
    out = distinct.join(best, "model", "left")
    return models.join(out.select("model", F.coalesce(F.col("_b.family"), special).alias("family"), F.coalesce(F.col("_b.flags"), plain).alias("flags"), capability_provider(F.col("model")).alias("provider")), "model")


def merge_flags(base: Column, overrides: Column) -> Column:
    """Map of both, the overrides' values winning."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(overrides), k))
    return F.map_concat(kept, overrides)
