"""Configuration on the driver: nested merges, schemas, caps, limits."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (requests, seconds) used where a configuration has none.
DEFAULT_LIMITS = [(120, 1), (15_000, 60), (15_000, 3600)]


def merged(base: dict, updates: dict) -> dict:
    """Nested dictionaries merged, the updates' values winning."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in updates.items()}}


def without_unions(schema: Any) -> Any:
    """A JSON Schema whose type lists are their first type other than null (string if there is none)."""
    if isinstance(schema, list):
        return [without_unions(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: without_unions(v) for k, v in schema.items()}
    if isinstance(out.get("type"), list):
        out["type"] = next((t for t in out["type"] if t != "null"), "string")
    return out


def whole_number(value: Any, default: int | None = None) -> int | None:
    """Integer of a number or text like ``1_000``; ``default`` for the rest, booleans among them."""
    try:
        return default if isinstance(value, bool) else int(str(value).replace("_", ""))
    except ValueError:
        return default


def rate_limits(raw: Any) -> list[tuple[int, int]]:
    """Pairs of positive integers, or the defaults if there is none."""
    pairs = [tuple(whole_number(x, 0) for x in p) for p in raw if isinstance(p, (list, tuple)) and len(p) == 2] if isinstance(raw, list) else []
    return [p for p in pairs if min(p) > 0] or DEFAULT_LIMITS


def pool_tables(spark: SparkSession, raw: Any) -> tuple[DataFrame, DataFrame]:
    """(caps, pools): ``provider, pool, cap`` and ``provider, pool, prefix`` of ``{provider: {pool: cap or {cap, models}}}``."""
    caps, pools = [], []
    for provider, entries in (raw.items() if isinstance(raw, dict) else ()):
        for pool, value in entries.items() if isinstance(entries, dict) and provider != "enabled" else ():
            cap = whole_number(value.get("cap") if isinstance(value, dict) else value)
            if cap is not None:
                caps.append((str(provider), str(pool), cap))
            names = value.get("models") if isinstance(value, dict) else None
            pools += [(str(provider).strip().lower(), str(pool), m.strip().lower()) for m in names or () if isinstance(m, str) and m.strip()]
    return spark.createDataFrame(caps, "provider string, pool string, cap long"), spark.createDataFrame(pools, "provider string, pool string, prefix string")
