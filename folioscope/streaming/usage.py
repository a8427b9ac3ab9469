"""Usage and limits over streams: day windows, idempotent ledger batches, keyed estimates and penalty factors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.usage import FIRST_ESTIMATE, GROW_LIMITED, GROW_OTHER, MOST, NEWEST_WEIGHT, OTHER_AFTER, SHRINK


def daily_counter(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tokens per budget day (00:01 to 00:01 UTC) and key; days close ``late`` after their end."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    return stream.groupBy(F.window("ts", "1 day", "1 day", "1 minute").alias("w"), "provider", "key_env").agg(F.sum("tokens").alias("tokens")).select(F.to_date("w.start").alias("day"), "provider", "key_env", "tokens")


def ledger_batches(path: str):
    """``foreachBatch`` function that writes a batch's sums under its id, so that a replayed batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.to_date(F.col("ts") - F.expr("interval 1 minute"))
        sums = batch.where("tokens > 0").groupBy(day.alias("day"), "tool", "provider", "key_env", "pool").agg(F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def moving_estimates(events: DataFrame) -> DataFrame:
    """Running weighted mean of each key's tokens, kept as state."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (FIRST_ESTIMATE, 0)
        for batch in batches:
            for tokens in batch.sort_values("ts")["tokens"]:
                if tokens > 0:
                    value, n = NEWEST_WEIGHT * float(tokens) + (1 - NEWEST_WEIGHT) * value, n + 1
        state.update((value, n))
        yield pd.DataFrame({"key_env": [key[0]], "estimate": [value], "n": [n]})

    return events.groupBy("key_env").applyInPandasWithState(update, "key_env string, estimate double, n long", "value double, n long", "update", "NoTimeout")


def penalty_factors(events: DataFrame) -> DataFrame:
    """Running limiter factor of each key after its outcomes (ok, limited, other)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        factor, errors = state.get if state.exists else (1.0, 0)
        for batch in batches:
            for outcome in batch.sort_values("ts")["outcome"]:
                if outcome == "ok":
                    factor, errors = max(1.0, factor * SHRINK), 0
                    continue
                errors += 1
                grow = GROW_LIMITED if outcome == "limited" else GROW_OTHER if errors > OTHER_AFTER else 1.0
                factor = min(MOST, factor * grow)
        state.update((factor, errors))
        yield pd.DataFrame({"key_env": [key[0]], "factor": [factor]})

    return events.groupBy("key_env").applyInPandasWithState(update, "key_env string, factor double", "factor double, errors long", "update", "NoTimeout")
