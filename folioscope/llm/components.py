"""Connected components by alternating large-star and small-star steps, as DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.storage import Scratch


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; ``component`` is its smallest node.

    Nulls and self loops are ignored, repeated edges count once, an empty table gives an empty result. Each round is
    written to the shared folder, so a lost executor costs one round. Hubs stay safe: a hub's neighbours are reduced by a
    partial minimum, and the join that hands the minimum back has one row on the other side, which AQE can split.
    """
    scratch = Scratch(spark, "components")
    real = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    pair = edges.where(real).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    current = scratch.table(pair)
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following = scratch.table(small)
        after = _mark(following)
        scratch.drop(current)
        current, stable, mark = following, after == mark, after
        if stable:
            break
    else:
        raise RuntimeError("components did not converge")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
