"""Writers: one text file per item, JSON lines, state by rename, run summaries."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_texts(texts: DataFrame, path: str) -> None:
    """(item_id, text) as text files in a folder per item; existing items are replaced, others stay."""
    writer = texts.select("item_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("item_id")
    writer.option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").text(path)


def log_header(items: DataFrame, log_type: str, version: int = 2) -> DataFrame:
    """(item_id, value): first line of each item's log. ``items``: item_id, path, kind, image_count, model_name."""
    fields = F.struct(F.lit(version).alias("_format_version"), F.lit(log_type).alias("log_type"), F.col("item_id").alias("input_item_name"), F.col("path").alias("input_item_path"), F.col("kind").alias("input_type"), F.col("image_count").alias("total_images"), "model_name")
    return items.select("item_id", F.to_json(fields).alias("value"))


def append_log(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines; late ones are files like any other."""
    entries.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the target, moves the old table away, the new one to its place, then deletes the old one.

    A failed job leaves the old table; a failed rename puts it back and raises.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    old, new, away = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, f"{beside}.old"))
    system = new.getFileSystem(conf)
    if system.exists(old) and not system.rename(old, away):
        raise OSError(f"can't move {path} away; the new table is {beside}")
    if not system.rename(new, old):
        system.rename(away, old)
        raise OSError(f"can't move {beside} to {path}, which is as it was")
    system.delete(away, True)


def run_summary(items: DataFrame) -> DataFrame:
    """One JSON row of counts over (item_id, state, tokens)."""
    return items.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("items_total"), F.count_if(F.col("state") == "complete").alias("items_complete"), F.count_if(F.col("state") == "failed").alias("items_failed"), F.count_if(F.col("state") == "skipped").alias("items_skipped"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))).alias("summary"))


def read_state(spark: SparkSession, path: str) -> dict:
    """A small JSON object, empty when it is missing or broken."""
    try:
        rows = spark.read.text(path, wholetext=True).collect()
        found = json.loads(rows[0][0]) if rows else {}
    except Exception:  # state is advisory: whatever is wrong with it, a run starts afresh
        return {}
    return found if isinstance(found, dict) else {}
