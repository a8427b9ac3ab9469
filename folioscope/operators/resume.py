"""Incremental recomputation: state of items from their outputs and logs, pending pages, reuse of earlier results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def completed_pages(log: DataFrame) -> DataFrame:
    """(item_id, idx) of pages logged without an error; an ``error`` key that is present but null still is one."""
    return log.where("idx is not null and not has_error").select("item_id", "idx").distinct()


def pending_pages(items: DataFrame, completed: DataFrame) -> DataFrame:
    """Pages 0 .. image_count - 1 of each item that aren't completed: an anti-join."""
    pages = items.where("image_count > 0").select("item_id", F.explode(F.sequence(F.lit(0), F.col("image_count") - 1)).alias("idx"))
    return pages.join(completed, ["item_id", "idx"], "left_anti")


def eligible(entries: DataFrame, completed: DataFrame, items: DataFrame) -> DataFrame:
    """Log entries of completed pages that the item still has: a semi-join."""
    known = items.select("item_id", "image_count")
    return entries.join(completed, ["item_id", "idx"], "left_semi").join(known, "item_id").where((F.col("idx") >= 0) & (F.col("idx") < F.col("image_count"))).drop("image_count")


def reuse(pages: DataFrame, prior: DataFrame) -> DataFrame:
    """Adds the last error-free prior summary of each page, null where it must be made anew. ``prior``: item_id, idx, ord, summary, error."""
    newest = prior.withColumn("_r", F.row_number().over(Window.partitionBy("item_id", "idx").orderBy(F.desc("ord")))).where("_r = 1")
    kept = newest.where("error is null").select("item_id", "idx", F.col("summary").alias("reused"))
    return pages.join(kept, ["item_id", "idx"], "left").withColumn("regenerate", F.col("reused").isNull())


def item_states(items: DataFrame, log: DataFrame, outputs: DataFrame, summarize: bool = True) -> DataFrame:
    """State of each item: complete, transcription_only, partial or none.

    ``items``: item_id, image_count; ``log``: item_id, idx, has_error; ``outputs``: item_id, kind (txt, md), size. An output
    counts if it isn't empty. A log is short when it has fewer entries, errors included, than the item has images.
    """
    logged = log.where("idx is not null").groupBy("item_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if("has_error").alias("errors"), F.countDistinct(F.when(~F.col("has_error"), F.col("idx"))).alias("done"))
    made = outputs.where("size > 0").groupBy("item_id").agg(F.bool_or(F.col("kind") == "txt").alias("txt"), F.bool_or(F.col("kind") == "md").alias("md"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False))
    out = items.join(logged, "item_id", "left").join(made, "item_id", "left")
    missing = ~no("txt") | (F.lit(summarize) & ~no("md"))
    short = (zero("entries") < F.col("image_count")) | (zero("errors") > 0)
    state = F.when(~missing & ~short, "complete").when(no("txt") & F.lit(summarize), "transcription_only").when(zero("done") > 0, "partial").otherwise("none")
    return out.select("item_id", "image_count", zero("entries").alias("entries"), zero("errors").alias("errors"), zero("done").alias("done"), state.alias("state"))


def input_changed(size: Column, logged_size: Column, mtime: Column, logged_mtime: Column) -> Column:
    """Whether size, or else modification time, differs from the logged one; unknown means unchanged."""
    return F.coalesce(size != logged_size, F.lit(False)) | F.coalesce(mtime != logged_mtime, F.lit(False))


def folder_changed(count: Column, logged_count: Column, size: Column, logged_size: Column) -> Column:
    return F.coalesce(count != logged_count, F.lit(False)) | F.coalesce(size != logged_size, F.lit(False))


def model_note(logged: Column, current: Column) -> Column:
    return F.when(logged != current, F.concat(F.lit("resumed with "), current, F.lit(", logged with "), logged))


def run_report(pages: DataFrame) -> DataFrame:
    """Per item: pages ok, failed, deferred, mean seconds, whether outputs may be written. ``pages``: item_id, error, deferred, seconds."""
    return pages.groupBy("item_id").agg(F.count_if(F.col("error").isNull() & ~F.col("deferred")).alias("ok"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if("deferred").alias("deferred"), F.coalesce(F.avg(F.when(F.col("error").isNull(), F.col("seconds"))), F.lit(0.0)).alias("mean_seconds"), (F.count_if("deferred") == 0).alias("writable"))


def totals(reports: DataFrame, columns: list[str]) -> DataFrame:
    return reports.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in columns])


def moving_rate(pages: DataFrame) -> DataFrame:
    """Remaining seconds by 0.7 of the overall and 0.3 of the last ten pages' rate; null for the first five. ``pages``: item_id, seq, seconds, total."""
    upto = Window.partitionBy("item_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    recent = Window.partitionBy("item_id").orderBy("seq").rowsBetween(-9, 0)
    n = F.count(F.lit(1)).over(upto)
    rate = 0.7 * n / F.sum("seconds").over(upto) + 0.3 / F.avg("seconds").over(recent)
    return pages.withColumns({"done": n, "eta": F.when((n > 5) & (rate > 0), (F.col("total") - n) / rate)})


def duplicate_targets(items: DataFrame) -> DataFrame:
    """(dir, stem) that more than one item would write to."""
    return items.groupBy("dir", "stem").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("item_id")).alias("items")).where("n > 1")


def select_items(items: DataFrame, spec: str, label: str = "label", order: str = "item_id") -> DataFrame:
    """Items by 1-based numbers and ranges (``1,3-5;8``, in order of ``order``) or, if no part is one, by a part of the label."""
    numbers: set[int] = set()
    for part in spec.replace(";", ",").split(","):
        low, dash, high = part.strip().partition("-")
        if low.strip().isdigit() and (not dash or high.strip().isdigit()):
            numbers.update(range(int(low), int(high or low) + 1) if dash else [int(low)])
    if numbers:
        # no more rows than the largest number asked for are ranked
        first = items.orderBy(order).limit(max(numbers))
        return first.withColumn("_n", F.row_number().over(Window.orderBy(order))).where(F.col("_n").isin(sorted(numbers))).drop("_n")
    return items.where(F.contains(F.lower(label), F.lit(spec.strip().lower())))
