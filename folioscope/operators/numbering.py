"""Page numbers of documents as window functions: positions, runs, section anchors, gap inference, adjusted order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sections in order of priority.
SECTION_PRIORITY = ["content", "preface", "abstract", "appendix", "figures_tables_sources"]


def parse_page_information(summaries: DataFrame) -> DataFrame:
    """item_id, idx, number, number_type, page_types, spread, section of nested page information, with defaults."""
    p = F.col("page_information")
    types = F.coalesce(p["page_types"], F.array(F.lit("content")))
    kind = F.coalesce(p["page_number_type"], F.lit("none"))
    number = F.when(kind != "none", p["page_number_integer"])
    return summaries.select("item_id", "idx", number.alias("number"), F.when(number.isNull(), "none").otherwise(kind).alias("number_type"), types.alias("page_types"), F.coalesce(p["is_two_page_spread"], F.lit(False)).alias("spread"), primary_section(types).alias("section"))


def primary_section(types: Column) -> Column:
    out = F.coalesce(F.get(types, F.lit(0)), F.lit("content"))
    for name in reversed(SECTION_PRIORITY):
        out = F.when(F.array_contains(types, name), name).otherwise(out)
    return out


def virtual_positions(pages: DataFrame) -> DataFrame:
    """Adds ``span`` (2 for a spread) and ``vpos``, the spans of the document's earlier pages."""
    earlier = Window.partitionBy("item_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("span", F.when(F.col("spread"), 2).otherwise(1)).withColumn("vpos", F.coalesce(F.sum("span").over(earlier), F.lit(0)))


def runs(positioned: DataFrame) -> DataFrame:
    """Runs of numbered pages of a section in which number and position advance by the previous page's span."""
    order = Window.partitionBy("item_id", "section").orderBy("idx")
    step = F.lag("span").over(order)
    follows = (F.col("number") - F.lag("number").over(order) == step) & (F.col("vpos") - F.lag("vpos").over(order) == step)
    marked = positioned.where("number is not null").withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("_new").over(order))
    return marked.groupBy("item_id", "section", "run").agg(F.count(F.lit(1)).alias("length"), F.min("idx").alias("start"), F.min_by("number", "idx").alias("number"), F.min_by("vpos", "idx").alias("vpos"))


def anchors(positioned: DataFrame) -> DataFrame:
    """First page of each section's longest run (of equal ones the earliest)."""
    best = F.min_by(F.struct("number", "vpos"), F.struct((-F.col("length")).alias("l"), "start"))
    return runs(positioned).groupBy("item_id", "section").agg(best.alias("b")).select("item_id", "section", F.col("b.number").alias("anchor_number"), F.col("b.vpos").alias("anchor_vpos"))


def infer_gaps(positioned: DataFrame) -> DataFrame:
    """Numbers an unnumbered page between adjacent pages of one numbering, arabic or roman, if the number is free."""
    order = Window.partitionBy("item_id").orderBy("idx")
    near = lambda name, by: (F.lag if by < 0 else F.lead)(name).over(order)
    before, after = near("number", -1), near("number", 1)
    fits = F.col("number").isNull() & (near("idx", -1) == F.col("idx") - 1) & (near("idx", 1) == F.col("idx") + 1) & (near("number_type", -1) == near("number_type", 1)) & near("number_type", -1).isin("arabic", "roman") & (after - before == near("span", -1) + F.col("span"))
    guess = positioned.withColumns({"_kind": F.when(fits, near("number_type", -1)), "_guess": F.when(fits, before + near("span", -1))})
    claimed = F.collect_set(F.when(F.col("number").isNotNull(), F.struct(F.col("number_type").alias("k"), F.col("number").alias("n")))).over(Window.partitionBy("item_id"))
    free = guess.withColumn("_free", F.col("_guess").isNotNull() & ~F.array_contains(claimed, F.struct(F.col("_kind").alias("k"), F.col("_guess").alias("n"))))
    first = F.row_number().over(Window.partitionBy("item_id", "_kind", "_guess").orderBy(F.col("_free").desc(), "idx")) == 1
    chosen = free.withColumn("_use", F.col("_free") & first)
    return chosen.withColumns({"inferred": F.col("_use"), "number_type": F.when(F.col("_use"), F.col("_kind")).otherwise(F.col("number_type")), "number": F.when(F.col("_use"), F.col("_guess")).otherwise(F.col("number"))}).drop("_kind", "_guess", "_free", "_use")


def adjust(pages: DataFrame) -> DataFrame:
    """Final number, end number of spreads and order of every page (item_id, idx, number, number_type, section, spread)."""
    positioned = virtual_positions(pages)
    filled = infer_gaps(positioned)
    joined = filled.join(anchors(positioned), ["item_id", "section"], "left")
    moved = F.col("anchor_number") + F.col("vpos") - F.col("anchor_vpos")
    own = F.when(F.col("number") >= 1, F.col("number")).otherwise(F.col("vpos") + 1)
    final = F.when(F.col("number").isNull(), None).when(F.col("anchor_number").isNull(), own).when(moved >= 1, moved)
    out = joined.withColumn("final_number", final.cast("long"))
    kind = F.when(F.col("final_number").isNull(), "none").when(F.col("number_type") == "none", "arabic").otherwise(F.col("number_type"))
    section = Window.partitionBy("item_id", "section")
    ranked = out.withColumns({"final_type": kind, "final_end": F.when(F.col("spread"), F.col("final_number") + 1), "section_median": F.median("idx").over(section), "section_start": F.min("idx").over(section)})
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("section_median", "section_start", "idx"))
    return ranked.withColumn("place", place)
