"""Summaries of documents as ordered report lines: which pages count, headings, structure, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.numbers import structure_range, to_roman
from folioscope.functions.text import one_line

#: Page types with bullets, order and labels of structure types, marks of failed pages.
BULLET_TYPES = ["content", "abstract", "preface", "appendix", "figures_tables_sources"]
STRUCTURE_TYPES = ["title_page", "copyright", "abstract", "table_of_contents", "preface", "figures_tables_sources", "appendix", "bibliography", "index", "other"]
LABELS = {"content": "Content", "preface": "Preface", "appendix": "Appendix", "figures_tables_sources": "Figures, Tables & Sources", "table_of_contents": "Table of Contents", "bibliography": "Bibliography", "title_page": "Title Page", "index": "Index", "blank": "Blank Pages", "abstract": "Abstract", "copyright": "Copyright", "other": "Other"}
FAILURE_MARKS = ["[error generating summary", "[summary generation failed", "[transcription failed", "[transcription error"]
BLANK_MARKS = ["no transcribable text", "transcription not possible", "no transcription possible", "empty page"]


def normalize_references(variant: Column) -> Column:
    """array<struct<citation, is_partial>> of a JSON text with strings or objects; malformed and blank ones go."""
    items = F.coalesce(F.from_json(variant, "array<string>"), F.array().cast("array<string>"))
    as_object = lambda x: F.from_json(x, "struct<citation:string,is_partial:boolean>")
    text = lambda x: F.trim(F.when(x.startswith("{"), as_object(x)["citation"]).otherwise(x))
    partial = lambda x: F.coalesce(F.when(x.startswith("{"), as_object(x)["is_partial"]), F.lit(False))
    return F.filter(F.transform(items, lambda x: F.struct(text(x).alias("citation"), partial(x).alias("is_partial"))), lambda r: F.coalesce(F.length(r["citation"]), F.lit(0)) > 0)


def summary_payload(result: Column) -> Column:
    """JSON of a page's summary: the result itself if it has page information, else its ``summary``."""
    return F.when(F.get_json_object(result, "$.page_information").startswith("{"), result).otherwise(F.get_json_object(result, "$.summary"))


def page_information(payload: Column) -> Column:
    """struct(number, kind, types, spread, end) of a summary's JSON for rendering.

    Unlike numbering, a missing kind is arabic here; a page without a number or of kind none is unnumbered; without any page
    information the record's ``page`` stands.
    """
    info = F.from_json(F.get_json_object(payload, "$.page_information"), "struct<page_number_integer:int,page_number_integer_end:int,page_number_type:string,page_types:array<string>,is_two_page_spread:boolean>")
    one_type = F.get_json_object(payload, "$.page_information.page_types")
    types = F.when(F.size(info["page_types"]) > 0, info["page_types"]).when(one_type.isNotNull() & ~one_type.startswith("["), F.array(one_type)).otherwise(F.array(F.lit("content")))
    given = F.coalesce(info["page_number_type"], F.lit("arabic"))
    numbered = info["page_number_integer"].isNotNull() & (given != "none")
    spread = F.coalesce(info["is_two_page_spread"], F.lit(False))
    full = F.struct(F.when(numbered, info["page_number_integer"]).alias("number"), F.when(numbered, given).otherwise("none").alias("kind"), types.alias("types"), spread.alias("spread"), F.when(numbered & spread, F.coalesce(info["page_number_integer_end"], info["page_number_integer"] + 1)).alias("end"))
    bare = F.struct(F.get_json_object(payload, "$.page").try_cast("int").alias("number"), F.lit("arabic").alias("kind"), F.array(F.lit("content")).alias("types"), F.lit(False).alias("spread"), F.lit(None).cast("int").alias("end"))
    return F.when(info.isNotNull(), full).otherwise(bare)


def filled_information(info: Column, page: Column) -> Column:
    """Page information of an answer with what it lacks: the page's own number, kind by the number, content, no spread."""
    number = F.coalesce(info["page_number_integer"], page)
    kind = F.coalesce(info["page_number_type"], F.when(info.isNull() | (number > 0), "arabic").otherwise("none"))
    return F.struct(number.alias("page_number_integer"), F.coalesce(info["is_two_page_spread"], F.lit(False)).alias("is_two_page_spread"), info["page_number_integer_end"].alias("page_number_integer_end"), kind.alias("page_number_type"), F.coalesce(info["page_types"], F.array(F.lit("content"))).alias("page_types"))


def is_failure_mark(bullet: Column) -> Column:
    low = F.lower(F.trim(bullet))
    out = F.lit(False)
    for mark in FAILURE_MARKS:
        out = out | low.startswith(mark)
    return out


def is_failed(error: Column, bullets: Column) -> Column:
    one = (F.size(bullets) == 1) & F.coalesce(is_failure_mark(F.get(bullets, F.lit(0))), F.lit(False))
    return (F.coalesce(error, F.lit("")) != "") | one


def bears_bullets(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, BULLET_TYPES)))


def structure_types(types: Column) -> Column:
    """Structure types of a page, in its order, repeats kept."""
    return F.filter(types, lambda t: t.isin(STRUCTURE_TYPES))


def is_meaningful(types: Column, bullets: Column, references: Column, error: Column) -> Column:
    """Whether a page appears in the report."""
    structural = F.size(structure_types(types)) > 0
    only = F.lower(F.trim(F.get(bullets, F.lit(0))))
    marker = (F.size(bullets) == 1) & F.coalesce(only.startswith("[") & only.rlike("|".join(BLANK_MARKS)), F.lit(False))
    with_text = bears_bullets(types) & (F.size(bullets) > 0) & ~marker
    return (F.size(references) > 0) | is_failed(error, bullets) | ((types != F.array(F.lit("blank"))) & (with_text | structural))


def heading(number: Column, kind: Column, types: Column, spread: Column, end: Column) -> Column:
    has = lambda t: F.array_contains(types, t)
    prefix = F.when(has("abstract") & ~has("content"), "[Abstract] ").when(has("preface"), "[Preface] ").when(has("appendix"), "[Appendix] ").when(has("figures_tables_sources"), "[Figures/Tables] ").otherwise("")
    show = lambda n: F.when(kind == "roman", to_roman(n)).otherwise(n.cast("string"))
    none = number.isNull() | (kind == "none")
    pair = F.when(none, "[Unnumbered spread]").otherwise(F.concat(F.lit("Pages "), show(number), F.lit("-"), show(F.coalesce(end, number + 1))))
    single = F.when(none, "[Unnumbered page]").otherwise(F.concat(F.lit("Page "), show(number)))
    return F.concat(prefix, F.when(spread, pair).otherwise(single))


def structure_report(pages: DataFrame) -> DataFrame:
    """Per item and structure type: compact page ranges. ``pages``: item_id, number, number_type, page_types, spread."""
    both = F.when(F.col("spread"), F.array(F.col("number"), F.col("number") + 1)).otherwise(F.array("number"))
    flat = pages.where("number is not null").select("item_id", "number_type", F.explode(F.array_distinct(structure_types(F.col("page_types")))).alias("page_type"), both.alias("n")).select("item_id", "number_type", "page_type", F.explode("n").alias("n"))
    lists = flat.groupBy("item_id", "page_type").agg(F.collect_set(F.when(F.col("number_type") != "roman", F.col("n"))).alias("arabic"), F.collect_set(F.when(F.col("number_type") == "roman", F.col("n"))).alias("roman"))
    rank = F.array_position(F.array(*map(F.lit, STRUCTURE_TYPES)), F.col("page_type"))
    return lists.select("item_id", "page_type", rank.alias("place"), structure_range(F.col("arabic"), F.col("roman")).alias("pages"))


def label(page_type: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[page_type], F.initcap(F.replace(page_type, F.lit("_"), F.lit(" "))))


def markdown(titles: DataFrame, structure: DataFrame, pages: DataFrame, references: DataFrame) -> DataFrame:
    """(item_id, text): title, structure, page summaries, references. Lines are rows until the last aggregate.

    ``titles``: item_id, title, note; ``structure``: as of ``structure_report``; ``pages``: item_id, place, heading,
    bullets; ``references``: item_id, number, raw, range, link.
    """
    line = lambda df, section, place, sub, text: df.select("item_id", F.lit(section).alias("section"), place.cast("long").alias("place"), sub.cast("long").alias("sub"), text.alias("line"))
    zero = F.lit(0)
    head = titles.select("item_id", F.posexplode(F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit("*"), F.col("note"), F.lit("*")), F.lit(""))).alias("p", "t"))
    rows = [line(head, 0, F.col("p"), zero, F.col("t"))]
    for section, df, name in ((1, structure, "## Document Structure"), (3, pages, "## Page Summaries"), (5, references, "## Consolidated References")):
        start = df.select("item_id").distinct().select("item_id", F.posexplode(F.array(F.lit(name), F.lit(""))).alias("p", "t"))
        rows.append(line(start, section, F.col("p"), zero, F.col("t")))
    rows.append(line(structure, 2, F.col("place"), zero, F.concat(F.lit("- **"), label(F.col("page_type")), F.lit("**: "), F.col("pages"))))
    flat = pages.select("item_id", "place", F.posexplode(F.concat(F.array(F.concat(F.lit("### "), F.col("heading")), F.lit("")), F.transform("bullets", lambda b: F.concat(F.lit("- "), one_line(F.trim(b)))), F.array(F.lit("")))).alias("p", "t"))
    rows.append(line(flat, 4, F.col("place"), F.col("p"), F.col("t")))
    reference = F.concat(F.col("number").cast("string"), F.lit(". "), one_line(F.col("raw")), F.when(F.col("range") != "", F.concat(F.lit(" ("), F.col("range"), F.lit(")"))).otherwise(""), F.when(F.col("link").isNotNull(), F.concat(F.lit(" [link]("), F.col("link"), F.lit(")"))).otherwise(""))
    rows.append(line(references, 6, F.col("number"), zero, reference))
    out = rows[0]
    for df in rows[1:]:
        out = out.unionByName(df)
    ordered = F.array_sort(F.collect_list(F.struct("section", "place", "sub", "line")))
    return out.groupBy("item_id").agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias("text"))


def transcript(pages: DataFrame) -> DataFrame:
    """(item_id, text): a header with counts, then the pages' texts in order. ``pages``: item_id, idx, text, error."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text")))), lambda r: r["text"]), "\n")
    made = pages.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("ok"), body.alias("body"))
    header = F.concat(F.lit("# Transcription of: "), F.col("item_id"), F.lit("\n# Pages: "), F.col("n").cast("string"), F.lit(", ok: "), F.col("ok").cast("string"), F.lit(", failed: "), (F.col("n") - F.col("ok")).cast("string"), F.lit("\n\n"))
    return made.select("item_id", F.concat(header, "body", F.lit("\n")).alias("text"))
