"""Queries on texts: cleaning, lines, markers, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import markup, responses, text
from folioscope.operators import layout, report
from folioscope.plans.catalog import query
from folioscope.plans.tables import table

_DIRTY = r"concat('\frac {a} \sum _{i} \(x\) ', replace(replace(text, ', ', '    '), '. ', ' ' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10)))"


def _dirty() -> F.Column:
    newlines = "\n" * 5
    return F.concat(F.lit(r"\frac {a} \sum _{i} \(x\) "), F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("    ")), F.lit(". "), F.lit(f" {newlines}")))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace({_DIRTY}, '\\frac\s*\{{', '\\frac{{', 'g'), '\\sum\s*_', '\\sum_', 'g'), '\(', '$'), '\)', '$'), '(?m) +$', '', 'g'), '([^\s]) {{3,}}', '\1  ', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')) AS digest FROM documents""")
def clean_by_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.limit_blank_lines(text.narrow_spaces(text.dollar_delimiters(text.close_up_commands(_dirty()))))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("digest"))


@query()
def merged_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.merge_hyphens(F.replace(F.col("text"), F.lit(", "), F.lit("-\n")))).alias("digest"))


@query()
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(_dirty()).alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query()
def layout_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.regexp_replace("text", r"(.{50,60}) ", "$1\n")
    return table(spark, sf_dir, "documents").select("doc_id", layout.repair_text(wrapped).alias("r")).select("doc_id", "r.joined", "r.merged", "r.kept", "r.ok", F.md5("r.text").alias("digest"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\n')) + 1 AS lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) = '')) AS blank, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS letters FROM documents""")
def line_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(body, "\n", -1)).cast("long").alias("lines"), text.blank_lines(body).cast("long").alias("blank"), text.letters_and_digits(body).cast("long").alias("letters"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"


@query(f"""WITH {_LINES}, b AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l),
g AS (SELECT doc_id, block, avg(length(rtrim(line))) AS mean, count(*) AS n FROM b WHERE trim(line) <> '' GROUP BY 1, 2), m AS (SELECT doc_id, avg(mean) AS mean FROM g WHERE n >= 3 GROUP BY 1)
SELECT DISTINCT l.doc_id, coalesce(greatest(20, cast(round_even(mean, 0) AS integer)), 80) AS width FROM l LEFT JOIN m USING (doc_id)""")
def wrap_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mean_block_width(layout.line_table(table(spark, sf_dir, "documents")))


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, list_sort(list(length(line))) AS s FROM l WHERE trim(line) <> '' GROUP BY doc_id), w AS (SELECT doc_id, s, s[cast(round_even(0.98 * (len(s) - 1), 0) AS integer) + 1] AS width FROM s)
SELECT doc_id, len(s) AS lines, width, len(list_filter(s, lambda x: x BETWEEN width - 6 AND width)) AS near FROM w""")
def region_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.region_widths(layout.line_table(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.col("lines").cast("long").alias("lines"), F.col("width").cast("long").alias("width"), F.col("near").cast("long").alias("near"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', chr(10) || chr(10) || chr(10) || chr(10)), chr(10)), 1) - 1 AS n FROM documents),
g AS (SELECT *, trim(line) = '' AS b, sum(CASE WHEN trim(line) = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g, b ORDER BY n) AS r FROM g)
SELECT doc_id, count(*) AS kept FROM r WHERE NOT b OR r <= 2 GROUP BY doc_id""")
def blank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit("\n\n\n\n")).alias("text"))
    return layout.limit_blank_runs(layout.line_table(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(r"""SELECT page_id, len(regexp_extract_all(replace(replace(html, '<h1>', '<page_number>'), '</h1>', '</page_number>'), '<page_number>(.*?)</page_number>', 1)) AS markers, (regexp_extract_all(html, '<title>(.*?)</title>', 1))[1] AS title FROM pages""")
def page_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.replace(F.col("html"), F.lit("<h1>"), F.lit("<page_number>")), F.lit("</h1>"), F.lit("</page_number>"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.page_markers(marked)).cast("long").alias("markers"), F.get(F.regexp_extract_all("html", F.lit("<title>(.*?)</title>"), 1), F.lit(0)).alias("title"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[page: Empty page ' || cast(n_chars AS varchar) || ']' ELSE text END AS t FROM documents) SELECT doc_id, length(trim(t)) > 0 AND length(trim(t)) < 200 AND regexp_matches(lower(t), 'no transcribable text|transcription not possible|empty page|no transcription possible') AS blank FROM t""")
def blank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("[page: Empty page "), F.col("n_chars").cast("string"), F.lit("]"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_blank_transcription(marked).alias("blank"))


@query("""SELECT event_id, k % 3 <> 0 AS valid, CASE WHEN k % 3 = 0 THEN '```' ELSE cast(k AS varchar) END AS answer FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS integer) AS k FROM events)""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    whole = F.to_json(F.struct(F.lit("x").alias("image_analysis"), F.col("k").cast("string").alias("transcription"), F.lit(False).alias("no_transcribable_text"), F.lit(False).alias("transcription_not_possible")))
    raw = F.when(F.col("k") % 3 == 0, "x```").otherwise(whole)
    return e.select("event_id", responses.is_valid(raw, responses.TRANSCRIPTION_KEYS).alias("valid"), F.replace(responses.transcription_text(F.concat(F.lit("```json\n"), raw, F.lit("\n```")), F.lit("p")), F.lit("x```"), F.lit("```")).alias("answer"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, NOT (l_returnflag = 'A' AND l_linestatus = 'F') AS shown FROM lineitem""")
def meaningful_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    blank = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")
    types = F.array(F.when(blank, "blank").otherwise("content"))
    shown = report.is_meaningful(types, F.array(F.lit("a point")), F.array().cast("array<string>"), F.lit(None).cast("string"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shown.alias("shown"))


@query("""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS t FROM documents), u AS (SELECT doc_id - 1 AS doc_id, t AS u FROM t)
SELECT doc_id, CASE WHEN len(t) > 0 AND len(u) > 0 THEN len(list_intersect(t, u)) / (len(t) + len(u) - len(list_intersect(t, u))) ELSE 0.0 END AS jaccard FROM t JOIN u USING (doc_id)""")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", text.token_set(F.lower("text")).alias("t"))
    return tokens.join(tokens.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u")), "doc_id").select("doc_id", text.jaccard(F.col("t"), F.col("u")).alias("jaccard"))


@query()
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").alias("place"), "l_partkey")
    titles = line.groupBy("item_id").agg(F.concat(F.lit("Order "), F.first("item_id")).alias("title"), F.concat(F.count(F.lit(1)).cast("string"), F.lit(" pages")).alias("note"))
    structure = line.select("item_id", F.lit("other").alias("page_type"), F.lit(1).alias("place"), F.lit("p. 1").alias("pages")).distinct()
    pages = line.dropDuplicates(["item_id", "place"]).select("item_id", "place", F.concat(F.lit("Page "), F.col("place").cast("string")).alias("heading"), F.array(F.lit("a point")).alias("bullets"))
    references = line.dropDuplicates(["item_id"]).select("item_id", F.lit(1).alias("number"), F.lit("Doe (2019)").alias("raw"), F.lit("p. 1").alias("range"), F.lit(None).cast("string").alias("link"))
    return report.markdown(titles, structure, pages, references).select("item_id", F.md5("text").alias("digest"))


@query()
def math_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", markup.segments(_dirty()).alias("s"))
    return found.select("doc_id", F.size("s").alias("segments"), F.size(F.filter("s", lambda x: x["kind"] != "text")).alias("math"))


@query()
def simplified_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit(r"\text{"), F.col("source"), F.lit(r"} \lor \left( x \right)"))
    return table(spark, sf_dir, "documents").select("doc_id", markup.simplified(code).alias("s")).select("doc_id", "s.text", F.size("s.applied").alias("rules"))


@query("""SELECT doc_id, count(*) FILTER (trim(line) <> '' AND NOT s) AS prose, count(*) FILTER (s) AS structural FROM (
  SELECT doc_id, line, starts_with(trim(line), '#') OR starts_with(trim(line), '<page') OR starts_with(trim(line), '[Page') OR starts_with(trim(line), '![') OR starts_with(trim(line), '$$') OR ends_with(trim(line), '$$')
    OR (starts_with(trim(line), '[') AND contains(line, 'Image:')) OR (starts_with(trim(line), '|') AND ends_with(trim(line), '|')) AS s FROM (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || '# '), chr(10))) AS line FROM documents)) GROUP BY doc_id""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.line_table(table(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit("\n# ")).alias("text")))
    return lines.groupBy("doc_id").agg(F.count_if(layout.prose_line(F.col("line"))).alias("prose"), F.count_if(layout.structural_line(F.col("line"))).alias("structural"))
