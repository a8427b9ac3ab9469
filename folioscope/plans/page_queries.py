"""Queries on pages: ranges, numbering, structure, resume, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.numbers import guarded_share, natural_key, page_range, ranges, render_zoom, scale_to_pixels, scale_to_side, sequence_number, short_name, to_roman
from folioscope.operators import layout, numbering, report, resume
from folioscope.plans.catalog import query
from folioscope.plans.tables import PAGES_SQL, numbered_pages, table
from folioscope.sources import readers

_ISLANDS = """WITH d AS (SELECT DISTINCT {key}, {value} AS x FROM {table}), r AS (SELECT {key}, x, x - row_number() OVER (PARTITION BY {key} ORDER BY x) AS run FROM d),
i AS (SELECT {key}, run, min(x) AS a, max(x) AS b FROM r GROUP BY {key}, run)
SELECT {key}, CASE WHEN sum(b - a + 1) = 1 THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN a = b THEN cast(a AS varchar) ELSE cast(a AS varchar) || '-' || cast(b AS varchar) END, ', ' ORDER BY a) AS pages FROM i GROUP BY {key}"""


@query(_ISLANDS.format(key="conv_id, role", value="turn", table="conversations"))
def structure_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.collect_set(F.col("turn").cast("int")).alias("n"))
    return turns.select("conv_id", "role", page_range(F.col("n"), F.lit(False)).alias("pages"))


@query("""WITH d AS (SELECT DISTINCT quality, doc_id FROM labels), r AS (SELECT quality, doc_id, doc_id - row_number() OVER (PARTITION BY quality ORDER BY doc_id) AS run FROM d)
SELECT quality, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n FROM r GROUP BY quality, run""")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("quality", "doc_id").distinct()
    run = F.col("doc_id") - F.row_number().over(Window.partitionBy("quality").orderBy("doc_id"))
    return rows.withColumn("run", run).groupBy("quality", "run").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")).drop("run")


@query(f"WITH {PAGES_SQL} SELECT item_id, idx, span, cast(vpos AS bigint) AS vpos FROM positioned")
def virtual_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.virtual_positions(numbered_pages(spark, sf_dir)).select("item_id", "idx", "span", F.col("vpos").cast("long").alias("vpos"))


@query(f"WITH {PAGES_SQL} SELECT item_id, section, length, start, number, cast(vpos AS bigint) AS vpos FROM page_runs")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = numbering.runs(numbering.virtual_positions(numbered_pages(spark, sf_dir)))
    return runs.select("item_id", "section", "length", "start", "number", F.col("vpos").cast("long").alias("vpos"))


@query(f"WITH {PAGES_SQL} SELECT item_id, section, anchor_number, cast(anchor_vpos AS bigint) AS anchor_vpos FROM page_anchors")
def section_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = numbering.anchors(numbering.virtual_positions(numbered_pages(spark, sf_dir)))
    return found.select("item_id", "section", "anchor_number", F.col("anchor_vpos").cast("long").alias("anchor_vpos"))


@query(f"WITH {PAGES_SQL} SELECT item_id, idx, inferred, CASE WHEN inferred THEN guess ELSE number END AS number FROM filled")
def gap_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.infer_gaps(numbering.virtual_positions(numbered_pages(spark, sf_dir))).select("item_id", "idx", "inferred", "number")


@query(f"""WITH {PAGES_SQL}, f AS (SELECT item_id, section, idx, spread, vpos, CASE WHEN inferred THEN guess ELSE number END AS number, CASE WHEN inferred THEN bt ELSE number_type END AS number_type FROM filled
), m AS (SELECT f.*, anchor_number, anchor_vpos, anchor_number + vpos - anchor_vpos AS moved FROM f LEFT JOIN page_anchors USING (item_id, section)
), n AS (SELECT *, cast(CASE WHEN number IS NULL THEN NULL WHEN anchor_number IS NULL THEN CASE WHEN number >= 1 THEN number ELSE vpos + 1 END WHEN moved >= 1 THEN moved END AS bigint) AS final_number FROM m
), o AS (SELECT *, median(idx) OVER (PARTITION BY item_id, section) AS md, min(idx) OVER (PARTITION BY item_id, section) AS mi FROM n)
SELECT item_id, idx, final_number, CASE WHEN final_number IS NULL THEN 'none' WHEN number_type = 'none' THEN 'arabic' ELSE number_type END AS final_type, CASE WHEN spread THEN final_number + 1 END AS final_end,
  row_number() OVER (PARTITION BY item_id ORDER BY md, mi, idx) AS place FROM o""")
def page_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.adjust(numbered_pages(spark, sf_dir)).select("item_id", "idx", "final_number", "final_type", "final_end", F.col("place").cast("long").alias("place"))


@query("""SELECT p_partkey, CASE p_size WHEN 0 THEN '' ELSE
  repeat('x', p_size // 10 % 10 * CASE WHEN p_size // 10 % 10 < 4 THEN 1 ELSE 0 END) || CASE p_size // 10 % 10 WHEN 4 THEN 'xl' WHEN 5 THEN 'l' ELSE '' END ||
  (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[p_size % 10 + 1] END  AS roman FROM part""")
def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", to_roman(F.col("p_size")).alias("roman"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_returnflag = 'A' THEN '[Preface] ' WHEN l_returnflag = 'R' THEN '[Appendix] ' ELSE '' END AS prefix, l_linestatus = 'F' AS spread, l_suppkey % 5 = 0 AS none FROM lineitem)
SELECT heading, count(*) AS n FROM (SELECT prefix || CASE WHEN spread AND none THEN '[Unnumbered spread]' WHEN spread THEN 'Pages ' || l_linenumber || '-' || (l_linenumber + 1) WHEN none THEN '[Unnumbered page]' ELSE 'Page ' || l_linenumber END AS heading FROM h) GROUP BY heading""")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    types = F.array(F.when(F.col("l_returnflag") == "A", "preface").when(F.col("l_returnflag") == "R", "appendix").otherwise("content"))
    kind = F.when(F.col("l_suppkey") % 5 == 0, "none").otherwise("arabic")
    return line.select(report.heading(F.col("l_linenumber"), kind, types, F.col("l_linestatus") == "F", F.lit(None).cast("int")).alias("heading")).groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'preface' WHEN 'R' THEN 'appendix' ELSE 'bibliography' END AS page_type, unnest(CASE WHEN l_quantity < 3 THEN [l_linenumber, l_linenumber + 1] ELSE [l_linenumber] END) AS n FROM lineitem),
d AS (SELECT DISTINCT * FROM f), r AS (SELECT l_orderkey, page_type, n, n - row_number() OVER (PARTITION BY l_orderkey, page_type ORDER BY n) AS run FROM d),
i AS (SELECT l_orderkey, page_type, min(n) AS a, max(n) AS b FROM r GROUP BY l_orderkey, page_type, run)
SELECT cast(l_orderkey AS varchar) AS item_id, page_type, CASE WHEN sum(b - a + 1) = 1 THEN 'p. ' ELSE 'pp. ' END || string_agg(CASE WHEN a = b THEN cast(a AS varchar) ELSE a || '-' || b END, ', ' ORDER BY a) AS pages FROM i GROUP BY 1, 2""")
def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    kind = F.when(F.col("l_returnflag") == "A", "preface").when(F.col("l_returnflag") == "R", "appendix").otherwise("bibliography")
    pages = line.select(F.col("l_orderkey").cast("string").alias("item_id"), F.col("l_linenumber").alias("number"), F.lit("arabic").alias("number_type"), F.array(kind).alias("page_types"), (F.col("l_quantity") < 3).alias("spread"))
    return report.structure_report(pages).select("item_id", "page_type", "pages")


_ITEMS = "items AS (SELECT DISTINCT cast(l_orderkey AS varchar) AS item_id, cast(max(l_linenumber) AS integer) AS image_count FROM lineitem GROUP BY l_orderkey)"
_LOG = "log AS (SELECT cast(l_orderkey AS varchar) AS item_id, l_linenumber - 1 AS idx, l_suppkey % 23 = 0 AS has_error FROM lineitem)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("item_id")).agg(F.max("l_linenumber").cast("int").alias("image_count"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").cast("string").alias("item_id"), (F.col("l_linenumber") - 1).alias("idx"), (F.col("l_suppkey") % 23 == 0).alias("has_error"))


@query(f"""WITH {_ITEMS}, {_LOG}, done AS (SELECT DISTINCT item_id, idx FROM log WHERE NOT has_error)
SELECT item_id, cast(idx AS integer) AS idx FROM (SELECT item_id, unnest(range(image_count)) AS idx FROM items) p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.item_id = p.item_id AND d.idx = p.idx)""")
def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.pending_pages(_items(spark, sf_dir), resume.completed_pages(_log(spark, sf_dir)))


@query(f"""WITH {_ITEMS}, {_LOG}, done AS (SELECT DISTINCT item_id, idx FROM log WHERE NOT has_error)
SELECT l.item_id, count(*) AS n FROM log l JOIN items i USING (item_id) WHERE EXISTS (SELECT 1 FROM done d WHERE d.item_id = l.item_id AND d.idx = l.idx) AND l.idx >= 0 AND l.idx < i.image_count GROUP BY l.item_id""")
def eligible_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return resume.eligible(log, resume.completed_pages(log), _items(spark, sf_dir)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_ITEMS}, {_LOG}, outputs AS (SELECT item_id, kind, size FROM (SELECT cast(o_orderkey AS varchar) AS item_id, 'txt' AS kind, o_orderkey % 3 AS size FROM orders UNION ALL SELECT cast(o_orderkey AS varchar), 'md', o_orderkey % 4 FROM orders)),
l AS (SELECT item_id, count(*) AS entries, count(*) FILTER (has_error) AS errors, count(DISTINCT idx) FILTER (NOT has_error) AS done FROM log GROUP BY item_id),
o AS (SELECT item_id, bool_or(kind = 'txt') AS txt, bool_or(kind = 'md') AS md FROM outputs WHERE size > 0 GROUP BY item_id),
j AS (SELECT i.item_id, image_count, coalesce(entries, 0) AS entries, coalesce(errors, 0) AS errors, coalesce(done, 0) AS done, coalesce(txt, false) AS txt, coalesce(md, false) AS md FROM items i LEFT JOIN l USING (item_id) LEFT JOIN o USING (item_id))
SELECT item_id, image_count, entries, errors, done, CASE WHEN txt AND md AND entries >= image_count AND errors = 0 THEN 'complete' WHEN txt THEN 'transcription_only' WHEN done > 0 THEN 'partial' ELSE 'none' END AS state FROM j""")
def resume_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), "o_orderkey")
    outputs = orders.select("item_id", F.lit("txt").alias("kind"), (F.col("o_orderkey") % 3).alias("size")).unionByName(orders.select("item_id", F.lit("md").alias("kind"), (F.col("o_orderkey") % 4).alias("size")))
    return resume.item_states(_items(spark, sf_dir), _log(spark, sf_dir), outputs)


@query("""WITH p AS (SELECT o_custkey AS k, o_orderkey AS ord, o_totalprice AS summary, CASE WHEN o_orderstatus = 'P' THEN 'failed' END AS error FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord DESC) AS r FROM p)
SELECT cast(c_custkey AS varchar) AS item_id, n.summary AS reused, n.summary IS NULL AS regenerate FROM customer LEFT JOIN n ON n.k = c_custkey AND n.r = 1 AND n.error IS NULL""")
def reuse_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.lit(0).alias("idx"))
    prior = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), F.lit(0).alias("idx"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("summary"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error"))
    return resume.reuse(pages, prior).select("item_id", "reused", "regenerate")


@query("""SELECT cast(o_custkey AS varchar) AS item_id, count(*) FILTER (o_orderstatus <> 'F' AND NOT o_orderkey % 9 = 0) AS ok, count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderkey % 9 = 0) AS deferred, count(*) FILTER (o_orderkey % 9 = 0) = 0 AS writable FROM orders GROUP BY o_custkey""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"), (F.col("o_orderkey") % 9 == 0).alias("deferred"), F.lit(1.0).alias("seconds"))
    return resume.run_report(pages).drop("mean_seconds")


@query("""WITH p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS seq, l_quantity AS seconds FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey ORDER BY seq) AS done, sum(seconds) OVER (PARTITION BY l_orderkey ORDER BY seq) AS total_s, avg(seconds) OVER (PARTITION BY l_orderkey ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM p)
SELECT cast(l_orderkey AS varchar) AS item_id, seq, done, CASE WHEN done > 5 THEN cast(floor((40 - done) / (0.7 * done / total_s + 0.3 / recent) * 1000 + 0.5) AS bigint) END AS eta_ms FROM w""")
def moving_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("item_id"), F.row_number().over(order).cast("long").alias("seq"), F.col("l_quantity").alias("seconds"), F.lit(40).alias("total"))
    return resume.moving_rate(pages).select("item_id", "seq", "done", F.floor(F.col("eta") * 1000 + 0.5).alias("eta_ms"))


@query("""WITH f AS (SELECT '/scan/' || n_name || CASE WHEN p_partkey % 3 = 0 THEN '/inner' ELSE '' END AS dir, 'page_' || p_partkey || CASE WHEN p_partkey % 10 = 0 THEN '.pdf' ELSE '.jpg' END AS name, p_partkey % 10 = 0 AS pdf, p_size AS length FROM part JOIN nation ON p_partkey % 25 = n_nationkey),
g AS (SELECT dir, count(*) AS image_count, sum(length) AS size FROM f WHERE NOT pdf GROUP BY dir)
SELECT 'images' AS kind, dir AS path, image_count, cast(size AS bigint) AS size FROM g WHERE NOT EXISTS (SELECT 1 FROM g a WHERE starts_with(g.dir, a.dir || '/')) UNION ALL SELECT 'pdf', dir || '/' || name, NULL, length FROM f WHERE pdf""")
def item_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("p_partkey")
    folder = F.concat(F.lit("/scan/"), F.col("n_name"), F.when(key % 3 == 0, "/inner").otherwise(""))
    path = F.concat(folder, F.lit("/page_"), key.cast("string"), F.when(key % 10 == 0, ".pdf").otherwise(".jpg"))
    files = part.join(nation, key % 25 == F.col("n_nationkey")).select(path.alias("path"), F.col("p_size").cast("long").alias("length"))
    return readers.discover_items(readers.describe_files(files)).select("kind", "path", "image_count", "size")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE p_size END AS sequence_number, left('Item ' || p_name || ' ' || repeat('x', 90), 66) || '-' || left(sha256('Item ' || p_name || ' ' || repeat('x', 90)), 8) || '_txt' AS short_name FROM part""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    stem = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("page_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("p7-scan"), F.col("p_size").cast("string"), F.lit("b")))
    name = F.concat(F.lit("Item "), F.col("p_name"), F.lit(" "), F.repeat(F.lit("x"), 90))
    return part.select("p_partkey", sequence_number(stem).cast("long").alias("sequence_number"), short_name(name, "_txt", 79).alias("short_name"))


@query("""WITH n AS (SELECT s_suppkey, 'p' || s_suppkey || '.JPG' AS name FROM supplier) SELECT name, row_number() OVER (ORDER BY s_suppkey) AS place FROM n""")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.lit("all").alias("dir"), F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit(".JPG")).alias("name"))
    return names.select("name", F.row_number().over(Window.partitionBy("dir").orderBy(natural_key(F.col("name")))).cast("long").alias("place"))


@query("""SELECT dir, stem, n FROM (SELECT o_orderpriority AS dir, o_custkey % 100 AS stem, count(*) AS n FROM orders GROUP BY 1, 2) WHERE n > 1""")
def duplicate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dir"), (F.col("o_custkey") % 100).alias("stem"), F.col("o_orderkey").alias("item_id"))
    return resume.duplicate_targets(items).select("dir", "stem", "n")


@query("""SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) WHERE r IN (1, 3, 4, 5, 9))""")
def item_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resume.select_items(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "1, 3-5; 9, x", "s_name", "s_suppkey").select("s_suppkey")


@query("""WITH i AS (SELECT c_custkey, c_mktsegment FROM customer), f AS (SELECT o_custkey AS k, max(CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END) AS context FROM orders GROUP BY 1), d AS (SELECT 'BUILDING' AS dir, ' houses ' AS context)
SELECT c_custkey, coalesce(nullif(trim(f.context), ''), nullif(trim(d.context), ''), 'general') AS context FROM i LEFT JOIN f ON k = c_custkey LEFT JOIN d ON dir = c_mktsegment""")
def context_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("dir"))
    by_file = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(F.max(F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus"))).alias("context"))
    by_folder = spark.createDataFrame([("BUILDING", " houses ")], "dir string, context string")
    return readers.resolve_context(items, by_file, by_folder, "general").select(F.col("item_id").alias("c_custkey"), "context")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, cast(floor(1e6 * least(1.0, 768.0 / greatest(l_partkey + 1, l_suppkey + 1))) AS bigint) AS side_ppm, cast(floor(1e6 * least(least(1.0, 768.0 / greatest(l_partkey + 1, l_suppkey + 1)), least(1.0, sqrt(10000.0 / ((l_partkey + 1) * (l_suppkey + 1)))))) AS bigint) AS both_ppm FROM lineitem""")
def image_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    w, h = F.col("l_partkey") + 1, F.col("l_suppkey") + 1
    ppm = lambda c: F.floor(F.lit(1e6) * c)
    return line.select("l_orderkey", "l_linenumber", "l_partkey", ppm(scale_to_side(w, h, F.lit(768.0))).alias("side_ppm"), ppm(scale_to_pixels(w, h, F.lit(10000.0), F.lit(768.0))).alias("both_ppm"))


@query("""SELECT o_custkey, coalesce(100.0 * count(*) FILTER (o_orderstatus = 'O') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 0.0) AS share FROM orders GROUP BY o_custkey""")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(guarded_share(F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") != "P")).alias("share"))


@query("""SELECT unnest(string_split(text, chr(10))) AS line FROM documents EXCEPT ALL SELECT unnest(string_split(text, chr(10))) FROM benchmark""")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lambda name: table(spark, sf_dir, name).select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return layout.lost_rows(lines("documents"), lines("benchmark"))


@query()
def page_ranges_and_zoom(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupBy("p_brand").agg(F.array_join(ranges(F.collect_set("p_size")), ", ").alias("sizes"), F.max(render_zoom(F.lit(300.0), F.col("p_size") * 20.0, F.lit(800.0), F.lit(4e6))).alias("zoom"))
