import pytest
from pyspark.sql import functions as F

from folioscope.functions import numbers
from folioscope.operators import layout, numbering, report, resume
from folioscope.sources import readers, writers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def pages(spark, rows):
    return spark.createDataFrame([("d", i, n, k, s, False) for i, (n, k, s) in enumerate(rows)], "item_id string, idx int, number int, number_type string, section string, spread boolean")


A, R = "arabic", "roman"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(1, A, "content"), (2, A, "content"), (3, A, "content"), (4, A, "content")], [1, 2, 3, 4]),
        ([(5, A, "content"), (1, A, "content"), (2, A, "content"), (3, A, "content"), (4, A, "content"), (10, A, "content")], [None, 1, 2, 3, 4, 5]),
        ([(10, R, "preface"), (11, R, "preface"), (12, R, "preface"), (1, A, "content"), (2, A, "content"), (3, A, "content")], [10, 11, 12, 1, 2, 3]),
        ([(None, "none", "figures"), (1, A, "content"), (2, A, "content")], [None, 1, 2]),
        ([(1, A, "content"), (None, "none", "content"), (3, A, "content")], [1, 2, 3]),
        ([(1, A, "content"), (None, "none", "content"), (4, A, "content")], [1, None, 3]),
        ([(1, A, "content"), (None, "none", "content"), (3, R, "content")], [1, None, 3]),
    ],
)
def test_numbering(spark, rows, want):
    got = numbering.adjust(pages(spark, rows)).orderBy("idx").collect()
    assert [r.final_number for r in got] == want
    assert all((r.final_type == "none") == (r.final_number is None) for r in got)


def test_claimed_number_is_not_inferred(spark):
    rows = [(1, A, "content"), (None, "none", "content"), (3, A, "content"), (2, A, "content")]
    assert not any(r.inferred for r in numbering.infer_gaps(numbering.virtual_positions(pages(spark, rows))).collect())


def test_spreads_advance_by_two(spark):
    df = pages(spark, [(1, A, "content"), (2, A, "content"), (4, A, "content")]).withColumn("spread", F.col("idx") == 1)
    assert [(r.final_number, r.final_end) for r in numbering.adjust(df).orderBy("idx").collect()] == [(1, None), (2, 3), (4, None)]


def test_page_information(spark):
    schema = "item_id string, idx int, page_information struct<page_number_integer:int,is_two_page_spread:boolean,page_number_integer_end:int,page_number_type:string,page_types:array<string>>"
    df = spark.createDataFrame([("a", 0, (5, None, None, None, None)), ("a", 1, (5, True, None, "roman", ["preface", "abstract"]))], schema)
    assert [tuple(r) for r in numbering.parse_page_information(df).collect()] == [("a", 0, None, "none", ["content"], False, "content"), ("a", 1, 5, "roman", ["preface", "abstract"], True, "preface")]


@pytest.mark.parametrize(("given", "odd", "want"), [([1, 2, 3, 5, 7, 8, 9], False, "pp. 1-3, 5, 7-9"), ([5], False, "p. 5"), ([], True, "unnumbered"), ([5], True, "pp. 5, unnumbered"), ([], False, "")])
def test_page_range(spark, given, odd, want):
    assert one(spark, numbers.page_range(F.array(*map(F.lit, given)).cast("array<int>"), F.lit(odd))) == want


def test_numerals_and_names(spark):
    df = spark.range(0, 4000).select("id", numbers.to_roman(F.col("id")).alias("r")).withColumn("back", numbers.from_roman(F.col("r")))
    assert all((r.back or 0) == r.id for r in df.collect())
    assert one(spark, numbers.structure_range(F.array(*map(F.lit, [100, 101])), F.array(*map(F.lit, [3, 4, 12])))) == "pp. iii-iv, xii, 100-101"
    assert [one(spark, numbers.sequence_number(F.lit(x))) for x in ("page_0001", "p7-scan12b", "none")] == [1, 12, 0]
    assert one(spark, numbers.natural_key(F.lit("p10"))) > one(spark, numbers.natural_key(F.lit("P2")))
    assert len(one(spark, numbers.short_name(F.lit("x" * 200), "_a"))) == 80
    assert one(spark, numbers.cut_at_word(F.lit("aa bb cc"), 5)) == "aa..." and one(spark, numbers.cut_at_word(F.lit("aa"), 5)) == "aa"


@pytest.mark.parametrize(("number", "kind", "types", "want"), [(5, A, ["content"], "Page 5"), (3, R, ["content"], "Page iii"), (None, "none", ["content"], "[Unnumbered page]"), (1, R, ["preface"], "[Preface] Page i"), (100, A, ["appendix"], "[Appendix] Page 100")])
def test_headings(spark, number, kind, types, want):
    column = report.heading(F.lit(number).cast("int"), F.lit(kind), F.array(*map(F.lit, types)), F.lit(False), F.lit(None).cast("int"))
    assert one(spark, column) == want


def test_references_and_meaning(spark):
    got = one(spark, report.normalize_references(F.lit('["A text", {"citation": " B ", "is_partial": true}, {"citation": ""}, " "]')))
    assert [tuple(r) for r in got] == [("A text", False), ("B", True)]
    none = F.array().cast("array<string>")
    show = lambda types, bullets, error=None: one(spark, report.is_meaningful(F.array(*map(F.lit, types)), F.array(*map(F.lit, bullets)) if bullets else none, none, F.lit(error).cast("string")))
    assert show(["content"], ["a"]) and show(["index"], []) and show(["blank"], [], "failed") and show(["content"], ["[Transcription failed: x]"])
    assert not show(["blank"], []) and not show(["content"], []) and not show(["content"], ["[empty page]"])


def test_markdown_and_transcript(spark):
    text = lambda df: df.first().text
    titles = spark.createDataFrame([("d", "T", "n")], "item_id string, title string, note string")
    structure = spark.createDataFrame([("d", "index", 9, "p. 9")], "item_id string, page_type string, place int, pages string")
    body = spark.createDataFrame([("d", 1, "Page 1", ["b\n c"])], "item_id string, place int, heading string, bullets array<string>")
    refs = spark.createDataFrame([("d", 1, "Doe", "p. 1", "http://x")], "item_id string, number int, raw string, range string, link string")
    assert text(report.markdown(titles, structure, body, refs)).split("\n") == ["# T", "", "*n*", "", "## Document Structure", "", "- **Index**: p. 9", "## Page Summaries", "", "### Page 1", "", "- b c", "", "## Consolidated References", "", "1. Doe (p. 1) [link](http://x)"]
    made = report.transcript(spark.createDataFrame([("d", 1, "two", None), ("d", 0, "one", "e")], "item_id string, idx int, text string, error string"))
    assert text(made) == "# Transcription of: d\n# Pages: 2, ok: 1, failed: 1\n\none\ntwo\n"


HEADER = '{"_format_version":2,"log_type":"transcription","input_item_name":"test","input_item_path":"/fake/test.pdf","input_type":"PDF","total_images":3}'


def test_logs_and_states(spark):
    page = lambda i, more="": f'{{"original_input_order_index":{i},"transcription":"t{i}"{more}}}'
    logs = {"ok": [HEADER, page(0), page(1), page(2)], "cut": [HEADER, page(0), "", page(1)[:-5]], "err": [HEADER, page(0, ',"error":null'), "[1]"], "old": [HEADER.replace(":2,", ":1,"), page(0)], "none": []}
    texts = spark.createDataFrame([(k, "\n".join(v)) for k, v in logs.items()], "path string, value string")
    runs, entries = readers.parse_logs(readers.number_lines(texts))
    assert {r.path for r in runs.collect()} == {"ok", "cut", "err"} and all(r.total_images == 3 for r in runs.collect())
    assert sorted((r.path, r.idx, r.has_error) for r in entries.collect()) == [("cut", 0, False), ("err", 0, True), ("ok", 0, False), ("ok", 1, False), ("ok", 2, False)]
    items = spark.createDataFrame([(k, 3) for k in logs], "item_id string, image_count int")
    log = entries.select(F.col("path").alias("item_id"), "idx", "has_error")
    outputs = spark.createDataFrame([("ok", "txt", 5), ("ok", "md", 5), ("err", "txt", 5), ("none", "txt", 0)], "item_id string, kind string, size long")
    assert {r.item_id: r.state for r in resume.item_states(items, log, outputs).collect()} == {"ok": "complete", "cut": "partial", "err": "transcription_only", "old": "none", "none": "none"}
    assert resume.pending_pages(items, resume.completed_pages(log)).count() == 0 + 2 + 3 + 3 + 3


def test_reuse_and_guards(spark):
    todo = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2)], "item_id string, idx int")
    prior = spark.createDataFrame([("a", 0, 1, "old", None), ("a", 0, 2, "new", None), ("a", 1, 1, "x", None), ("a", 1, 2, "y", "failed")], "item_id string, idx int, ord int, summary string, error string")
    assert [(r.idx, r.reused, r.regenerate) for r in resume.reuse(todo, prior).orderBy("idx").collect()] == [(0, "new", False), (1, None, True), (2, None, True)]
    n = F.lit(None).cast("long")
    assert not one(spark, resume.input_changed(n, F.lit(1), F.lit(2), n)) and one(spark, resume.input_changed(F.lit(1), F.lit(2), n, n))
    items = spark.createDataFrame([(str(k), f"dir/Item {k}") for k in range(1, 8)], "item_id string, label string")
    assert [r.item_id for r in resume.select_items(items, "2, 4-5;x").collect()] == ["2", "4", "5"] and [r.item_id for r in resume.select_items(items, "item 3").collect()] == ["3"]


def test_discovery_and_files(spark, tmp_path):
    for name in ("a.PDF", "img/p10.jpg", "img/p2.jpg", "img/deep/x.png", "solo/y.webp", "solo/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = readers.file_table(spark, str(tmp_path))
    assert sorted((r.kind, r.item_id, r.image_count) for r in readers.discover_items(files).collect()) == [("images", "img", 2), ("images", "solo", 1), ("pdf", "a", None)]
    listed = readers.folder_listing(files).where("dir like '%/img'").orderBy("idx").collect()
    assert [(r.name, r.sequence_number) for r in listed] == [("p2.jpg", 2), ("p10.jpg", 10)]
    texts = spark.createDataFrame([("a/x.txt", "# Transcription of: x\r\ny"), ("my backup/x.txt", "# Transcription of: x"), ("b", "other")], "path string, value string")
    assert [(r.text, r.had_crlf) for r in readers.transcripts(texts).collect()] == [("# Transcription of: x\ny", True)]


def test_sinks(spark, tmp_path):
    texts = spark.createDataFrame([("a", "one\ntwo"), ("b", "x")], "item_id string, text string")
    writers.write_texts(texts, f"{tmp_path}/t")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t", wholetext=True).collect()) == ["one\ntwo\n", "x\n"]
    for n in (3, 2):
        writers.replace_table(spark.range(n), f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2
    assert writers.read_state(spark, f"{tmp_path}/missing") == {}
    summary = writers.run_summary(spark.createDataFrame([("a", "complete", 5), ("b", "failed", None)], "item_id string, state string, tokens long")).first()[0]
    assert summary == '{"items_total":2,"items_complete":1,"items_failed":1,"items_skipped":0,"tokens":5}'


def test_layout_repair(spark):
    full = "this line of the page is filled up close to its widest"
    wrapped = f"<page_number>1</page_number>\n{full} near the\nwidth here.\n" + "\n".join(f"{full} number {k}" for k in range(4))
    done = "\n".join(layout.repair(wrapped).lines)
    assert layout.gate(wrapped, done)
    for raw, want in [("the concep-\ntion of value here\n", "conception"), ("the co-\nordinate system used\n", "co-ordinate")]:
        row = spark.createDataFrame([(raw,)], "t string").select(layout.repair_text("t").alias("r")).first().r
        assert want in row.text and row.ok
    assert not layout.gate("one two", "one too") and layout.gate("a-\nb", "ab")
    row = spark.createDataFrame([("a-b\r\nconcep-\r\ntion",), (None,)], "t string").select(layout.repair_text("t").alias("r")).collect()
    assert row[0].r.text == "a-b\r\nconception" and row[1].r.text is None


def test_wrapped_remainder_is_joined():
    line = "w" * 20 + " " + "x" * 20 + " " + "y" * 18
    lines = ["<page_number>1</page_number>", line, "tail", line, "tail", line, "tail", line, "tail", line]
    joined, applied = layout.rejoin(lines)
    assert applied and joined == ["<page_number>1</page_number>", *[f"{line} tail"] * 4, line]
