import pytest
from pyspark.sql import functions as F

from folioscope.functions import config, markup
from folioscope.operators import layout, report, usage
from folioscope.sources import readers, writers


def test_math_segments(spark):
    assert markup.math_segments("a $x$ b $$y = \\$1$$ costs \\$5") == [("text", "a "), ("inline", "x"), ("text", " b "), ("display", "y = $1"), ("text", " costs $5")]
    assert markup.math_segments("") == [("text", "")] and markup.math_segments("no $ math") == [("text", "no $ math")]
    row = spark.createDataFrame([("*a* b",), (None,)], "t string").select(markup.segments("t", "emphasis").alias("s")).collect()
    assert [tuple(x) for x in row[0].s] == [("italic", "a"), ("text", " b")] and row[1].s is None


@pytest.mark.parametrize(
    ("code", "want"),
    [
        (r"a \land b", r"a \wedge b"),
        (r"\text{if} x", r"\mathrm{if}x"),
        (r"\Big( x \Big)", "( x )"),
        (r"\left( \frac{a}{b} \right)", r"( \frac{a}{b})"),
        (r"\left\{ x \right.", r"\{x"),
        (r"\overbrace{a+b}^{n} c", "a+bc"),
        (r"\begin{align*} a &= b \\ c \end{align*}", "a =b c"),
        (r"\sum\limits_{i} x", r"\sum_{i}x"),
        (r"a \quad b \, c", "a b c"),
        (r"\operatorname{rank} A", r"\mathrm{rank}A"),
    ],
)
def test_simplify(code, want):
    assert markup.simplify(code)[0] == want


def test_applied_rules(spark):
    row = spark.createDataFrame([(r"\lor \phantom{x}",)], "t string").select(markup.simplified("t").alias("s")).first().s
    assert row.text == r"\vee" and "\\lor" in row.applied and "phantom" in row.applied


def test_configuration(spark):
    assert config.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert config.without_unions({"type": ["null", "string"], "items": [{"type": ["null"]}]}) == {"type": "string", "items": [{"type": "string"}]}
    assert config.rate_limits([[10, 1], [0, 5], "x", [True, 2]]) == [(10, 1)] and config.rate_limits(None) == config.DEFAULT_LIMITS
    caps, pools = config.pool_tables(spark, {"enabled": {"x": 1}, "openai": {"large": "1_000", "small": {"cap": None, "models": [" GPT-mini ", 5]}}, "bad": 7})
    assert [tuple(r) for r in caps.collect()] == [("openai", "large", 1000)] and [tuple(r) for r in pools.collect()] == [("openai", "small", "gpt-mini")]


def test_page_information_for_rendering(spark):
    info = lambda j: spark.range(1).select(report.page_information(report.summary_payload(F.lit(j))).alias("p")).first().p
    assert tuple(info('{"page_information": {"page_number_integer": 4, "is_two_page_spread": true, "page_types": "index"}}')) == (4, "arabic", ["index"], True, 5)
    assert tuple(info('{"summary": {"page_information": {"page_number_type": "roman"}}}')) == (None, "none", ["content"], False, None)
    assert tuple(info('{"summary": {"page": 7}}')) == (7, "arabic", ["content"], False, None)
    schema = "i struct<page_number_integer:int,is_two_page_spread:boolean,page_number_integer_end:int,page_number_type:string,page_types:array<string>>"
    rows = spark.createDataFrame([(None,), ((None, None, None, None, None),), ((0, True, 3, None, ["index"]),)], schema)
    got = [tuple(r.f) for r in rows.select(report.filled_information(F.col("i"), F.lit(9)).alias("f")).collect()]
    assert got == [(9, False, None, "arabic", ["content"]), (9, False, None, "arabic", ["content"]), (0, True, 3, "none", ["index"])]


def test_line_predicates(spark):
    lines = ["# h", "<page_number>1</page_number>", "![x](y)", "[Image: x]", "| a |", "$$x$$", "prose", "", "[ok]"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = df.select(layout.structural_line(F.col("l")), layout.image_line(F.col("l")), layout.prose_line(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(layout.is_structural(x), layout.opens_image(x), layout.is_prose(x)) for x in lines]
    done = df.select(layout.repair_text("l").alias("r"))
    assert layout.repair_report(done).first().files == 9


def test_statistics_and_headers(spark):
    stats = usage.limiter_statistics(spark.createDataFrame([("k", "ok", 1.0), ("k", "limited", 3.0)], "key string, outcome string, wait double")).first()
    assert (stats.requests, stats.errors, stats.error_share, stats.mean_wait) == (2, 1, 0.5, 2.0)
    one = lambda c: tuple(spark.range(1).select(c.alias("s")).first().s)
    assert one(usage.usage_statistics(F.lit(60), F.lit(50), F.lit(True))) == (0, 120.0, True) and one(usage.usage_statistics(F.lit(60), F.lit(50), F.lit(False))) == (50, 0.0, False)
    items = spark.createDataFrame([("test", "/x.pdf", "PDF", 2, None)], "item_id string, path string, kind string, image_count int, model_name string")
    texts = writers.log_header(items, "transcription").select(F.col("item_id").alias("path"), "value")
    runs, entries = readers.parse_logs(readers.number_lines(texts))
    assert runs.first().total_images == 2 and entries.count() == 0
