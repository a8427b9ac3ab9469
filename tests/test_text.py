import pytest
from pyspark.sql import functions as F

from folioscope.functions import responses, text


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Café", "Café"), ("test­word", "testword"), ("test​word", "testword"), ("test⁠word", "testword"), ("test\x00\x01\x02word", "testword"), ("item\U00010101text", "item•text"), ("a\r\nb\tc", "a\nb\tc"), ("x", "x")],
)
def test_unicode(raw, want):
    assert text.normalize_unicode(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Line 1 $a=b$\nLine 2 $c=d$", "Line 1 $a=b$\nLine 2 $c=d$"),
        (r"\frac {a}{b}", r"\frac{a}{b}"),
        (r"\sum _{i=1}", r"\sum_{i=1}"),
        (r"\(x\) and \[y\]", "$x$ and $$y$$"),
        ("costs $5 today", "costs $5 today"),
        ("costs 5$ today", "costs 5$ today"),
        ("so $x = y.", "so $x = y$."),
        ("orphan $", "orphan "),
        ("*A*<sub>m</sub> and x<sup>2</sup>", "$A_{m}$ and $x^{2}$"),
        ("word<sub>m</sub>", "word<sub>m</sub>"),
        (r"$$\left( x$$", r"$$\left( x\right.$$"),
        ("} tail", " tail"),
    ],
)
def test_math(raw, want):
    assert text.fix_math(raw) == want


def test_braces_balance():
    fixed = text.close_braces(r"\frac{a}{b + \sqrt{c")
    assert fixed.count("{") == fixed.count("}")


@pytest.mark.parametrize(("raw", "want"), [("demon-\nstration", "demonstration"), ("concep-\ntion", "conception"), ("Manage-\nment", "Management"), ("Jean-\nBaptiste", "Jean-\nBaptiste"), ("co-\nordinating", "co-\nordinating"), ("self-\nevident", "self-\nevident"), ("a-\ntest", "a-\ntest"), ("conép-\ntion", "conéption"), ("KNOWL-\nEDGE", "KNOWLEDGE"), ("NON-\nLINEAR", "NONLINEAR"), ("éco-\nordinate", "éco-\nordinate"), ("aéco-\nop", "aéco-\nop"), ("xxco-\nop", "xxcoop"), ("abc-\ndefg-\nhij", "abcdefg-\nhij"), ("non-\nlinear-\nfoo", "non-\nlinear-\nfoo"), ("abCDE-\nFGH", "abCDE-\nFGH")])
def test_hyphens(spark, raw, want):
    assert text.merge_hyphenation(raw) == want
    assert spark.createDataFrame([(raw,)], "t string").select(text.merge_hyphens(F.col("t"))).first()[0] == want


def test_leading_braces_and_sides():
    assert text.close_braces("  }x") == "  x" and text.close_braces("}}{a}") == "{a}" and text.close_braces(r"\\{a") == r"\\{a}"
    assert text.balance_sides(r"$$ \left( x $$") == r"$$ \left( x \right.$$" and text.balance_sides(r"$$ x \right) $$") == r"$$\left. x \right) $$"
    assert text.balance_sides(r"$$\left(\end{a}b\end{c}$$") == r"$$\left(\right.\end{a}b\end{c}$$"


def test_keep_policy(spark):
    pairs = [("KNOWL", "EDGE", False), ("page", "42", True), ("self", "evident", True), ("demon", "stration", False), ("Jean", "Baptiste", True)]
    df = spark.createDataFrame(pairs, "l string, r string, k boolean")
    assert all(r.k == r.got for r in df.withColumn("got", text.keeps_hyphen(F.col("l"), F.col("r"))).collect())
    assert all(text.keep_hyphen(a, b) == k for a, b, k in pairs)


def test_whitespace():
    assert text.normalize_whitespace("line1\n\n\n\n\n\nline2") == "line1\n\n\nline2\n"
    assert text.normalize_whitespace("a    b  ") == "a  b\n" and text.normalize_whitespace("a\tb") == "a  b\n"
    assert text.normalize_whitespace("a\n\u00a0\nb") == "a\n\nb\n"
    assert text.auto_width("aaaa\nbbbb\ncccc") == 20 and text.auto_width("x") == 80
    assert text.wrap_lines("aa bb cc dd", 5) == "aa bb\ncc dd" and text.wrap_lines("# aa bb cc", 5) == "# aa bb cc"


def test_clean_text_column(spark):
    df = spark.createDataFrame([("demon-\nstration  \n\n\n\n\nCafé $x = y.",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.clean_text("t")).collect()]
    assert got == ["demonstration\n\n\nCafé $x = y$.\n", "", None]


def test_small_expressions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    s = F.lit
    assert one(text.is_blank_transcription(s("[p1: no transcribable text - x]"))) and not one(text.is_blank_transcription(s("empty page " + "x" * 300)))
    assert not one(text.is_blank_transcription(s(None).cast("string")))
    assert one(text.strip_fence(s("```json\n{}\n```"))) == "{}" and one(text.strip_fence(s(" x "))) == "x"
    assert one(text.strip_emphasis(s("**a** *b* c"))) == "a b c" and one(text.one_line(s("a \n b"))) == "a b"
    assert one(text.legal_xml(s("a\x0bb\tc"))) == "ab\tc" and one(text.context_line(s(" a \n\n b "))) == "a, b"
    assert one(text.page_markers(s("<page_number>3</page_number> x <page_number>iv</page_number>"))) == ["3", "iv"]


def test_answers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    whole = '{"image_analysis": "dark page", "transcription": "hi", "no_transcribable_text": false, "transcription_not_possible": false}'
    assert one(responses.is_valid(F.lit(whole), responses.TRANSCRIPTION_KEYS)) and one(responses.missing_keys(F.lit('{"transcription": 1}'), responses.TRANSCRIPTION_KEYS)) == ["image_analysis", "no_transcribable_text", "transcription_not_possible"]
    assert not one(responses.is_valid(F.lit("nonsense"), responses.SUMMARY_KEYS))
    assert one(responses.transcription_text(F.lit(f"```json\n{whole}\n```"), F.lit("p"))) == "hi"
    assert one(responses.transcription_text(F.lit(whole.replace('text": false', 'text": true')), F.lit(""))) == "[unknown_image: no transcribable text — dark page]"
    assert one(responses.transcription_text(F.lit("{broken " + whole), F.lit("p"), salvage=True)) == "hi"
    assert one(responses.transcription_text(F.lit(""), F.lit("p"))) == "[transcription error: p]"
    assert one(responses.output_text(F.lit('{"output": [{"content": [{"text": "t"}]}]}'))) == "t"
    assert one(responses.prompt_with_context(F.lit("a\nuse {{CONTEXT}} now\nb"), F.lit(None).cast("string"))) == "a\nb"
