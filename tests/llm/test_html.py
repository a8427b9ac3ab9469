import time

from folioscope.llm import html_extract as h
from tests.llm.cases import prose

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
{}<aside><p>{}</p></aside><footer>&copy; x</footer></body></html>"""
STORY = "<h1>A &amp; B</h1><p>First  one,<br>goes\n on. It is a sentence, with marks.</p><p>Second <b>bold</b> one &lt;ok&gt;. It goes on for a while, too.</p><ul><li>item one of the list</li></ul>"
WANT = "A & B\nFirst one, goes on. It is a sentence, with marks.\nSecond bold one <ok>. It goes on for a while, too.\nitem one of the list"


def test_article_without_boilerplate():
    page = PAGE.format(f"<article>{STORY}<div class='comments'><p>{prose(1)}</p></div><form><p>Name</p></form></article>", prose(2))
    assert h.extract_text(page) == WANT


def test_content_without_article_element():
    assert h.extract_text(PAGE.format(f"<div class='post-body'>{STORY}</div>", prose(2))) == WANT
    paragraphs = "".join(f"<p>{prose(k, 40)}. It is so, and more.</p>" for k in range(4))
    found = h.extract_text(PAGE.format(f"<div>{paragraphs}</div>", "side"))
    assert found.count("\n") == 3 and "cookies" not in found


def test_broken_pages():
    assert h.extract_text("<article><p>One text.<p>Two <b>text.<br><p>Three") == "One text.\nTwo text.\nThree"
    assert h.extract_text("<article><p>One.</p><script>x = '<p>no</p>'") == "One."
    assert h.extract_text("<article><p>A < B &amp C &#x41;<!-- no --></p><p hidden>no</p><p style='display:none'>no</p>") == "A < B & C A"
    assert h.extract_text(None) == h.extract_text("") == h.extract_text("<html></html>") == ""


def test_long_page_is_whole():
    page = "<article>" + "".join(f"<p>paragraph {k} has some words, and ends here.</p>" for k in range(3000)) + "</article>"
    assert h.extract_text(page).count("\n") == 2999


def brute_cut(source, sink, edges):
    best = None
    for mask in range(1 << len(source)):
        side = [bool(mask >> i & 1) for i in range(len(source))]
        cost = sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])
        if best is None or cost < best[0] - 1e-9:
            best = (cost, side)
    return best


def test_minimum_cut_matches_brute_force():
    import random

    for seed in range(40):
        r = random.Random(seed)
        n = r.randrange(1, 9)
        source, sink = [[r.random() * 3 for _ in range(n)] for _ in range(2)]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        side = h.minimum_cut(source, sink, edges)
        cost = sum(sink[i] if s else source[i] for i, s in enumerate(side)) + sum(w for a, b, w in edges if side[a] != side[b])
        assert abs(cost - brute_cut(source, sink, edges)[0]) < 1e-6


def test_rows_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hi there.</p></article>", "z"), (None, None, None, "z"), (1, "u", "", "z")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in h.extract_pages(pages).collect()) == [(0, "", 0), (1, "", 0), (1, "Hi there.", 9)]
    assert h.extract_pages(pages.limit(0)).count() == 0


def test_boilerplate_beside_content_words():
    names = "post-comments article-comments content-sidebar main-menu main-nav entry-footer article-related post-share text-ad reviews reader-responses comment-body".split()
    for name in names:
        part = f"<div class='{name}'><p>Some other sentence, that isn't of the story. It goes on.</p></div>"
        assert h.extract_text(PAGE.format(f"<article>{STORY}{part}</article>", "side")) == WANT, name
        assert h.extract_text(PAGE.format(f"<article>{STORY}</article>{part}", "side")) == WANT, name
    for name in ("content no-sidebar", "post-content has-comments", "article-header"):
        assert h.extract_text(PAGE.format(f"<article><div class='{name}'>{STORY}</div></article>", "side")) == WANT, name


def test_unclosed_media_and_formulas_keep_the_text():
    for name in ("video", "object", "canvas", "svg", "audio", "math"):
        assert h.extract_text(f"<article><p>One sentence, here.</p><div><{name}></div><p>Two sentences, here.</p></article>") == "One sentence, here.\nTwo sentences, here.", name
    assert h.extract_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds, it is said.</p></article>") == "So x=1 holds, it is said."


def test_deep_pages_take_linear_time():
    start = time.process_time()
    assert h.extract_text("<article>" + "<div>" * 60_000 + "<p>The one sentence, far below.</p>") == "The one sentence, far below."
    assert time.process_time() - start < 20
