import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import components, quality_rules, storage, url_filter
from tests.llm.cases import documents, no_documents, prose


def test_components_match_union_find(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r[0]: r[1] for r in components.connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_components_of_nothing(spark):
    assert components.connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_host_path_and_rules(spark):
    urls = ["HTTP://Example.COM/en/x?q#f", "http://www.example.com/en/a", "https://a.b.net/es/", "no scheme", None, "x://net", "ftp://badnet/es/", "http://shop.com?x", "http://a.com/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id int, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark, pages, url_filter.RULES).collect()}
    assert got[0] == ("example.com", "/en/x", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[2] == ("a.b.net", "/es/", "net/es/", "block")
    assert got[3] == got[4] == ("", "", None, "allow")
    assert got[5] == ("net", "", None, "allow") and got[6] == ("badnet", "/es/", None, "allow")
    assert got[7] == ("shop.com", "", None, "allow") and got[8] == ("a.com", "/", "com/", "allow")


def test_blocks_reach_aliases_and_allow_precedes(spark):
    link = '<LINK href="{}" rel=canonical>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://a.net/es/1", link.format("http://m.org/1")),
        (2, "http://m.org/1", refresh.format("http://m.org/2")),
        (3, "https://m.org/2#frag", None),
        (4, "http://b.net/fr/1", link.format("http://n.org/1")),
        (5, "http://ok.com/", link.format("http://n.org/1")),
        (6, "http://n.org/1", None),
        (7, "http://b.net/fr/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(spark, pages, url_filter.RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block"}


def test_many_rules_join_like_few(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.x{i % 3}.com/p{i % 5}/z", None) for i in range(60)], "page_id int, url string, html string")
    rules = [("block", f"x{i}.com", "/p1/") for i in range(2)] + [("allow", "h1.x1.com", "/p1/"), ("block", "com", "/")]
    show = lambda r: sorted((x.page_id, x.rule, x.verdict) for x in url_filter.filter_urls(spark, pages, r).collect())
    assert show(rules) == show(spark.createDataFrame(rules, "action string, host string, path string"))


def test_counts_match_brute_force(spark):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    extra = spark.createDataFrame([(90, "a|b\n\na|b\n x \n# x"), (91, " ".join("abcdefghij") + "\n" + " ".join("abcdefghij"))], "doc_id long, text string")
    docs = documents(spark).select("doc_id", "text").unionByName(extra)
    for r in quality_rules.text_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id


def test_rules_keep_ordinary_and_reject_odd(spark):
    rows = [(i, prose(i, 60), "en", "s") for i in range(80)]
    rows += [(1000, " ".join(["ab|cd##$$"] * 3 + [f"a{k}&&&&&&%%%%" for k in range(60)]), "en", "s"), (1001, "too short", "en", "s"), (1002, "a b c d e f g h " * 20, "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge_quality(spark, docs).collect()}
    assert all(got[i] == (False, True) for i in range(80))
    assert got[1000] == (False, False) and got[1001] == got[1002] == (True, False)


def test_rules_on_messy_and_empty_tables(spark):
    out = quality_rules.judge_quality(spark, documents(spark))
    assert out.count() == documents(spark).count() and out.where("kept is null").count() == 0
    assert quality_rules.judge_quality(spark, no_documents(spark)).count() == 0
    assert out.where(F.col("doc_id") == 4).first().base_failed


def test_rules_judge_small_groups_by_language_and_then_all(spark):
    odd = lambda i: " ".join(["ab|cd##$$"] * 3 + [f"a{k}&&&&&&%%%%" for k in range(60)])
    rows = [(i, prose(i, 60), "en", f"s{i % 8}") for i in range(80)] + [(100 + i, prose(100 + i, 60), "fr", "s") for i in range(5)]
    rows += [(1000, odd(0), "en", "s3"), (1001, odd(1), "fr", "s"), (1002, odd(2), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge_quality(spark, docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {1000, 1001, 1002}


def test_rules_reject_short_repeated_lines_alone(spark):
    r = random.Random(1)
    menu = [f"w{i}x{i}" for i in range(8)]
    rows = [(i, prose(i, 60), "en", "s") for i in range(80)] + [(1000, "\n".join(r.choice(menu) for _ in range(200)), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge_quality(spark, docs).collect()}
    assert got.pop(1000) == (False, False) and set(got.values()) == {(False, True)}


ODD = {
    "f_word": lambda t: t.replace("w", "wwwwwwwwwwww"),
    "f_upper": str.upper,
    "f_symbol": lambda t: t.replace(" w", " #w"),
    "f_line": lambda t: t + "\nso\n" + "and so on\n" * 9,
    "f_mark": lambda t: t.replace(" w", ", w"),
}


def test_each_statistic_can_reach_the_cutoff(spark):
    assert set(ODD) == set(quality_rules.NAMES)
    rows = [(i, plain(i), "en", "s") for i in range(200)] + [(1000 + k, change(plain(1000 + k)), "en", "s") for k, change in enumerate(ODD.values())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge_quality(spark, docs).collect()}
    assert {name: got.pop(1000 + k) for k, name in enumerate(ODD)} == dict.fromkeys(ODD, (False, False))
    assert set(got.values()) == {(False, True)}


def plain(seed, words=150):
    r = random.Random(seed)
    out = []
    for k in range(words):
        word = f"w{r.randrange(10 ** r.randint(1, 6))}"
        out.append((word.capitalize() if r.random() < 0.1 else word) + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.08 else ""))
    return " ".join(out)


def brute_mcd(x, starts=200, seed=0):
    """Squared distances by the subset of least determinant over many random starts, each concentrated to the end."""
    rng, h, floor = np.random.default_rng(seed), int(np.ceil(quality_rules.SUPPORT * len(x))), np.diag([f**2 for f in quality_rules.FLOORS.values()])
    best = None
    for _ in range(starts):
        own = x[rng.choice(len(x), x.shape[1] + 1, replace=False)]
        before = None
        while True:
            scatter = quality_rules.CONSISTENCY * np.cov(own.T, bias=True) + floor
            z = x - own.mean(axis=0)
            d2 = np.einsum("ij,jk,ik->i", z, np.linalg.inv(scatter), z)
            inner = np.sort(np.argsort(d2, kind="stable")[:h])
            if before is not None and (inner == before).all():
                break
            before, own = inner, x[inner]
        size = np.linalg.slogdet(scatter)[1]
        if best is None or size < best[0]:
            best = (size, d2)
    return best


def test_estimate_matches_brute_force_and_decides(spark):
    rows = [(i, plain(i), "en", "s") for i in range(300)] + [(1000 + k, ODD["f_mark"](ODD["f_upper"](plain(k))), "en", "s") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality_rules._statistics(quality_rules.text_counts(docs))
    table = {r.doc_id: [r[a] for a in quality_rules.NAMES] for r in counted.collect()}
    ids = sorted(table)
    x = np.array([table[i] for i in ids])
    _, want = brute_mcd(x)
    got = {r.doc_id: r for r in quality_rules.judge_quality(spark, docs).collect()}
    d2 = np.array([got[i].distance for i in ids])
    assert [got[i].kept for i in ids] == (want <= quality_rules.CUTOFF).tolist()
    clean = np.array(ids) < 1000
    assert 0.7 < np.median(d2[clean] / want[clean]) < 1.4 and 3 < np.median(d2[clean]) < 6
    floors = np.array([quality_rules.FLOORS[a] for a in quality_rules.NAMES])
    alone = (((x - np.median(x, axis=0)) / floors) ** 2).sum(axis=1)  # the floors without the estimate
    assert ((alone <= quality_rules.CUTOFF) != (d2 <= quality_rules.CUTOFF)).sum() > 30


def test_groups_on_either_side_of_the_least_size(spark):
    n = quality_rules.MIN_GROUP
    rows = [(1000 * g + i, plain(1000 * g + i), "en", f"s{g}") for g, size in enumerate([n - 2, n - 1, n]) for i in range(size)]
    rows += [(9000 + g, ODD["f_upper"](plain(9000 + g)), "en", f"s{g}") for g in (0, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge_quality(spark, docs).collect()}
    assert len(got) == len(rows) and all(r.distance is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {9000, 9001, 9002}


def test_longest_rule_wins_alike_among_few_and_many(spark):
    pages = spark.createDataFrame([(1, "http://x.a.com/bcd", None), (2, "http://x.b.com/q", None)], "page_id int, url string, html string")
    rules = [("block", "a.com", "/bcd"), ("allow", "x.a.com", "/b"), ("block", "b.com", "/q"), ("block", "x.b.com", "/")]
    show = lambda r: sorted((x.page_id, x.rule, x.verdict) for x in url_filter.filter_urls(spark, pages, r).collect())
    few = show(rules)
    assert few == show(rules + [("block", f"none{i}.org", "/") for i in range(250)]) == [(1, "x.a.com/b", "allow"), (2, "x.b.com/", "block")]


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(Session())
