"""Operator 1, URL filters [native]: host/path rules, carried to aliases over redirect and canonical-link edges.

A rule ``(action, host, path)`` fits its host and all subdomains when the url's path starts with the rule's path; the
longest rule wins (code points of host and path); of several as long an allowing one, then the greatest text. Urls are nodes; redirect and canonical links are
undirected edges. A url with a rule of its own keeps that rule's action. Any other url takes ``block`` when its connected
component holds a blocked url and no explicitly allowed one (explicit allow precedes), else ``allow``.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed. Null or empty html has no
edges. Repeated rows and urls each get a row. Extra columns are ignored unless named in ``keep``. Empty table: no rows.
Everything runs as DataFrame expressions; no Python code touches rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.storage import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed by the task: (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: More rules than this are joined as a table instead of being compiled into the expression.
MAX_INLINE_RULES = 200


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest_of(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """Identity of a url as a node: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(rest_of(url), "^[^/?#]*([^#]*)", 1), F.lit("")))


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """Those that win first; ``match_rules`` orders joined rules alike."""
    return sorted(sorted(rules, key=lambda r: r[1] + r[2], reverse=True), key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, action) of the longest fitting rule, null without one."""
    text = action = None
    for act, rule_host, rule_path in _ordered(rules):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = (F.when if text is None else text.when)(fits, F.lit(rule_host + rule_path))
        action = (F.when if action is None else action.when)(fits, F.lit(act))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, action)


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``action`` to a table with ``host`` and ``path``.

    A list of at most ``MAX_INLINE_RULES`` is compiled into one expression. A larger rule set (a list or a DataFrame of
    action, host, path) is joined on the host's suffixes, one row per label, so its size is not bounded.
    """
    if isinstance(rules, list) and len(rules) <= MAX_INLINE_RULES:
        text, action = rule_columns(F.col("host"), F.col("path"), rules)
        return urls.withColumns({"rule": text, "action": action})
    table = urls.sparkSession.createDataFrame(rules, "action string, host string, path string") if isinstance(rules, list) else rules
    table = table.select(F.col("action").alias("_a"), F.col("host").alias("_h"), F.col("path").alias("_p"))
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = urls.select("host", "path").distinct()
    found = distinct.withColumn("_h", F.explode(suffixes)).join(table, "_h").where(F.col("path").startswith(F.col("_p")))
    order = F.struct(F.length(F.concat("_h", "_p")), F.when(F.col("_a") == "allow", 1).otherwise(0), F.concat("_h", "_p"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_a").alias("action")), order).alias("_best"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "action": F.col("_best.action")}).drop("_best")


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute in double quotes, single quotes or bare."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2), F.regexp_extract(tag, pattern, 3))


def page_links(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of the canonical links and meta refreshes of each page; targets without a host are resolved against the page's host."""
    tags = F.expr(r"regexp_extract_all(html, '(?is)<(?:link|meta)\\s[^>]*>', 0)")
    wanted = F.filter(tags, lambda t: F.lower(t).contains("canonical") | F.lower(t).contains("refresh"))
    rows = pages.where(F.col("url").isNotNull() & (F.lower("html").contains("canonical") | F.lower("html").contains("refresh"))).select("url", F.explode(wanted).alias("tag"))
    canonical = F.when(F.lower(F.trim(_attribute(F.col("tag"), "rel"))).rlike(r"(^|\s)canonical($|\s)"), _attribute(F.col("tag"), "href"))
    refresh = F.when(F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))
    raw = F.trim(F.regexp_replace(F.coalesce(canonical, refresh), "&amp;", "&"))
    absolute = F.when(raw.contains("://"), raw).when(raw.startswith("//"), F.concat(F.lit("http:"), raw)).when(raw.startswith("/"), F.concat(F.lit("http://"), host_of(F.col("url")), raw))
    return rows.select("url", absolute.alias("target")).where(F.coalesce(F.length("target"), F.lit(0)) > 0)


def filter_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judges every row of ``pages`` (url, html and the ``keep`` columns).

    ``redirects`` is an optional table of further edges ``(url, target)``. Returns the ``keep`` columns, ``url``, ``host``,
    ``path``, ``rule``, ``verdict``. The edge table is far smaller than the pages; only it is iterated over.
    """
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    scratch = Scratch(spark, "urls")
    edges = scratch.table(links.select(key_of(F.col("url")).alias("a"), key_of(F.col("target")).alias("b"), F.col("url").alias("from_url"), F.col("target").alias("to_url")).distinct())
    judged = match_rules(pages.select(*keep, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    if edges.where("a != b").isEmpty():
        carried = None
    else:
        nodes = edges.select(F.col("a").alias("node"), F.col("from_url").alias("url")).unionByName(edges.select(F.col("b").alias("node"), F.col("to_url").alias("url")))
        decided = match_rules(nodes.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct(), rules)
        member = scratch.table(connected_components(spark, edges))
        verdict = member.join(decided.select("node", "action"), "node").groupBy("component").agg((F.bool_or(F.coalesce(F.col("action") == "block", F.lit(False))) & ~F.bool_or(F.coalesce(F.col("action") == "allow", F.lit(False)))).alias("alias_blocked"))
        carried = member.join(verdict.where("alias_blocked"), "component").select(F.col("node").alias("_key"), F.lit(True).alias("_blocked"))
    if carried is not None:
        judged = judged.withColumn("_key", key_of(F.col("url"))).join(carried, "_key", "left")
    else:
        judged = judged.withColumn("_blocked", F.lit(False))
    method = F.when(F.coalesce(F.col("_blocked"), F.lit(False)), "block").otherwise("allow")
    return judged.select(*keep, "url", "host", "path", "rule", F.coalesce("action", method).alias("verdict"))
