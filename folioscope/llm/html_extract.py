"""Operator 3, HTML extraction: minimum-cut labelling of a page's blocks into content and boilerplate.

The page is read once into blocks (text between block-level tags) with their open elements. A linear classifier turns a
block's features (enclosing elements, class words, link share, length, sentence marks) into a log-odds of being content;
the costs of either label become terminal capacities. Neighbouring blocks get smoothness edges, stronger between blocks
of one parent and the nearer they are in the tree. The minimum cut (by blocking flows) is the labelling; blocks on the
source side are the text, in page order, one line each. Blocks in elements that are never text (scripts, navigation,
forms, comments, hidden parts ...) are pinned to the sink.

Defined cases: null or empty html, or no content block, gives an empty text. Truncated pages and unclosed elements are read
to the end; an unclosed script, style, template, text field or frame hides the rest, other unclosed elements nothing. Repeated rows each get a row. Extra columns are ignored unless named in
``keep``. Empty table: no rows. Work on a page is linear in its length but for the flow, whose graph has two edges a block.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.storage import bound_batches

#: Fixed values of HTML: elements whose start or end ends a block, without content, with raw content.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video audio canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "svg", "template", "object", "canvas", "audio", "video")
#: Raw only up to their end tag; without one, the page goes on.
IF_CLOSED = frozenset("svg object canvas audio video".split())
#: Elements and roles that never hold the article's text, and words of class or id that name such parts.
NEVER = frozenset("nav footer aside form head title dialog menu button select option noscript iframe label search annotation annotation-xml".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets popup modal overlay login register search toolbar topbar header pagination pager masthead skip alert disclaimer copyright".split())
CONTENT_WORDS = frozenset("article content post entry story body text main maincontent prose paragraph".split())
#: Words of parts that stay boilerplate beside a content word (post-comments, content-sidebar), and of names that only tell
#: that a part is there or not (content no-sidebar).
ALWAYS_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr newsletter subscribe subscription signup sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies responses reviews share sharing social related recommended recommendations pagination pager toolbar topbar".split())
PRESENCE_WORDS = frozenset("no not with without has is".split())
#: An unclosed element of the left ends where one of the right starts.
CLOSES = {"p": BLOCK - {"html", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"]), "head": frozenset(["body"])}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\s(hidden)(?=[\s=/]|$)""", re.I | re.S)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKS = re.compile(r"[.!?:;](?:\s|$)|,")
PINNED = -1e6

#: Coefficients of the classifier, and of the smoothness edges between neighbours and between blocks of one parent.
WEIGHTS = {"bias": -1.2, "article": 4.5, "class": 2.0, "links": -5.0, "log_chars": 0.45, "marks": 1.5, "heading": 1.0, "header": -3.0, "list": -0.3, "paragraph": 0.8}
NEIGHBOUR, SIBLING = 0.6, 0.9


class Element:
    __slots__ = ("depth", "drop", "good", "header", "inside", "name", "parent")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.drop = bool(parent and parent.drop) or name in NEVER
        self.good = bool(parent and parent.good)
        inside = bool(parent and parent.inside)
        self.inside = inside or name in ("article", "main")
        self.header = bool(parent and parent.header) or name == "header"
        if name == "header" and not inside:
            self.drop = True
        if attributes and "=" in attributes or " hidden" in attributes.lower():
            for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
                value, key = a or b or c, key.lower()
                if hidden or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value) or key == "role" and value.lower() in NEVER_ROLES:
                    self.drop = True
                elif key in ("class", "id", "itemprop") and name not in ("html", "body"):
                    for token in value.split():
                        words = {w.lower() for w in _WORD.findall(token)} | {token.lower()}
                        content = bool(words & CONTENT_WORDS)
                        if name not in ("article", "main") and not words & PRESENCE_WORDS:
                            self.drop = self.drop or bool(words & ALWAYS_WORDS) or bool(words & NEVER_WORDS) and not content
                        self.good = self.good or content
                elif key == "role" and value.lower() in ("main", "article"):
                    self.good = True


class Block:
    __slots__ = ("chars", "element", "linked", "parts")

    def __init__(self, element: Element):
        self.element, self.parts, self.chars, self.linked = element, [], 0, 0


def _end_tag(name: str, page: str, at: int, unclosed: set[str]) -> re.Match | None:
    """The next end tag of the name; a name that has none left is looked for once."""
    found = None if name in unclosed else re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
    if found is None:
        unclosed.add(name)
    return found


def read_blocks(page: str) -> list[tuple[str, Block]]:
    """(text, block) of every block with text, in page order."""
    root = top = Element("#page", None, "")
    out: list[tuple[str, Block]] = []
    block, at, links = Block(top), 0, 0
    unclosed: set[str] = set()

    def add(raw: str) -> None:
        if raw:
            block.parts.append(raw)
            size = len(raw)
            block.chars += size
            if links:
                block.linked += size

    def close() -> None:
        nonlocal block
        if block.chars:
            text = " ".join(html.unescape("".join(block.parts)).split())
            if text:
                out.append((text, block))
        block = Block(top)

    size = len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if name == "br":
                add(" ")
                continue
            inner = top
            while inner is not root and inner.name != name:
                # an end tag of an inline element doesn't reach over blocks
                if name not in BLOCK and inner.name in BLOCK:
                    inner = root
                    break
                inner = inner.parent
            if inner is not root:
                before = top
                while before is not inner.parent:
                    links -= before.name == "a"
                    before = before.parent
                if name in BLOCK:
                    top = inner.parent
                    close()
                else:
                    top = inner.parent
                    if block.chars == 0:
                        block.element = top
            elif name in BLOCK:
                close()
            continue
        attributes = found[3] or found[6] or ""
        if name in RAW and not attributes.endswith("/"):
            end = _end_tag(name, page, at, unclosed)
            if end is None and name in IF_CLOSED:
                continue
            at = end.end() if end else size
            if name in BLOCK:
                close()
            else:
                add(" " if name not in ("script", "style", "template") else "")
            continue
        if name in VOID:
            if name == "hr":
                close()
            else:
                add(" " if name in ("br", "img", "input") else "")
            continue
        if name in BLOCK:
            inner = top
            while inner is not root:
                if inner.name in CLOSES and name in CLOSES[inner.name]:
                    before = top
                    while before is not inner.parent:
                        links -= before.name == "a"
                        before = before.parent
                    top = inner.parent
                    break
                if inner.name in BLOCK:
                    break
                inner = inner.parent
        top = Element(name, top, attributes)
        links += name == "a"
        if name in BLOCK:
            close()
        if top.drop and name not in BLOCK:
            # a dropped inline element hides its own text only
            end = _end_tag(name, page, at, unclosed)
            if end:
                at = end.end()
                links -= name == "a"
                top = top.parent
    close()
    return out


def log_odds(text: str, block: Block) -> float:
    """Of being content, by the classifier."""
    element = block.element
    if element.drop:
        return PINNED
    w = WEIGHTS
    z = w["bias"] + w["log_chars"] * math.log1p(len(text)) + w["links"] * block.linked / max(block.chars, 1)
    z += w["marks"] * min(1.0, 12.0 * len(_MARKS.findall(text)) / max(len(text), 12))
    if element.inside:
        z += w["article"]
    if element.good:
        z += w["class"]
    if element.header:
        z += w["header"]
    nearest = element
    while nearest is not None and nearest.name not in BLOCK:
        nearest = nearest.parent
    kind = nearest.name if nearest is not None else ""
    z += w["heading"] if kind in ("h1", "h2", "h3", "h4", "h5", "h6") else w["list"] if kind == "li" else w["paragraph"] if kind in ("p", "pre", "blockquote") else 0.0
    return z


def _parent_block(element: Element) -> Element:
    while element.parent is not None and element.name not in BLOCK:
        element = element.parent
    return element.parent or element


def _proximity(a: Element, b: Element) -> float:
    """Share of the deeper path that both have in common."""
    deepest = max(a.depth, b.depth, 1)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        if a is None or b is None:
            return 0.0
    return a.depth / deepest


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page, and between successive blocks of one parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        parent = _parent_block(block.element)
        weight = NEIGHBOUR * _proximity(block.element, blocks[i - 1].element) if i else 0.0
        j = last.get(id(parent))
        if j is not None:
            if j == i - 1:
                weight += SIBLING
            else:
                edges.append((j, i, SIBLING))
        if weight:
            edges.append((i - 1, i, weight))
        last[id(parent)] = i
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut with fewest nodes there, by blocking flows."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flow straight through
        if source[i] > both:
            link(s, i, source[i] - both, 0.0)
        if sink[i] > both:
            link(i, t, sink[i] - both, 0.0)
    for a, b, weight in edges:
        link(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        next_edge = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                for k, e in enumerate(path):
                    if room[e] <= tiny:
                        a = to[e ^ 1]
                        del path[k:]
                        break
                continue
            while next_edge[a] < len(graph[a]):
                e = graph[a][next_edge[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                next_edge[a] += 1
            if next_edge[a] < len(graph[a]):
                path.append(graph[a][next_edge[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                next_edge[a] += 1
            else:
                break


def extract_text(page: str | None) -> str:
    found = read_blocks(page or "")
    if not found:
        return ""
    odds = [log_odds(text, block) for text, block in found]
    if any(z > 0 for z in odds):
        cost = [math.log1p(math.exp(-abs(z))) if abs(z) < 30 else 0.0 for z in odds]
        content = [max(z, 0.0) + c for z, c in zip(odds, cost, strict=True)]
        boilerplate = [max(-z, 0.0) + c for z, c in zip(odds, cost, strict=True)]
        sides = minimum_cut(content, boilerplate, smoothness([b for _, b in found]))
    else:
        sides = [False] * len(found)
    return "\n".join(text for (text, _), side in zip(found, sides, strict=True) if side)


def _extract(keep: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract_text(h) for h in batch["html"]]
            yield batch[list(keep)].assign(text=pd.Series(texts, index=batch.index, dtype=object), n_chars=[len(t) for t in texts])

    return run


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points) of every row."""
    bound_batches(pages.sparkSession)
    kinds = [(f.name, f.dataType.simpleString()) for f in pages.select(*keep).schema.fields]
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds) + ", text string, n_chars long"
    return pages.select(*keep, F.col("html")).mapInPandas(_extract(keep), schema)
