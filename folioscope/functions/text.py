"""Text cleaning: Column builders where regular expressions suffice, one Arrow UDF for the ordered rest."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters to delete, icon glyphs read as bullets, commands closed up to what follows, kept prefixes,
#: markers of blank pages, longest marker.
DROPPED = "­​‌‍﻿⁠"
ICONS = "\U00010101\U00010102\U00010103\U00010104\U00010105"
BRACED_COMMANDS = ["frac", "sqrt", "mathrm", "mathbf", "mathit", "text"]
SCRIPTED_COMMANDS = ["sum", "int", "prod", "lim"]
KEPT_PREFIXES = ["co", "self", "non", "anti", "pseudo", "quasi", "semi", "multi", "cross", "well", "ill", "half", "vice", "all", "neo"]
BLANK_MARKERS = ["no transcribable text", "transcription not possible", "empty page", "no transcription possible"]
BLANK_LENGTH = 200


@dataclass(frozen=True)
class CleaningConfig:
    """Switches of the cleaning steps, in their order."""

    enabled: bool = True
    unicode: bool = True
    math: bool = True
    hyphens: bool = True
    whitespace: bool = True
    wrap: bool = False
    collapse_spaces: bool = True
    max_blank_lines: int = 2
    tab: int = 4
    width: int | None = None


# Column builders


def close_up_commands(text: Column) -> Column:
    r"""``\frac {`` becomes ``\frac{``, ``\sum _`` becomes ``\sum_``."""
    for name in BRACED_COMMANDS:
        text = F.regexp_replace(text, rf"\\{name}\s*\{{", rf"\\{name}{{")
    for name in SCRIPTED_COMMANDS:
        text = F.regexp_replace(text, rf"\\{name}\s*_", rf"\\{name}_")
    return text


def dollar_delimiters(text: Column) -> Column:
    r"""``\( \)`` to ``$``, ``\[ \]`` to ``$$``."""
    for mark, dollars in (("\\(", "$"), ("\\)", "$"), ("\\[", "$$"), ("\\]", "$$")):
        text = F.replace(text, F.lit(mark), F.lit(dollars))
    return text


def narrow_spaces(text: Column) -> Column:
    """Trailing spaces of lines off; runs of three or more inner spaces to two."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m) +$", ""), r"(\S) {3,}(?=\S)", "$1  ")


def limit_blank_lines(text: Column, most: int = 2) -> Column:
    return F.regexp_replace(text, r"\n(?:[^\S\n]*\n){" + str(most + 1) + r",}", "\n" * (most + 1))


def is_blank_transcription(text: Column) -> Column:
    """A short text that holds one of the blank-page markers."""
    bare = F.trim(text)
    return F.coalesce((F.length(bare) > 0) & (F.length(bare) < BLANK_LENGTH) & F.lower(bare).rlike("|".join(BLANK_MARKERS)), F.lit(False))


def strip_fence(text: Column) -> Column:
    """Content of a fenced code block; other texts trimmed."""
    bare = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[A-Za-z0-9_-]*[ \t]*\n?", ""), r"\n?```$", "")
    return F.when(bare.startswith("```"), F.trim(inner)).otherwise(bare)


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*([^*]+)\*\*|\*([^*]+)\*", "$1$2")


def one_line(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*\n\s*", " ")


def legal_xml(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def page_markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("<page_number>(.*?)</page_number>"), 1)


def letters_and_digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) == ""))


def token_set(text: Column) -> Column:
    """Distinct runs of a-z and 0-9 of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("([a-z0-9]{2,})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def contained(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def context_line(text: Column) -> Column:
    """Non-empty trimmed lines joined by a comma."""
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), ", ")


def keeps_hyphen(left: Column, right: Column) -> Column:
    """Whether a hyphen between two fragments at a line break is part of the word."""
    last, first = F.substring(left, -1, 1), F.substring(right, 1, 1)
    letters = last.rlike(r"\p{L}") & first.rlike(r"\p{L}")
    lower = last.rlike(r"\p{Ll}") & first.rlike(r"\p{Ll}")
    capitals = (left == F.upper(left)) & (right == F.upper(right)) & left.rlike(r"\p{Lu}") & right.rlike(r"\p{Lu}")
    prefix = F.lower(F.regexp_extract(left, "([A-Za-z]+)$", 1)).isin(KEPT_PREFIXES)
    return ~letters | F.when(lower, prefix).otherwise(~capitals)


def merge_hyphens(text: Column) -> Column:
    """Joins words that a line break hyphenated, unless the hyphen is the word's own.

    One pattern takes every hyphenated break from left to right, as a joined pair of lower case (no kept prefix as the last
    ASCII word of the left), a joined pair of capitals, or a pair that stays.
    """
    kept = "|".join(KEPT_PREFIXES)
    lower = rf"(\w{{2,}}\p{{Ll}})(?<!(?<![A-Za-z])(?i:{kept}))-\n(\p{{Ll}}\w+)"
    upper = r"([\w&&[^\p{Ll}\p{Lt}]]{2,}\p{Lu})-\n(\p{Lu}[\w&&[^\p{Ll}\p{Lt}]]+)(?!\w)"
    return F.regexp_replace(text, rf"(?U){lower}|{upper}|(\w{{3,}}-\n\w{{2,}})", "$1$2$3$4$5")


# The ordered rest, in Python


def normalize_unicode(text: str) -> str:
    composed = unicodedata.normalize("NFC", text)
    table = {}
    for c in set(composed):
        if c in ICONS:
            table[ord(c)] = "•"
        elif c in DROPPED or c not in "\t\n" and unicodedata.category(c)[0] == "C":
            table[ord(c)] = None
    return composed.translate(table) if table else composed


_SPAN = re.compile(r"(\$\$.*?\$\$|\$.*?\$)", re.S)
_SCRIPT = re.compile(r"(?<![A-Za-z0-9])\*?([A-Za-z0-9]{1,3})\*?<(sub|sup)>([A-Za-z0-9]{1,3})</\2>")
_SIDES = re.compile(r"\\(left|right)(?![a-zA-Z])")


def scripts_to_math(text: str) -> str:
    """HTML sub- and superscripts outside math become inline math."""
    parts = _SPAN.split(text)
    mark = {"sub": "_", "sup": "^"}
    return "".join(p if i % 2 else _SCRIPT.sub(lambda m: f"${m[1]}{mark[m[2]]}{{{m[3]}}}$", p) for i, p in enumerate(parts))


def balance_sides(text: str) -> str:
    r"""Each display block gets as many ``\left`` as ``\right``, with invisible delimiters inside its environment."""

    def fix(block: re.Match) -> str:
        body = block[1]
        sides = [m[1] for m in _SIDES.finditer(body)]
        lack = sides.count("left") - sides.count("right")
        if not lack:
            return block[0]
        if lack > 0:
            closing = re.search(r"\\end\{[^}]*\}", body)
            at = closing.start() if closing else len(body)
            body = body[:at] + r"\right." * lack + body[at:]
        else:
            opening = re.search(r"\\begin\{[^}]*\}", body)
            at = opening.end() if opening else 0
            body = body[:at] + r"\left." * -lack + body[at:]
        return f"$${body}$$"

    return re.sub(r"\$\$(.*?)\$\$", fix, text, flags=re.S)


def balance_dollars(line: str) -> str:
    """A lone dollar that isn't a price closes before the line's last punctuation, or goes if nothing follows it."""
    places = [m.start() for m in re.finditer(r"(?<!\\)\$", line)]
    if len(places) != 1:
        return line
    i = places[0]
    before, after = line[:i], line[i + 1 :]
    if before[-1:].isdigit() or after.lstrip()[:1].isdigit():
        return line
    body = after.rstrip(".,;:!? \t")
    return f"{before}${body}${after[len(body) :]}" if body.strip() else before + after


def close_braces(line: str) -> str:
    depth = orphans = 0
    escaped = False
    for c in line:
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = True
        elif c == "{":
            depth += 1
        elif c == "}":
            orphans, depth = (orphans + 1, depth) if not depth else (orphans, depth - 1)
    if orphans:
        indent, leading = re.match(r"(\s*)(}*)", line).groups()
        line = indent + line[len(indent) + min(orphans, len(leading)) :]
    return line.rstrip() + "}" * depth if depth else line


def fix_math(text: str) -> str:
    for mark, dollars in (("\\(", "$"), ("\\)", "$"), ("\\[", "$$"), ("\\]", "$$")):
        text = text.replace(mark, dollars)
    text = scripts_to_math(text)
    text = re.sub(r"(\\(?:" + "|".join(BRACED_COMMANDS) + r"))\s*\{", r"\1{", text)
    text = re.sub(r"(\\(?:" + "|".join(SCRIPTED_COMMANDS) + r"))\s*_", r"\1_", text)
    text = balance_sides(text)
    return "\n".join(close_braces(balance_dollars(line)) for line in text.split("\n"))


def keep_hyphen(left: str, right: str) -> bool:
    if not (left[-1:].isalpha() and right[:1].isalpha()):
        return True
    if left[-1].islower() and right[0].islower():
        return re.split(r"[^A-Za-z]", left)[-1].lower() in KEPT_PREFIXES
    return not (left.isupper() and right.isupper())


def merge_hyphenation(text: str) -> str:
    return re.sub(r"(\w{3,})-\n(\w{2,})", lambda m: m[0] if keep_hyphen(m[1], m[2]) else m[1] + m[2], text)


def normalize_whitespace(text: str, config: CleaningConfig = CleaningConfig()) -> str:
    out, run = [], 0
    for line in text.expandtabs(config.tab).splitlines():
        line = line.rstrip(" ")
        if config.collapse_spaces:
            line = re.sub(r"(?<=\S) {3,}(?=\S)", "  ", line)
        if line.strip():
            run = 0
        else:
            line, run = "", run + 1
        if run <= config.max_blank_lines:
            out.append(line)
    return "\n".join(out) + "\n"


def auto_width(text: str) -> int:
    """Mean of the mean line lengths of blocks of three lines or more; 80 without one, 20 at least."""
    means, block = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(len(line.rstrip()))
        else:
            if len(block) >= 3:
                means.append(sum(block) / len(block))
            block = []
    return max(20, round(sum(means) / len(means))) if means else 80


def is_structural(line: str) -> bool:
    """Headings, page markers, images, table rows and display math stay whole."""
    bare = line.strip()
    return bare.startswith(("#", "<page", "[Page", "![", "$$")) or bare.endswith("$$") or bare.startswith("[") and "Image:" in bare or bare.startswith("|") and bare.endswith("|")


def wrap_lines(text: str, width: int) -> str:
    import textwrap

    out = []
    for line in text.split("\n"):
        if len(line) <= width or not line.strip() or is_structural(line):
            out.append(line)
            continue
        indent = line[: len(line) - len(line.lstrip())]
        out += textwrap.wrap(line.strip(), width=width, initial_indent=indent, subsequent_indent=indent, break_long_words=True, break_on_hyphens=False) or [line]
    return "\n".join(out)


def clean(text: str | None, config: CleaningConfig = CleaningConfig()) -> str | None:
    if not text or not config.enabled:
        return text
    if config.unicode:
        text = normalize_unicode(text)
    if config.math:
        text = fix_math(text)
    if config.hyphens:
        text = merge_hyphenation(text)
    if config.whitespace:
        text = normalize_whitespace(text, config)
    if config.wrap:
        text = wrap_lines(text, config.width or auto_width(text))
    return text


def clean_text(column: Column | str, config: CleaningConfig = CleaningConfig()) -> Column:
    """All cleaning steps in order, in one Arrow pass."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([clean(t, config) for t in texts], dtype=object)

    return run(column)


_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl", 0xFB05: "st", 0xFB06: "st"}
_HYPHENS = {0x00AD: None, 0x002D: None, 0x2010: None}


def signature_of(text: str) -> str:
    """What of a text no layout repair may change: no spaces, no hyphens, one case."""
    return "".join(unicodedata.normalize("NFC", text).translate({**_LIGATURES, **_HYPHENS}).split()).casefold()


@F.pandas_udf(T.StringType())
def content_signature(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else signature_of(t) for t in texts], dtype=object)
