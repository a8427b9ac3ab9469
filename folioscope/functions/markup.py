"""Math and emphasis in running text: segments and simplification."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values, in the order in which they apply: literal and one-argument replacements, delimiters and their sizes.
LITERALS_FIRST = {"\\land": "\\wedge", "\\lor": "\\vee", "\\lnot": "\\neg", "\\iff": "\\Leftrightarrow", "\\implies": "\\Rightarrow"}
ARGUMENTS_FIRST = {"text": "\\mathrm", "textrm": "\\mathrm", "textit": "\\mathit", "textbf": "\\mathbf", "bar": "\\overline", "tilde": "\\widetilde", "hat": "\\widehat", "vec": "\\overrightarrow", "dot": None, "ddot": None}
SIZES = ["Big", "big", "bigg", "Bigg", "Bigl", "Bigr", "bigl", "bigr", "biggl", "biggr", "Biggl", "Biggr", "bigm", "Bigm"]
ARGUMENTS_SECOND = {"overleftarrow": None, "overrightarrow": "\\vec", "underleftarrow": None, "underrightarrow": None}
DROPPED_ARGUMENTS = {"phantom": "", "hphantom": "", "vphantom": ""}
LITERALS_SECOND = {"\\,": " ", "\\;": " ", "\\!": "", "\\quad": " ", "\\qquad": "  "}
SPACES = {"hspace": " ", "vspace": "", "mspace": " "}
ENVIRONMENTS = ["align\\*?", "gather\\*?", "equation\\*?", "split", "cases"]

_MATH = re.compile(r"\$\$((?:\\\$|[^$]|\$(?!\$))+?)\$\$|(?<![$\\])\$(?!\$)((?:\\\$|[^$])+?)\$(?!\$)", re.S)
_EMPHASIS = re.compile(r"\*\*([^*]+)\*\*|\*([^*]+)\*")
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("content", T.StringType())]))


def split_segments(text: str, pattern: re.Pattern, kinds: tuple[str, ...]) -> list[tuple[str, str]]:
    """(kind, content): matches by the group that holds them, and ``text`` between them."""
    out, at = [], 0
    for m in pattern.finditer(text):
        if m.start() > at:
            out.append(("text", text[at : m.start()]))
        out.append((kinds[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    if at < len(text) or not out:
        out.append(("text", text[at:]))
    return out


def math_segments(text: str) -> list[tuple[str, str]]:
    """Text, inline and display math; an escaped dollar is a dollar."""
    return [(kind, part.replace("\\$", "$")) for kind, part in split_segments(text, _MATH, ("display", "inline"))]


def emphasis_segments(text: str) -> list[tuple[str, str]]:
    return split_segments(text, _EMPHASIS, ("bold", "italic"))


def tight_math(code: str) -> str:
    """One space at a time, none around operators and braces."""
    return re.sub(r"\s*([=+\-*/^_{}])\s*", r"\1", re.sub(" +", " ", code.strip()))


def _argument(name: str, to: str | None) -> tuple[re.Pattern, str, str]:
    loose = "[^}]*" if name.startswith("text") else "[^}]+"
    return re.compile(rf"\\{name}\{{({loose})\}}"), r"\1" if to is None else to.replace("\\", r"\\") + r"{\1}", name


def _rules() -> list[tuple[re.Pattern, str, str]]:
    literal = lambda a, b: (re.compile(re.escape(a)), b.replace("\\", r"\\"), a)
    sized = "|".join(SIZES)
    rules = [literal(a, b) for a, b in LITERALS_FIRST.items()] + [_argument(a, b) for a, b in ARGUMENTS_FIRST.items()]
    rules += [(re.compile(rf"\\(?:{sized})(?:\\(?=[{{}}|])|\.|(?=[()\[\]|]))"), "", "delimiter sizes")]
    rules += [(re.compile(r"\\(?:left|right)\.|\\(?:left\s*(?=[(\[|]|\\[{|}])|right\s*(?=[)\]|]|\\[{|}]))|\\middle"), "", "automatic sizes")]
    rules += [(re.compile(rf"\\{side}brace\{{([^}}]+)\}}(?:{script}(?:\{{[^}}]*\}}|\S))?"), r"\1", f"{side}brace") for side, script in (("over", r"\^"), ("under", "_"))]
    rules += [_argument(a, b) for a, b in ARGUMENTS_SECOND.items()]
    rules += [(re.compile(rf"\\{a}\{{[^}}]*\}}"), b, a) for a, b in DROPPED_ARGUMENTS.items()]
    rules += [literal(a, b) for a, b in LITERALS_SECOND.items()]
    rules += [(re.compile(rf"\\{a}\{{[^}}]*\}}"), b, a) for a, b in SPACES.items()] + [_argument("operatorname", "\\mathrm")]
    rules += [(re.compile(rf"\\begin\{{{e}\}}(.+?)\\end\{{{e}\}}", re.S), r"\1", e) for e in ENVIRONMENTS]
    return rules + [(re.compile(r"&|\\\\"), " ", "alignment"), (re.compile(r"\\(?:no)?limits"), "", "limits")]


_RULES = _rules()


def simplify(code: str) -> tuple[str, list[str]]:
    """Math without what converters choke on, and the names of the rules that applied."""
    out = tight_math(code)
    applied = ["spaces"] if len(out) != len(code) else []
    for pattern, to, name in _RULES:
        out, n = pattern.subn(to, out)
        if n:
            applied.append(name)
    return " ".join(out.split()), applied


def segments(column: Column | str, kind: str = "math") -> Column:
    """array<struct<kind, content>> of math or emphasis."""
    split = math_segments if kind == "math" else emphasis_segments

    @F.pandas_udf(_SEGMENTS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [{"kind": k, "content": c} for k, c in split(t)] for t in texts], dtype=object)

    return run(column)


def simplified(column: Column | str) -> Column:
    """struct(text, applied)."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.ArrayType(T.StringType()))]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else simplify(t) for t in texts]
        return pd.DataFrame(rows, columns=["text", "applied"], dtype=object)

    return run(column)
