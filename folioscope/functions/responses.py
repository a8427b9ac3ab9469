"""JSON answers of models: validity, salvage, text extraction, placeholders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.numbers import cut_at_word
from folioscope.functions.text import strip_fence

#: Keys that an answer must have.
TRANSCRIPTION_KEYS = ["image_analysis", "transcription", "no_transcribable_text", "transcription_not_possible"]
SUMMARY_KEYS = ["page_information", "bullet_points", "references"]


def missing_keys(raw: Column, keys: list[str]) -> Column:
    """Keys that a JSON object lacks; all of them when the text isn't a JSON object."""
    wanted = F.array(*map(F.lit, keys))
    present = F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{"), F.json_object_keys(raw))
    return F.when(present.isNull(), wanted).otherwise(F.array_except(wanted, present))


def is_valid(raw: Column, keys: list[str]) -> Column:
    return F.size(missing_keys(raw, keys)) == 0


def salvage_object(text: str) -> dict | None:
    """Innermost-to-outermost JSON object that ends at the text's last brace."""
    end = text.rfind("}")
    start = text.rfind("{", 0, end + 1)
    while end >= 0 and start >= 0:
        try:
            found = json.loads(text[start : end + 1])
        except ValueError:
            start = text.rfind("{", 0, start)
        else:
            return found if isinstance(found, dict) else None
    return None


@F.pandas_udf(T.StringType())
def salvaged(texts: pd.Series) -> pd.Series:
    """The JSON object of a text, as JSON, read whole or salvaged; null without one."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        try:
            found = json.loads(t)
        except ValueError:
            found = salvage_object(t)
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None

    return pd.Series([one(t) for t in texts], dtype=object)


def image_name(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("unknown_image"))


def transcription_text(raw: Column, name: Column, salvage: bool = False) -> Column:
    """Text of an answer: its transcription, a bracketed note for its flags, else the answer without its fence."""
    bare = strip_fence(raw)
    body = salvaged(bare) if salvage else F.when(F.try_parse_json(bare).isNotNull(), bare)
    field = lambda k: F.get_json_object(body, f"$.{k}")
    note = lambda what: F.concat(F.lit("["), image_name(name), F.lit(f": {what} — "), cut_at_word(F.coalesce(field("image_analysis"), F.lit(""))), F.lit("]"))
    empty = F.coalesce(F.length(raw), F.lit(0)) == 0
    failed = F.concat(F.lit("[transcription error: "), F.coalesce(F.nullif(name, F.lit("")), F.lit("[unknown image]")), F.lit("]"))
    return F.when(empty, failed).when(~bare.startswith("{"), bare).when(field("no_transcribable_text") == "true", note("no transcribable text")).when(field("transcription_not_possible") == "true", note("transcription not possible")).otherwise(F.coalesce(field("transcription"), bare))


def output_text(raw: Column) -> Column:
    """Text of the first shape that an answer has: output_text, content, nested output, parsed wrapper, tool arguments."""
    get = lambda path: F.nullif(F.get_json_object(raw, path), F.lit(""))
    return F.coalesce(get("$.output_text"), get("$.content"), get("$.output[0].content[0].text"), get("$.parsed"), get("$.raw.content"), get("$.raw.tool_calls[0].args"))


def placeholder(error: Column, blank: Column) -> Column:
    """struct(page_types, bullets) of a page that isn't summarized; null where it is to be."""
    entry = lambda kind, text: F.struct(F.array(F.lit(kind)).alias("page_types"), F.array(text).alias("bullets"))
    return F.when(error.isNotNull(), entry("other", F.concat(F.lit("[Transcription failed: "), error, F.lit("]")))).when(blank, entry("blank", F.lit("[empty page]")))


def retries(flag: Column, attempt: Column, enabled: Column, most: Column, base: Column, multiplier: Column) -> Column:
    """struct(retry, seconds) for a flag of the answer's schema, by its configuration."""
    again = flag & enabled & (attempt < most)
    return F.struct(again.alias("retry"), F.when(again, base * F.pow(multiplier, attempt)).otherwise(0.0).alias("seconds"))


def prompt_with_context(prompt: Column, context: Column) -> Column:
    """Replaces ``{{CONTEXT}}``, or drops its lines where there is no context."""
    dropped = F.regexp_replace(prompt, r"(?m)^.*\{\{CONTEXT\}\}.*\n?", "")
    return F.when(F.coalesce(F.trim(context), F.lit("")) == "", dropped).otherwise(F.replace(prompt, F.lit("{{CONTEXT}}"), context))
