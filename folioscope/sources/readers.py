"""Readers: item discovery, working logs, transcripts, contexts, look-up tables, images and PDF pages behind interfaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.numbers import natural_key, sequence_number

#: Image suffixes, log version, marker of transcripts, longest context without a warning.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".gif", ".webp"]
LOG_VERSION = 2
TRANSCRIPT_MARK = "# Transcription of:"
CONTEXT_LENGTH = 4000


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """path, dir, name, stem, ext, length of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return describe_files(files)


def describe_files(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"dir": F.regexp_replace("path", "/[^/]*$", ""), "name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": suffix(F.col("path"))})


def discover_items(files: DataFrame) -> DataFrame:
    """PDF files and image folders (item_id, kind, path, image_count, size); an image folder below another one is left out.

    A folder's ancestors are exploded and semi-joined with the image folders, so the check is an equi-join on paths.
    """
    pdf = files.where("ext = '.pdf'").select(F.col("stem").alias("item_id"), F.lit("pdf").alias("kind"), "path", F.lit(None).cast("long").alias("image_count"), F.col("length").alias("size"))
    size = F.when(F.count_if(F.col("length").isNull()) == 0, F.sum("length"))
    folders = files.where(F.col("ext").isin(IMAGE_SUFFIXES)).groupBy("dir").agg(F.count(F.lit(1)).alias("image_count"), size.alias("size"))
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    nested = folders.where(F.size(parts) > 1).select("dir", F.explode(up).alias("above")).join(folders.select(F.col("dir").alias("above")), "above", "left_semi").select("dir").distinct()
    top = folders.join(nested, "dir", "left_anti")
    return pdf.unionByName(top.select(F.element_at(F.split("dir", "/"), -1).alias("item_id"), F.lit("images").alias("kind"), F.col("dir").alias("path"), "image_count", "size"))


def folder_listing(files: DataFrame) -> DataFrame:
    """Images of each folder in natural order: dir, idx, name, sequence_number."""
    images = files.where(F.col("ext").isin(IMAGE_SUFFIXES)).withColumn("_k", natural_key(F.col("name")))
    return images.select("dir", (F.row_number().over(Window.partitionBy("dir").orderBy("_k", "name")) - 1).alias("idx"), "name", sequence_number(F.col("stem")).alias("sequence_number"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value): numbered non-blank lines of text files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return number_lines(whole)


def number_lines(texts: DataFrame) -> DataFrame:
    lines = F.filter(F.split("value", "\r\n|[\n\r]"), lambda x: F.trim(x) != "")
    return texts.select("path", F.posexplode(lines).alias("n", "value"))


def parse_logs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, entries) of working logs given as numbered lines (path, n, value).

    A log whose first line isn't a header of the version is refused whole. Lines that aren't JSON objects are skipped,
    a truncated last one among them. ``has_error`` is the presence of the key.
    """
    typed = lines.withColumn("v", F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.col("value")))
    get = lambda path: F.get_json_object("v", path)
    head = typed.where("n = 0").where(get("$._format_version").try_cast("int") == LOG_VERSION)
    runs = head.select("path", get("$.input_item_name").alias("item_id"), get("$.log_type").alias("log_type"), get("$._format_version").try_cast("int").alias("format_version"), get("$.total_images").try_cast("int").alias("total_images"), get("$.model_name").alias("model_name"), get("$.input_type").alias("input_type"), get("$.file_provenance").alias("provenance"))
    keys = F.json_object_keys("v")
    entries = typed.where("n > 0 and v is not null").join(runs.select("path", "item_id"), "path").where(F.array_contains(keys, "original_input_order_index"))
    return runs, entries.select("path", "item_id", "n", get("$.original_input_order_index").try_cast("int").alias("idx"), get("$.transcription").alias("text"), F.array_contains(keys, "error").alias("has_error"), get("$.error").alias("error"), F.col("v").alias("raw"))


def transcripts(texts: DataFrame) -> DataFrame:
    """Texts (path, value) that begin with the transcript mark and lie in no folder named like a backup; CRLF noted and normalized."""
    bare = F.regexp_replace(F.ltrim("value"), "^﻿", "")
    return texts.where(bare.startswith(TRANSCRIPT_MARK) & ~F.lower("path").rlike("(^|/)[^/]*backup[^/]*(/|$)")).select("path", F.regexp_replace("value", "\r\n?", "\n").alias("text"), F.contains("value", F.lit("\r\n")).alias("had_crlf"))


def resolve_context(items: DataFrame, by_file: DataFrame, by_folder: DataFrame, general: str | None = None) -> DataFrame:
    """First non-empty context of file, folder, general. Tables: (item_id, context) and (dir, context)."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = items.join(by_file.select("item_id", full(F.col("context")).alias("_f")), "item_id", "left").join(by_folder.select("dir", full(F.col("context")).alias("_d")), "dir", "left")
    context = F.coalesce("_f", "_d", full(F.lit(general).cast("string")))
    return out.withColumns({"context": context, "context_long": F.coalesce(F.length(context) > CONTEXT_LENGTH, F.lit(False))}).drop("_f", "_d")


def provenance(files: DataFrame) -> DataFrame:
    """Adds SHA-256 and size of contents (needs the ``content`` column)."""
    return files.withColumn("provenance", F.struct(F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("byte_size")))


def render_pages(files: DataFrame, renderer: Callable[[bytes], Iterator[bytes]] | None = None) -> DataFrame:
    """(path, page_index, image) of PDF contents. ``renderer`` yields a raster per page; by default an optional PDF library."""

    def pages(content: bytes) -> Iterator[bytes]:
        import fitz

        with fitz.open(stream=content, filetype="pdf") as document:
            for page in document:
                yield page.get_pixmap().tobytes("jpeg")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for i, image in enumerate((renderer or pages)(content)):
                    yield pd.DataFrame({"path": [path], "page_index": [i], "image": [image]})

    return files.select("path", "content").mapInPandas(run, "path string, page_index int, image binary")


def transcribe(pages: DataFrame, client: Callable[[bytes], str]) -> DataFrame:
    """Adds ``answer`` of a model client, called on the executors; the client is any picklable callable."""

    @F.pandas_udf("string")
    def ask(images: pd.Series) -> pd.Series:
        return pd.Series([client(i) for i in images], dtype=object)

    return pages.withColumn("answer", ask("image"))
