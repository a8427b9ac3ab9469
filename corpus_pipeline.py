"""Corpus pipeline over ``documents``: quality classifier, quality rules, n-gram Jaccard join, packing.

Each stage works on all that its predecessor kept; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import jaccard_join, packing, quality_classifier, quality_rules
from folioscope.llm.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words of a shingle and least Jaccard similarity in percent of the n-gram Jaccard stage (``op6_ngram_jaccard_join`` has 3 and 90).
SHINGLE, PERCENT = 5, 80
#: Rejected rows whose ids are broadcast at most (8 bytes each).
MAX_BROADCAST = 300_000


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: keeps documents predicted to be of quality 1. The fit reads the labels of every fold but one."""
    model = quality_classifier.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score_documents(spark, docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: drops documents that fail the base rule or lie far from the rest of their language and source."""
    return quality_rules.judge_quality(spark, docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: keeps the smallest id of each group of linked documents. With null or repeated ids, rows are numbered instead."""
    docs, key = docs.select(*COLUMNS), "doc_id"
    ids = docs.groupBy("doc_id").count().agg(F.count_if((F.col("count") > 1) | F.col("doc_id").isNull()).alias("odd")).first()
    if ids["odd"]:
        docs, key = Scratch(spark, "numbered").table(docs.withColumn("_row", F.monotonically_increasing_id())), "_row"
    found = jaccard_join.jaccard_components(spark, docs.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT)
    gone = Scratch(spark, "gone").table(found.where("doc_id != component_id").select(F.col("doc_id").alias(key)))
    if gone.count() <= MAX_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token sequences, one row per piece."""
    return packing.pack_documents(spark, docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality classifier", classify), ("quality rules", rules), ("n-gram Jaccard join", deduplicate), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
