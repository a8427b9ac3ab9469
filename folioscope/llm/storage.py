"""Materialised intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a fresh local folder where it is unset and the master is local, else an error:
    the machines of a cluster don't share their folders."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not getattr(context, "_folioscope_shared", None):
        context._folioscope_shared = "file://" + tempfile.mkdtemp(prefix="folioscope-")
        context.setCheckpointDir(context._folioscope_shared)
    return context._folioscope_shared


#: Bytes that go to Python in one Arrow batch, about. Texts may be long, and both sides of the pipe hold a batch off heap.
ARROW_BYTES = 4 << 20
#: Whether a query's shuffle files are deleted when it ends; otherwise they stay until the driver's garbage is collected.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``ARROW_BYTES``; a smaller limit stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


#: Least seconds between two collections of the driver's garbage.
COLLECT_S = 5


def collect_garbage(spark: SparkSession) -> None:
    """Returns to the system what the plans and statuses of earlier queries hold of the driver's memory."""
    context = spark.sparkContext
    if time.monotonic() - getattr(context, "_folioscope_collected", 0) >= COLLECT_S:
        context._jvm.java.lang.System.gc()
        context._folioscope_collected = time.monotonic()


class Scratch:
    """Tables of one operator call. ``table`` cuts lineage by writing Parquet; ``drop`` frees what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def table(self, *parts: DataFrame) -> DataFrame:
        """The rows of all parts, written one part after another. A part's shuffle files go when it is written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        before = self.spark.conf.get(FREE_SHUFFLES)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            for i, df in enumerate(parts):
                df.write.mode("append" if i else "overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before)
        collect_garbage(self.spark)
        out = self.spark.read.schema(parts[0].schema).parquet(path)
        out._folioscope_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_folioscope_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
