"""Operator 10, packing: token sequences of a fixed window by non-negative least squares over length combinations.

1. Documents are tokenized once and written; what follows reads only their lengths.
2. A document's full windows are sequences of their own. What is left, its tail, falls into a length bin (``QUANTUM``).
3. Shallow combinations of up to three bins that fill a window are enumerated; repeat counts are fitted to the histogram
   of bins by non-negative least squares, rounded down and reduced until no bin is asked for more tails than it has.
4. Tails are dealt to the combinations by their rank within the bin. Tails that are left over are packed greedily one
   after another, cut where a window is full.

Padding is the rest of a bin at most (``QUANTUM`` - 1 tokens a tail) in combined sequences and the last greedy sequence.
Ranks and prefix sums are taken within an input part and offset by the totals of earlier parts (a row per part and bin), so
that no task holds a whole bin. The driver sees the histogram only, whose size is fixed by the window.

Ids are those of the tokenizer file without special tokens (their strings are ordinary text), then the end id. Texts of
plain Latin characters go through the same vocabulary in a faster library; its results are equal there and tested to be.

Defined cases: a null or empty text is the end id alone. Repeated rows and null ids are packed like any other. Extra
columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.llm.storage import Scratch

WINDOW, QUANTUM, END = 2048, 8, 1
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters on whose classes every regular-expression library agrees.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ]")


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.path(RANKS)


@lru_cache(maxsize=2)
def encoders(paths: tuple[str, str]):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(paths[0])
    slow.encode_special_tokens = True
    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return slow, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, paths: tuple[str, str], end: int = END) -> np.ndarray:
    slow, fast = encoders(paths)
    if not text:
        return np.array([end], dtype="<u4")
    ids = slow.encode(text, add_special_tokens=False).ids if _OTHER.search(text) else fast.encode_ordinary(text)
    return np.array([*ids, end], dtype="<u4")


def _tokenize(paths: tuple[str, str], end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = [token_ids(t, paths, end) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    return run


def combinations(units: int) -> np.ndarray:
    """Columns: how often each bin 1..units occurs in each combination of one to three bins of sum ``units``."""
    found = [(units,)] + [(a, units - a) for a in range(1, units // 2 + 1)]
    found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    out = np.zeros((units, len(found)))
    for j, parts in enumerate(found):
        for k in parts:
            out[k - 1, j] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 3000, product=None) -> np.ndarray:
    """min ||a x - b||, x >= 0, by the active-set method. ``product(r)`` may give ``a.T @ r`` more cheaply."""
    product = product or (lambda r: a.T @ r)
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-7 * max(1.0, np.abs(product(b)).max(initial=0))
    for _ in range(most):
        w = product(b - a[:, passive] @ x[passive])
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tolerance or passive.sum() >= a.shape[0]:
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            own = a[:, at]
            try:
                s = np.linalg.solve(own.T @ own, own.T @ b)
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(own, b, rcond=None)[0]
            if s.min() > 0:
                break
            low = s <= 0
            now = x[at]
            step = (now[low] / np.maximum(now[low] - s[low], 1e-300)).min()
            x[at] = now + step * (s - now)
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
        x[:] = 0
        x[at] = s
    return x


def plan_repeats(histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(combinations that repeat, repeats): never asks a bin for more than it has."""
    a = combinations(len(histogram))
    present = np.all((a == 0) | (histogram[:, None] > 0), axis=0)
    a = a[:, present]
    scale = max(1.0, histogram.max(initial=0))
    # a column has three bins at most: its product with a residual is a sum of three entries
    rows = np.argsort(-a, axis=0, kind="stable")[:3]
    share = np.take_along_axis(a, rows, axis=0)
    product = lambda r: (r[rows] * share).sum(axis=0)
    x = np.floor(nnls(a, histogram / scale, product=product) * scale + 1e-6) if a.shape[1] else np.zeros(0)
    while (over := a @ x > histogram).any():
        share = np.where(over, histogram / np.maximum(a @ x, 1), 1.0)
        worst = np.min(np.where(a > 0, share[:, None], 1.0), axis=0)
        x = np.where(worst < 1, np.minimum(np.floor(x * worst), np.maximum(x - 1, 0)), x)
    return a[:, x > 0].astype(int), x[x > 0].astype(np.int64)


def slots(a: np.ndarray, x: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, sequence of the first rank, place) for each bin of each combination."""
    out, used, base = [], np.zeros(a.shape[0], dtype=np.int64), 0
    for j, repeats in enumerate(x.tolist()):
        place = 0
        for k in np.flatnonzero(a[:, j]).tolist():
            for _ in range(a[k, j]):
                out.append((k + 1, int(used[k]), int(used[k]) + repeats, base, place))
                used[k] += repeats
                place += 1
        base += repeats
    return out


def _running(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """Adds the exclusive prefix sum of ``value`` in (part, row) order within ``by``."""
    order = Window.partitionBy("part", *by).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy("part", *by).agg(F.sum(value).alias("_t"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *by, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    return df.withColumn("_r", F.coalesce(F.sum(value).over(order), F.lit(0))).join(offsets, ["part", *by]).withColumn(name, F.col("_r") + F.col("_o")).drop("_r", "_o")


def _pieces(df: pd.DataFrame) -> Iterator[tuple]:
    for doc, ids, n, found in zip(df["doc_id"], df["ids"], df["n"], df["pieces"], strict=True):
        for p in found:
            yield doc, p["start"], p["length"], ids[4 * p["start"] : 4 * (p["start"] + p["length"])], n, p["sequence_id"], p["offset"]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for batch in batches:
        for at in range(0, len(batch), 500):
            out = pd.DataFrame(list(_pieces(batch.iloc[at : at + 500])), columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out


def pack_documents(spark: SparkSession, docs: DataFrame, window: int = WINDOW, quantum: int = QUANTUM, end: int = END, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_tokenize(paths or default_paths(), end), "doc_id long, n long, ids binary")
    tokens = scratch.table(rows.withColumn("row", F.monotonically_increasing_id()))
    lengths = tokens.select("row", "n", F.shiftright("row", 33).alias("part"), (F.col("n") % window).alias("tail"), F.floor(F.col("n") / window).alias("full"))
    lengths = lengths.withColumn("bin", F.ceil(F.col("tail") / quantum).cast("int"))
    units = window // quantum
    histogram = np.zeros(units)
    for k, c in lengths.where("tail > 0").groupBy("bin").count().collect():
        histogram[k - 1] = c
    a, x = plan_repeats(histogram)
    table = spark.createDataFrame(slots(a, x) or [(0, 0, 0, 0, 0)], "bin int, low long, high long, base long, place int")
    greedy_base = int(x.sum())

    ranked = _running(lengths.where("tail > 0").withColumn("one", F.lit(1)), "one", "rank", ["bin"])
    ranked = scratch.table(ranked.join(F.broadcast(table.withColumnRenamed("bin", "_b")), (F.col("bin") == F.col("_b")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left").select("row", "part", "n", "tail", (F.col("base") + F.col("rank") - F.col("low")).alias("sequence_id"), "place"))
    within = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    combined = ranked.where("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("tail").over(within), F.lit(0)))
    combined = combined.select("row", F.array(F.struct((F.col("n") - F.col("tail")).alias("start"), F.col("tail").alias("length"), "sequence_id", F.col("offset").cast("long").alias("offset"))).alias("tails"))

    left = _running(ranked.where("sequence_id is null").drop("sequence_id"), "tail", "at", [])
    first = F.least("tail", window - F.col("at") % window)
    start, sequence = F.col("n") - F.col("tail"), greedy_base + F.floor(F.col("at") / window)
    piece = lambda s, n, q, o: F.struct(s.cast("long").alias("start"), n.cast("long").alias("length"), q.cast("long").alias("sequence_id"), o.cast("long").alias("offset"))
    head, rest = piece(start, first, sequence, F.col("at") % window), piece(start + first, F.col("tail") - first, sequence + 1, F.lit(0))
    cut = left.select("row", F.when(first < F.col("tail"), F.array(head, rest)).otherwise(F.array(head)).alias("tails"))
    spent = ranked.where("sequence_id is null").agg(F.sum("tail")).first()[0] or 0
    full_base = greedy_base + -(-spent // window)

    whole = _running(lengths.where("full > 0"), "full", "before", []).select("row", F.expr(f"transform(sequence(0L, full - 1), i -> struct(i * {window} as start, {window}L as length, {full_base} + before + i as sequence_id, 0L as offset))").alias("fulls"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    plan = combined.unionByName(cut).join(whole, "row", "full_outer").select("row", F.concat(F.coalesce("fulls", none), F.coalesce("tails", none)).alias("pieces"))
    return tokens.join(plan, "row").select("doc_id", "ids", "n", "pieces").mapInPandas(_cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
