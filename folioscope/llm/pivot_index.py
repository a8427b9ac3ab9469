"""Operator 4, embedding near-duplicates: a pivot-permutation index per label, then exact verification.

Every vector is described by the ``DEPTH`` nearest of ``P`` reference points, in order of nearness. Inverted lists are kept
per label and pair of pivots, so that a list holds the vectors whose shared-pivot count is two at least. Candidates are
verified by cosine in double precision.

Vectors of each dimension have reference points and lists of their own. The points are rows of smallest hash, a bounded sample (``MAX_PIVOTS`` at most, twice the square root of the
table below that). A row whose cosine to a chosen point reaches ``APART`` is passed over, so that a dense group doesn't
supply the points that should tell its members' surroundings, and fixed random directions fill the rest. Every row is
indexed. Lists of one member are dropped before vectors are sent. A list longer than a
tile is split; each pair of tiles is a unit of work, so a hot list spreads over tasks. A unit returns, per vector, how many
of its links it counted, and a spanning forest of them: rows are in proportion to the members, never to the pairs. A pair
that meets in several lists is counted in the one of its two smallest shared pivots only.

Defined cases: null label, null, empty or zero vector, null or non-finite component: no links. Vectors of different
dimensions don't link; a dimension that the sample misses is indexed by random directions. Repeated ids are distinct vectors; their links count, and their component is shared by id. A null id is linked
like any other row and is never a component's smallest unless it is alone (null). Extra columns are ignored. Empty table:
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.storage import Scratch

THRESHOLD = 0.98
DEPTH, MIN_PIVOTS, MAX_PIVOTS, APART = 8, 64, 2048, 0.6
#: Longest list that isn't split, and longest that is compared pair by pair instead of by a matrix product.
TILE, BULK = 256, 32


def _usable(raw: list) -> list[np.ndarray | None]:
    out = []
    for v in raw:
        x = None if v is None else np.array([np.nan if c is None else c for c in v], dtype=np.float64)
        out.append(x if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def _describe(pivots: dict[int, np.ndarray], want: int):
    """Keeps usable rows: row, label (after the dimension), unit vector as bytes, nearest pivots in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors = _usable(batch["embedding"].tolist())
            for size in sorted({len(v) for v in vectors if v is not None}):
                if size not in pivots:
                    pivots[size] = _directions(size, want)
                good = [i for i, v in enumerate(vectors) if v is not None and len(v) == size]
                out = batch.iloc[good][["row", "label"]].copy()
                x = np.array([vectors[i] for i in good])
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                nearest = np.argsort(-(x @ pivots[size].T), axis=1, kind="stable")[:, :DEPTH]
                out["label"] = f"{size}|" + out["label"]
                out["v"] = [r.tobytes() for r in x]
                out["near"] = [r.astype(np.int32) for r in nearest]
                yield out

    return run


def _pairs_within(cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of the same segment, in chunks of about a hundred thousand; segments are at most ``BULK`` long."""
    ends = np.repeat(cuts[1:], np.diff(cuts))
    partners = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(partners)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 100_000, side="right")))
        count = partners[at:stop]
        a = np.repeat(np.arange(at, stop), count)
        step = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        yield a, a + 1 + step
        at = stop


def _counted_here(near: np.ndarray, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether (p, q), the list of ``a``, are the pair's two smallest shared pivots."""
    both = (near[a][:, :, None] == near[b][:, None, :]).any(axis=2)
    return ~(both & (near[a] < q[a][:, None]) & (near[a] != p[a][:, None])).any(axis=1)


def links_of(rows: np.ndarray, part: np.ndarray, side: np.ndarray, p: np.ndarray, q: np.ndarray, near: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the links that these inverted lists count. Entries are sorted by part; sides 1 and 2 are two tiles of one
    list, of which only the pairs across are wanted, and side 0 is all there is."""
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(rows)]])
    length = np.diff(cuts)
    found = []
    small = np.repeat(length <= BULK, length)
    at = np.flatnonzero(small)
    for a, b in _pairs_within(np.concatenate([[0], np.cumsum(length[length <= BULK])])):
        a, b = at[a], at[b]
        keep = ((side[a] == 0) | (side[a] != side[b])) & _counted_here(near, a, b, p, q)
        a, b = a[keep], b[keep]
        keep = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        found.append((a[keep], b[keep]))
    for i, j in zip(cuts[:-1][length > BULK].tolist(), cuts[1:][length > BULK].tolist(), strict=True):
        own, two = x[i:j], side[i:j]
        close = own @ own.T >= threshold - 1e-9
        if two.any():
            close &= two[:, None] != two[None, :]
        a, b = np.nonzero(np.triu(close, 1))
        for k in range(0, len(a), 100_000):
            u, v = a[k : k + 100_000] + i, b[k : k + 100_000] + i
            keep = _counted_here(near, u, v, p, q)
            u, v = u[keep], v[keep]
            keep = np.einsum("ij,ij->i", x[u], x[v]) >= threshold
            found.append((u[keep], v[keep]))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *(a for a, _ in found)]), np.concatenate([none, *(b for _, b in found)])


def _count_links(threshold: float):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values(["part", "side", "row"])
        rows, x = unit["row"].to_numpy(), np.frombuffer(b"".join(unit["v"]), dtype=np.float64).reshape(len(unit), -1)
        near = np.sort(np.array(unit["near"].tolist()), axis=1)
        a, b = links_of(rows, unit["part"].to_numpy(), unit["side"].to_numpy(), unit["p"].to_numpy(), unit["q"].to_numpy(), near, x, threshold)
        own, index = np.unique(rows, return_inverse=True)
        a, b = index[a], index[b]
        n = np.bincount(np.concatenate([a, b]), minlength=len(own))
        low = np.arange(len(own))
        while True:  # smallest row that each reaches over the unit's links
            before = low.copy()
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
            low = low[low]
            if (low == before).all():
                break
        some, tied = np.flatnonzero(n), np.flatnonzero(low != np.arange(len(own)))
        return pd.DataFrame({"a": np.concatenate([own[some], own[tied]]), "b": np.concatenate([np.full(len(some), -1), own[low[tied]]]).astype("int64"), "n": np.concatenate([n[some], np.zeros(len(tied), dtype=np.int64)]).astype("int64")})

    return run


def _directions(size: int, n: int) -> np.ndarray:
    """``n`` random unit vectors, the same on every machine."""
    found = np.random.default_rng(0).normal(size=(n, size))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, want: int) -> dict[int, np.ndarray]:
    """``want`` reference points as unit vectors for each dimension in the sample."""
    sample = vectors.where("embedding is not null and label is not null").select("embedding", F.xxhash64("embedding", "row").alias("h")).orderBy("h").limit(2 * want)
    found = [v for v in _usable([list(r[0]) for r in sample.collect()]) if v is not None]
    out = {}
    for size in sorted({len(v) for v in found}):
        rows = np.array([v / np.abs(v).max() for v in found if len(v) == size])
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        chosen, near = [], np.full(len(rows), -1.0)
        for k in range(len(rows)):
            if near[k] < APART and len(chosen) < want:
                chosen.append(rows[k])
                near = np.maximum(near, rows @ rows[k])
        out[size] = np.concatenate([np.array(chosen), _directions(size, want - len(chosen))])
    return out


def _units(postings: DataFrame) -> DataFrame:
    """Splits lists into tiles and gives each posting the units it takes part in; short lists share units by hash."""
    counts = postings.groupBy("label", "p", "q").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    live = postings.join(counts, ["label", "p", "q"])
    one = live.where(F.col("m") <= TILE)
    many = live.where(F.col("m") > TILE).withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    many = many.withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    size = F.substring_index("label", "|", 1)  # a unit holds vectors of one dimension
    lots = F.concat(F.lit("s"), size, F.lit(":"), F.pmod(F.xxhash64("label", "p", "q"), F.lit(4096)).cast("string"))
    few = one.select("row", "p", "q", lots.alias("unit"), F.struct("label", "p", "q").alias("part"), F.lit(0).alias("side"))
    tile = F.col("tile")
    name = lambda j: F.concat_ws(":", "label", "p", "q", F.least(tile, j), F.greatest(tile, j))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(name(j).alias("unit"), F.when(tile == j, 0).when(tile < j, 1).otherwise(2).alias("side"))))
    wide = many.select("row", "p", "q", "label", spread.alias("x")).select("row", "p", "q", "x.unit", F.struct("label", "p", "q").alias("part"), "x.side")
    return few.unionByName(wide).withColumn("part", F.xxhash64("part"))


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    scratch = Scratch(spark, "pivots")
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = scratch.table(base.withColumn("row", F.monotonically_increasing_id()))
    want = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 2 * rows.count() ** 0.5)))
    pivots = choose_pivots(rows, want)
    described = scratch.table(rows.where("label is not null and embedding is not null").select("row", "label", "embedding").mapInPandas(_describe(pivots, want), "row long, label string, v binary, near array<int>"))
    sorted_near = F.array_sort("near")
    pairs = F.array(*[F.struct(sorted_near[i].alias("p"), sorted_near[j].alias("q")) for i, j in combinations(range(DEPTH), 2)])
    postings = described.select("row", "label", F.explode(pairs).alias("x")).select("row", "label", "x.p", "x.q")
    units = _units(postings).join(described.select("row", "v", "near"), "row")
    found = scratch.table(units.groupBy("unit").applyInPandas(_count_links(threshold), "a long, b long, n long"))
    degree = found.where("b < 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    ids = rows.select("row", "vec_id")
    edges = found.where("b >= 0").select("a", "b").distinct()
    # components run over rows; where rows of one id fall into several, those are tied by the id
    member = connected_components(spark, edges)
    low = member.join(ids, member["node"] == ids["row"]).groupBy("component").agg(F.min("vec_id").alias("component_id"))
    by_row = member.join(low, "component").select(F.col("node").alias("row"), "component_id")
    out = scratch.table(ids.join(degree, "row", "left").join(by_row, "row", "left").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id")))
    own = out.groupBy("vec_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a != b").select("vec_id", "a")
    split = scratch.table(out.join(own, "vec_id").where("component_id != a").select("a", F.col("component_id").alias("b")).distinct())
    if not split.isEmpty():
        tied = connected_components(spark, split).select(F.col("node").alias("component_id"), F.col("component").alias("_tied"))
        out = out.join(tied, "component_id", "left").withColumn("component_id", F.coalesce("_tied", "component_id"))
    component = F.col("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
