"""Operator 6, n-gram Jaccard join: grouped prefix join over sets of word shingles, exact.

1. Every text becomes its set of distinct shingles (64-bit hashes). Equal sets form one class (copies are never paired).
2. Order of shingles: rarest first, by document frequency over all classes. Two sets of Jaccard ``t`` or more share one of
   their first ``n - ceil(t n) + 1`` shingles under any common order. Frequencies are counted for a part of the hash space
   in long sets (that part comes first in the order, and holds 2.5 prefixes) and for all of it in short ones. A class whose prefix holds only shingles of frequency 1 is linked with nothing and leaves here.
3. Classes of identical prefix and size form one group; groups that share a prefix shingle, at sizes that can link, are
   joined to the smallest one of the list. The candidate graph has a star per list, never its pairs.
4. Each candidate component is expanded to its members and verified inside: every pair, by counting over the component's
   inverted lists. Components beyond a tile's size are split into tiles by size band, so the pairs of two tiles are one
   unit of work whatever the component's size. A unit returns a spanning forest of the verified links.
5. Connected components over the verified links.

No link between different sets is lost, nothing is capped, and all that grows is joined, not collected.

Defined cases: null, empty or blank texts have no set and stand alone. Repeated rows are copies and share a class. A row
with a null id takes the smallest id that its class reaches, null without one. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.shingles import mix, shingle_set
from folioscope.llm.storage import Scratch

#: Sets from LONG_FROM on are ordered by frequencies of a share of the hashes (``_share``), sets up to the largest that a
#: shorter one can link to by full frequencies. Sets and their keys are dealt in so many passes by hash, one after another,
#: each of which frees its shuffle.
LONG_FROM, PASSES = 64, 4
#: Sets and shingles that a tile holds at most, on average; candidate classes whose ids are broadcast at most.
TILE_SETS, TILE_SHINGLES, MAX_BROADCAST = 512, 300_000, 300_000
_SHORT, _REST = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def _share(percent: int) -> int:
    """Sets of LONG_FROM and more are ordered by frequencies of one hash in so many: the keys counted are 2.5 prefixes or more, so
    that a prefix leaves out the commonest of them, and a quarter at least."""
    return min(4, max(1, 40 // max(1, 100 - percent)))


def universes(s: np.ndarray, percent: int) -> list[dict]:
    """What a set sends to be counted: ``keys`` to order by frequency, ``rest`` (already ordered) should they be too few."""
    n = len(s)
    p, out = _prefix_length(n, percent), []
    if percent * n <= 100 * LONG_FROM:
        out.append({"p": p, "keys": mix(s ^ _SHORT).view(np.int64), "rest": []})
    if n >= LONG_FROM:
        first = s % np.uint64(_share(percent)) == 0
        keys = s[first]
        rest = np.sort(mix(s[~first] ^ _REST))[: max(0, p - len(keys))]
        out.append({"p": p, "keys": mix(keys).view(np.int64), "rest": rest.view(np.int64)})
    return out


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sets(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": [len(s) for s in sets], "sig": [_signature(s) if len(s) else None for s in sets], "uni": [universes(s, percent) if len(s) else [] for s in sets]})

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, s.tobytes()) for c, t, sig in zip(batch["cid"], batch["text"], batch["sig"], strict=True) if _signature(s := shingle_set(t, size)) == bytes(sig)]
            yield pd.DataFrame(rows, columns=["cid", "s"])

    return run


def verified_forest(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets; with two sides, of those from one side to the other."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    apart, order = m - 1, np.argsort(codes, kind="stable")
    holders, ends = owner[order], np.cumsum(np.bincount(codes))
    starts = np.concatenate([[0], ends[:-1]])
    at = np.concatenate([[0], np.cumsum(sizes)])
    two = side.min() != side.max()
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a in range(m):
        if not apart:  # all are linked already
            break
        own = codes[at[a] : at[a + 1]]
        long = ends[own] - starts[own]
        total = int(long.sum())
        if total == len(own):
            continue
        index = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(total)
        common = np.bincount(holders[index], minlength=m)
        found = np.flatnonzero(100 * common >= percent * (sizes + sizes[a] - common))
        for b in found[found > a].tolist():
            if two and side[a] == side[b]:
                continue
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                apart -= 1
                out.append((int(ids[a]), int(ids[b])))
    return out


def _verify(percent: int):
    def run(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values(["part", "side", "cid"])
        ids, side, part = unit["cid"].to_numpy(), unit["side"].to_numpy(), unit["part"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in unit["s"]]
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(ids)]
        links = [x for i, j in zip(cuts, cuts[1:], strict=False) if j - i > 1 for x in verified_forest(ids[i:j], sets[i:j], side[i:j], percent)]
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def _candidate_edges(scratch: Scratch, classes: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges whose components hold every pair of classes that can link."""
    band = F.floor(F.log("n") / math.log(100 / percent))
    uni = classes.select("cid", "n", F.posexplode("uni").alias("u", "x")).select("cid", "u", band.alias("band"), "n", F.col("x.p").alias("p"), F.size("x.keys").alias("total"), F.col("x.keys").alias("keys"), F.col("x.rest").alias("rest"))
    repeated = []
    for r in range(PASSES):
        postings = uni.select("cid", "u", F.explode(F.filter("keys", lambda k: F.pmod(k, F.lit(PASSES)) == r)).alias("key"))  # noqa: B023
        frequent = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        repeated.append(postings.join(frequent, "key").select("cid", "u", "df", "key"))
    repeated = scratch.table(*repeated)
    shared = repeated.groupBy("cid", "u").agg(F.collect_list(F.struct("df", "key")).alias("shared"))
    known = uni.drop("keys").join(shared, ["cid", "u"], "left")
    lowest = F.expr("slice(array_sort(coalesce(shared, array())), 1, greatest(0, p - (total - coalesce(size(shared), 0))))")
    prefixes = known.withColumn("keys", F.concat(F.transform(lowest, lambda x: x["key"]), F.col("rest"))).where(F.size("keys") > 0).select("cid", "u", "band", "n", "keys")
    prefixes = scratch.table(prefixes)
    scratch.drop(repeated)
    group = prefixes.groupBy("n", F.xxhash64("keys").alias("h"), F.hash("keys").alias("h2")).agg(F.min("cid").alias("gid"))
    member = prefixes.select("cid", "n", F.xxhash64("keys").alias("h"), F.hash("keys").alias("h2")).join(group, ["n", "h", "h2"])
    grouped = member.where("cid != gid").select(F.col("cid").alias("a"), F.col("gid").alias("b"))
    heads = prefixes.join(group.select(F.col("gid").alias("cid"), "n", "h", "h2"), "cid").where((F.xxhash64("keys") == F.col("h")) & (F.hash("keys") == F.col("h2")))
    lists = heads.select("cid", "band", F.explode("keys").alias("key"))
    low = lists.groupBy("key", "band").agg(F.min("cid").alias("low"), F.max("cid").alias("high"))
    star = lists.join(low.where("low != high"), ["key", "band"]).where("cid != low").select(F.col("cid").alias("a"), F.col("low").alias("b"))
    above = low.select("key", (F.col("band") - 1).alias("band"), F.col("low").alias("b"))
    step = low.join(above, ["key", "band"]).select(F.col("low").alias("a"), "b")
    return grouped.unionByName(star).unionByName(step)


def _units(members: DataFrame) -> DataFrame:
    """``(cid, unit, part, side)``: where each candidate class is compared. ``part`` separates what a unit holds by component."""
    weight = F.count(F.lit(1)) / TILE_SETS + F.sum("n") / TILE_SHINGLES
    whole = members.groupBy("component").agg(weight.alias("weight"), F.count(F.lit(1)).alias("m"))
    bands = members.groupBy("component", "band").agg(F.ceil(weight).alias("tiles"))
    small = members.join(whole.where("weight <= 1"), "component").select("cid", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(1 << 40)).cast("string")).alias("unit"), F.col("component").alias("part"), F.lit(0).alias("side"))
    large = members.join(whole.where("weight > 1").select("component"), "component")
    near = lambda by, name: bands.select("component", (F.col("band") + by).alias("band"), F.col("tiles").alias(name))
    large = large.join(near(0, "own"), ["component", "band"]).join(near(-1, "after"), ["component", "band"], "left").join(near(1, "before"), ["component", "band"], "left")
    large = large.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("own")).cast("int"))
    name = lambda kind, b, i, j: F.concat_ws(":", F.lit(kind), "component", b, i, j)
    tile, last = F.col("tile"), lambda c: F.col(c).cast("int") - 1
    same = F.transform(F.sequence(F.lit(0), last("own")), lambda j: F.struct(name("t", F.col("band"), F.least(tile, j), F.greatest(tile, j)).alias("unit"), F.when(tile > j, 1).otherwise(0).alias("side")))
    up = F.when(F.col("after").isNotNull(), F.transform(F.sequence(F.lit(0), last("after")), lambda j: F.struct(name("x", F.col("band"), tile, j).alias("unit"), F.lit(0).alias("side"))))
    down = F.when(F.col("before").isNotNull(), F.transform(F.sequence(F.lit(0), last("before")), lambda i: F.struct(name("x", F.col("band") - 1, i, tile).alias("unit"), F.lit(1).alias("side"))))
    empty = F.array().cast("array<struct<unit:string,side:int>>")
    spread = large.select("cid", F.explode(F.concat(same, F.coalesce(up, empty), F.coalesce(down, empty))).alias("x")).select("cid", "x.unit", F.lit(0).cast("long").alias("part"), "x.side")
    return small.unionByName(spread)


def jaccard_components(spark: SparkSession, docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, links of Jaccard >= percent/100 at ``size``-word shingles."""
    scratch = Scratch(spark, "jaccard")
    kind = "doc_id long, n int, sig binary, uni array<struct<p:int,keys:array<bigint>,rest:array<bigint>>>"
    wide = scratch.table(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(_sets(size, percent), kind))
    parts = [wide.where("n > 0").where(F.pmod(F.xxhash64("sig"), F.lit(PASSES)) == r).dropDuplicates(["sig"]) for r in range(PASSES)]
    ordered = scratch.table(*[part.withColumn("cid", F.monotonically_increasing_id() * PASSES + r) for r, part in enumerate(parts)])
    rows = scratch.table(wide.drop("uni"))
    scratch.drop(wide)
    edges = scratch.table(_candidate_edges(scratch, ordered, percent).where("a != b").distinct())
    classes = scratch.table(ordered.drop("uni"))
    scratch.drop(ordered)
    member = connected_components(spark, edges).withColumnRenamed("node", "cid")
    members = scratch.table(member.join(classes.select("cid", "doc_id", "sig", "n", F.floor(F.log("n") / math.log(100 / percent)).alias("band")), "cid"))
    count = members.count()
    wanted = members.select("cid", F.col("doc_id").alias("rep"), "sig")
    if count <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(wanted, F.col("_id").eqNullSafe(F.col("rep"))).select("cid", "text", "sig")
    sets = scratch.table(texts.mapInPandas(_full_sets(size), "cid long, s binary").dropDuplicates(["cid"]))
    lots = max(1, count // 1000)
    unit = F.when(F.col("unit").startswith("s"), F.concat(F.lit("s"), F.pmod(F.xxhash64("unit"), F.lit(lots)).cast("string"))).otherwise(F.col("unit"))
    units = _units(members.select("cid", "component", "band", "n")).withColumn("unit", unit)
    links = scratch.table(units.join(sets, "cid").groupBy("unit").applyInPandas(_verify(percent), "a long, b long"))
    linked = connected_components(spark, links).withColumnRenamed("node", "cid")
    lowest = rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"))
    named = lowest.join(classes.select("sig", "cid"), "sig").join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    tops = named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = named.join(tops, "component").select("sig", "component_id")
    return rows.join(by_class, "sig", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
