import numpy as np

from folioscope.llm import jaccard_join, pivot_index
from folioscope.llm.shingles import shingle_set
from folioscope.llm.storage import Scratch
from tests.llm.cases import documents, no_documents, prose


def brute_components(sets, ids, percent=90):
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) if sets[i] else ids[i] for i in range(len(sets))]


def check(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    sets = [set(shingle_set(r.text, 3).tolist()) for r in rows]
    want = sorted(((r.doc_id, len(s), c) for r, s, c in zip(rows, sets, brute_components(sets, [r.doc_id for r in rows]), strict=True)), key=str)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(spark, docs).collect()), key=str)
    assert got == want


def test_join_on_messy_table(spark):
    check(spark, documents(spark))


def test_join_of_nothing(spark):
    assert jaccard_join.jaccard_components(spark, no_documents(spark)).count() == 0


def test_join_around_the_threshold(spark):
    rows = []
    for k in range(60):
        words = prose(k % 6, 20 + 15 * (k % 6)).split()
        for j in range(k // 6 % 4):
            words[(7 * j + k) % len(words)] = f"edit{k}"
        rows.append((k, " ".join(words[: len(words) - k % 3])))
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_common_passages_make_no_candidates(spark, monkeypatch):
    common, seen, units = prose(3, 40), [], jaccard_join._units
    own = [" ".join(f"w{k}x{j}" for j in range(70)) for k in range(60)]
    rows = [(k, f"{common} {t}") for k, t in enumerate(own)] + [(100, f"{common} {own[0]} more")]
    monkeypatch.setattr(jaccard_join, "_units", lambda members: seen.append(members.count()) or units(members))
    got = jaccard_join.jaccard_components(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{k: k for k in range(60)}, 100: 0}
    assert seen == [2]


def test_intermediate_tables_free_their_shuffles(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    counts = spark.range(1000, numPartitions=3).selectExpr("id % 7 AS k").groupBy("k").count()
    scratch = Scratch(spark, "freed")
    table = scratch.table(counts, counts.selectExpr("k + 10 AS k", "count"))
    assert shuffled() <= before and sorted(r.k for r in table.collect()) == [*range(7), *range(10, 17)]


def test_large_component_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_SETS", 5)
    base = prose(5, 100).split()
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]] if k % 3 else [*base, f"end{k}"] * 1)) for k in range(60)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_join_at_a_lower_threshold_across_the_orders_of_short_and_long_sets(spark):
    words = prose(11, 400, 4000).split()
    rows = [(k, " ".join(words[k * 110 : k * 110 + n])) for k, n in [(0, 66), (1, 67), (2, 62)]]
    rows += [(10 + k, " ".join(words[k * 110 : k * 110 + n])) for k, n in [(0, 80), (1, 82), (2, 76)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(shingle_set(t, 5).tolist()) for _, t in rows]
    want = dict(zip([i for i, _ in rows], brute_components(sets, [i for i, _ in rows], 80), strict=True))
    assert want[10] == 0 and want[11] == 1 and want[12] == 2
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark, docs, 5, 80).collect()} == want


def test_shingles_split_only_at_ascii_space():
    assert len(shingle_set("a\u00a0b c\u2003d", 3)) == 1
    assert len(shingle_set("A b C d", 3)) == 2 and (shingle_set("A b C", 3) == shingle_set("a B c", 3)).all()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "z") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, row string")


def brute_links(rows, threshold=0.98):
    unit = []
    for _, v, label in rows:
        x = None if v is None or label is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, dtype=np.float32).astype(float)
        unit.append(None if x is None else x / np.linalg.norm(x))
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= threshold]
    return [sum(k in p for p in links) for k in range(len(rows))]


def cluster(seed, n, size=16, spread=0.03):
    r = np.random.default_rng(seed)
    base = r.normal(size=size)
    return [(base + spread * r.normal(size=size)).tolist() for _ in range(n)]


def test_links_match_brute_force(spark):
    rows = [(i, v, i % 2) for i, v in enumerate(sum((cluster(s, 25) for s in range(8)), []))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 0), (903, rows[0][1], None), (904, rows[0][1], 0), (905, [x * 7 for x in rows[0][1]], 0), (906, [None] + [1.0] * 15, 0)]
    got = {r.vec_id: r for r in pivot_index.near_duplicates(spark, vectors(spark, rows)).collect()}
    want = brute_links(rows)
    total, found = sum(want), sum(got[i].n_links for i, _, _ in rows)
    assert len(got) == len(rows) and 0.9 * total <= found <= total
    assert all(got[r[0]].n_links <= w for r, w in zip(rows, want, strict=True))
    assert got[905].component_id == got[904].component_id == 0 and not got[904].kept and got[0].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (900, 901, 902, 903, 906))


def test_hot_list_is_tiled_without_double_counts(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "TILE", 8)
    rows = [(i, v, 1) for i, v in enumerate(cluster(3, 90, spread=0.02))]
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(spark, vectors(spark, rows)).collect()}
    want = brute_links(rows)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * sum(want)


def test_vectors_of_nothing(spark):
    assert pivot_index.near_duplicates(spark, vectors(spark, [])).count() == 0
    assert pivot_index.near_duplicates(spark, vectors(spark, [(1, None, 1), (None, [1.0], 2)])).count() == 2


def test_vectors_of_every_dimension_link_and_rows_of_one_id_share_a_component(spark):
    x = [float((7 * k) % 11 - 5) for k in range(4)]
    far = [1.0, 0.0, -2.0, 5.0]
    rows = [(k, [1.0 + k, k * k - 3.0, 2.0 - k, 1.0], "a") for k in range(100, 130)]
    rows += [(1, x, "b"), (5, x, "b"), (5, far, "b"), (9, far, "b"), (20, [1.0, 2.0, 3.0], "b"), (21, [2.0, 4.0, 6.0], "b"), (22, [3.0], "b"), (23, [7.0], "b"), (24, [-7.0], "b"), (25, [1.0, 2.0, 3.0], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in pivot_index.near_duplicates(spark, table).where("vec_id < 100").collect())
    assert got == [(1, 1, 1, True), (5, 1, 1, False), (5, 1, 1, False), (9, 1, 1, False), (20, 1, 20, True), (21, 1, 20, False), (22, 1, 22, True), (23, 1, 22, False), (24, 0, 24, True), (25, 0, 25, True)]
