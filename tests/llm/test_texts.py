import collections
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.llm import license_scan, lm_scoring, packing, piece_sampling, quality_classifier
from folioscope.llm.shingles import words_of
from tests.llm.cases import documents, no_documents, prose


def test_scores_and_base_counts(spark):
    docs = documents(spark)
    got = lm_scoring.score_documents(spark, docs, quality_classifier.held_out(F.col("doc_id"), 7, 2)).collect()
    rows = docs.select("doc_id", "text").collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = collections.Counter(t for r in rows if not held(r.doc_id) for t in [*words_of(r.text), b"\n"])
    n, v = sum(count.values()), len(count)
    want = sorted((r.doc_id if r.doc_id is not None else -1, held(r.doc_id), len(words_of(r.text)) + 1, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in [*words_of(r.text), b"\n"]), 4)) for r in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and math.isfinite(r.score) for r in got)


def test_chunks_hold_each_text_as_places_of_its_words(monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_DOCS", 2)
    texts = ["One two one", None, "two three", "", "three\nthree"]
    batch = pd.DataFrame({"doc_id": range(5), "text": texts, "held_out": [False, False, True, False, False], "cls": 1})
    rows = pd.concat(lm_scoring._chunks(iter([batch[:3], batch[3:]])))
    docs, words = rows[rows["h"].isna()], rows[rows["h"].notna()]
    for row, text in zip(docs.itertuples(), texts, strict=True):
        own = words[words["chunk"] == row.chunk].set_index("place")["word"]
        tokens = [own[i] for i in np.frombuffer(row.ids, np.int32)]
        assert tokens == [*words_of(text), b"\n"] and row.size == len(b" ".join(tokens))
    assert words.groupby("word")["c1"].sum().to_dict() == {b"one": 2, b"two": 1, b"three": 2, b"\n": 4}


def test_model_is_a_distribution_over_words():
    rng = np.random.default_rng(0)
    table = rng.integers(0, 5, (len(lm_scoring.ORDERS), 2 * lm_scoring.SLOTS)).astype(np.float32)
    weights, apm = rng.normal(size=(lm_scoring.GATES, len(lm_scoring.ORDERS) + 1)) * 0.3, rng.uniform(0.1, 0.9, 8 * lm_scoring.APM_CELLS)
    single = [bytes([b]) for b in range(256) if b != 0x20]
    # the first bytes' probabilities: those of one-byte words are of two bytes, so their sum is below one
    total = (10 ** lm_scoring.spelling_log10(single, lm_scoring.stretched(table), weights, apm)).sum()
    assert 0 < total < 1


def test_repetition_and_known_words_score_better(spark):
    rows = [(i, " ".join(w.replace("w", "av"[i % 2]) for w in prose(i, 200, 12).split()), ["en", "fr"][i % 2]) for i in range(60)] + [(1000, "zq zq zq zq " * 40, "en"), (1001, " ".join(f"zq{i}" for i in range(160)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark, docs, F.col("doc_id") >= 50).collect()}
    assert got[1000].score / got[1000].n_tokens > got[1001].score / got[1001].n_tokens
    held = [got[i] for i in range(50, 60)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_nothing(spark):
    assert lm_scoring.score_documents(spark, no_documents(spark), F.lit(False)).count() == 0


def test_classifier_learns_and_holds_out(spark):
    rows = [(i, prose(i, 80) if i % 3 else " ".join(prose(i, 40).upper().split()) + "!! " * 20) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    model = quality_classifier.train(spark, docs, labels)
    got = quality_classifier.score_documents(spark, docs, model).collect()
    fresh = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in fresh) / len(fresh) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)


def test_classifier_on_messy_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    for docs in (documents(spark), no_documents(spark)):
        out = quality_classifier.score_documents(spark, docs, quality_classifier.train(spark, docs, labels))
        assert out.count() == docs.count() and out.where("score is null").count() == 0
    none = quality_classifier.train(spark, documents(spark), labels.where("quality = 7"))
    assert {r.score for r in quality_classifier.score_documents(spark, documents(spark), none).collect()} == {0.5}


def packed(spark, docs, **options):
    rows = packing.pack_documents(spark, docs, **options).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    return rows, by


@pytest.mark.parametrize("window", [16, 64, 2048])
def test_packing_is_lossless_and_gapless(spark, window):
    docs = documents(spark).where("doc_id not in (1, 2)")
    rows, by = packed(spark, docs, window=window, quantum=max(1, window // 16))
    for pieces in by.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) <= window
    want = {r.doc_id: packing.token_ids(r.text, packing.default_paths()) for r in docs.where("doc_id is not null").collect()}
    for doc, ids in want.items():
        own = sorted((r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == doc)
        assert b"".join(x for _, _, x in own) == ids.tobytes() and [s for s, _, _ in own] == np.cumsum([0] + [n for _, n, _ in own])[:-1].tolist()


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark, no_documents(spark)).count() == 0


def test_fast_tokens_equal_the_tokenizers():
    slow, _ = packing.encoders(packing.default_paths())
    for text in [prose(1), "It's 12  days\n\n\tago, naïve – ½ ª …", "<|endoftext|> x", "日本語 ok", "a\u00a0b", "x" * 3000, "don't\r\nI'LL"]:
        assert packing.token_ids(text, packing.default_paths()).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 1]


def test_nnls_fits_and_plans_stay_within_the_histogram():
    a = np.array([[1.0, 0, 1], [0, 1, 1]])
    assert np.allclose(a @ packing.nnls(a, np.array([3.0, 2.0])), [3, 2])
    assert np.allclose(packing.nnls(np.array([[1.0], [-1.0]]), np.array([-1.0, 1.0])), 0)
    for seed in range(5):
        histogram = np.random.default_rng(seed).integers(0, 200, 32).astype(float)
        chosen, repeats = packing.plan_repeats(histogram)
        assert (chosen @ repeats <= histogram).all() and (np.arange(1, 33) @ chosen == 32).all() and repeats.sum() > 0


def test_pieces_are_lossless_and_reproducible(spark):
    docs = documents(spark)
    one = piece_sampling.encode_documents(docs).select("doc_id", "ids", "lossless").collect()
    two = piece_sampling.encode_documents(docs.repartition(3)).select("doc_id", "ids").collect()
    assert all(r.lossless for r in one)
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in one) == sorted((str(r.doc_id), bytes(r.ids)) for r in two)
    back = {r.doc_id: r.text for r in piece_sampling.decode_documents(piece_sampling.encode_documents(docs)).collect() if r.doc_id}
    assert all(back[r.doc_id] == (r.text or "") for r in docs.where("doc_id is not null").collect())
    assert piece_sampling.encode_documents(no_documents(spark)).count() == 0


def test_pieces_are_keyed_by_strings_too(spark):
    text = "several readers considered the translation of ordinary sentences " * 5  # words of many segmentations
    docs = spark.createDataFrame([("a/b", text), ("a/c", text), (None, text), ("", None)], "path string, text string")
    got = piece_sampling.encode_documents(docs, key="path", keep=("path",)).collect()
    assert all(r.lossless for r in got) and len({bytes(r.ids) for r in got}) == 4
    assert sorted(bytes(r.ids) for r in got) == sorted(bytes(r.ids) for r in piece_sampling.encode_documents(docs, key="path", keep=("path",)).collect())


def test_pieces_follow_the_lattice_distribution():
    known, n = piece_sampling.vocabulary(piece_sampling.default_path()), 20_000
    weight = {known.text[i]: (i, w) for _, ids, logs, _ in known.by_length.values() for i, w in zip(ids.tolist(), logs.tolist(), strict=True)}

    def ways(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in weight:
                for rest, w in ways(text[k:]):
                    yield (weight[text[:k]][0], *rest), w + weight[text[:k]][1]

    exact = dict(ways(" theon"))
    z = sum(map(math.exp, exact.values()))
    seen = collections.Counter(tuple(x.tolist()) for x in piece_sampling.encode_batch(list(range(n)), ["theon"] * n, known, 5))
    assert set(seen) <= set(exact) and max(abs(seen[s] / n - math.exp(w) / z) for s, w in exact.items()) < 0.02


def test_licences_and_inheritance(spark):
    body = prose(4, 50)
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", body), ("a/b/y.py", f"{body}\nLicensed under the Apache License, Version 2.0.\n{body}"), ("a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/c/d/z.py", body), ("top.py", body), (None, body), ("e/f.py", None), ("a/b/x.py", body)]
    docs = spark.createDataFrame([(i, p, t, "z") for i, (p, t) in enumerate(rows)], "doc_id int, p string, text string, own string")
    got = {r.doc_id: (r.licence, r.origin) for r in license_scan.scan_licences(spark, docs, F.col("p")).collect()}
    assert got == {0: ("MIT", "own"), 1: ("MIT", "inherited"), 2: ("Apache-2.0", "own"), 3: ("GPL-3.0", "own"), 4: ("GPL-3.0", "inherited"), 5: (None, "none"), 6: (None, "none"), 7: (None, "none"), 8: ("MIT", "inherited")}
    assert license_scan.scan_licences(spark, docs.limit(0), F.col("p")).count() == 0


def plain_cosine(line, template, weight, other):
    """TF-IDF cosine from its definition."""
    a, b = collections.Counter(license_scan.words(line)), collections.Counter(license_scan.words(template))
    w = lambda t: weight.get(t, other)
    dot = sum(a[t] * b[t] * w(t) ** 2 for t in a.keys() & b.keys())
    return dot / math.sqrt(sum((n * w(t)) ** 2 for t, n in a.items()) * sum((n * w(t)) ** 2 for t, n in b.items()))


def test_versions_and_variants_rule_templates_out():
    vocabulary = license_scan._vocabulary(license_scan.TEMPLATES)
    common = {w: 1.5 for w in "the of this is a to under license version public and or in".split()}
    weight = {w: common.get(w, 1.0 if w[0].isdigit() else 6.0) for w in vocabulary}
    matcher = license_scan.Matcher(license_scan.TEMPLATES, weight, 9.0)
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version {} of the License, or\n(at your option) any later version."
    want = {
        "GNU General Public License, version 2": "GPL-2.0", "Licensed under the GNU GPL version 7": None, "SPDX-License-Identifier: GPL-2.0": "GPL-2.0", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: Foo-1.0": None,
        "GNU Lesser General Public License, version 2.1": "LGPL-2.1", "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution 2.5 License.": None, "Released under the BSD License.": None, "CC0 1.0 Universal": "CC0-1.0", "This is free and unencumbered software released into the public domain.": "Unlicense",
        gpl.format(2): "GPL-2.0", gpl.format(3): "GPL-3.0", gpl.format(3).replace("General", "Affero General"): "AGPL-3.0", f"words before\n\n{gpl.format(2)}\n\nwords after": "GPL-2.0", "": None, "mit der Lizenz": None,
        "Released under the MIT License.\nReleased under the MIT License.": "MIT",
    }
    assert {t: matcher.scan(t)[0] for t in want} == want


def test_every_template_finds_its_licence_and_cosines_follow_the_definition():
    vocabulary = license_scan._vocabulary(license_scan.TEMPLATES)
    weight = {w: 1.0 + zlib.crc32(w.encode()) % 700 / 100 for w in vocabulary}
    matcher = license_scan.Matcher(license_scan.TEMPLATES, weight, 9.0)
    assert len(license_scan.TEMPLATES) >= 30
    for name, lines in license_scan.TEMPLATES.items():
        for line in lines:
            found, cosine, share = matcher.scan(line)
            assert (found, share) == (name, 1.0) and abs(cosine - 1) < 1e-6, line
    for line in ("Copyright 2020 Somebody. Licensed under the Apache License, Version 2.0.", "This file is released under the terms of the MIT License", "see the GNU General Public License version 3 for more"):
        fit = [t for lines in license_scan.TEMPLATES.values() for t in lines if {w for w in license_scan.words(t) if w in license_scan.DECISIVE or w[0].isdigit()} <= set(license_scan.words(line))]
        assert abs(matcher.best(collections.Counter(license_scan.words(line)))[0] - max(plain_cosine(line, t, weight, 9.0) for t in fit)) < 1e-6


def test_long_texts_and_ties_of_licences(spark):
    body = "\n".join(prose(i, 400) for i in range(60))
    rows = [("p/a.txt", f"{body}\nReleased under the MIT License.\n{body}"), ("p/b.txt", "Released under the MIT License.\n\nLicensed under the Apache License, Version 2.0."), ("p/c.txt", "x " * 50_000)]
    docs = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id int, p string, text string")
    got = {r.doc_id: (r.own_licence, r.is_licence_file, r.licence) for r in license_scan.scan_licences(spark, docs, F.col("p")).collect()}
    assert got == {0: ("MIT", False, "MIT"), 1: ("Apache-2.0", True, "Apache-2.0"), 2: (None, False, "Apache-2.0")}
