import corpus_pipeline
from tests.llm.cases import documents, no_documents, prose


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows = [(i, prose(i, 90), "en", "s") for i in range(60)] + [(100, prose(1, 90), "en", "s"), (101, (prose(7, 30).upper() + " ") * 3, "en", "s"), (102, "short", "en", "s")]
    rows = [(*r, len(r[1])) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    bad = [(200 + i, prose(i, 40).upper() + "!! " * 10, "en", "s", 1) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert tuple(kept.columns) == corpus_pipeline.COLUMNS
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(range(60))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids


def test_deduplicate_with_null_and_repeated_ids(spark):
    out = corpus_pipeline.deduplicate(spark, documents(spark), "")
    texts = [r.text for r in out.collect()]
    assert len([t for t in texts if t and t.lower().startswith(documents(spark).first().text[:20])]) == 1
    assert corpus_pipeline.deduplicate(spark, no_documents(spark), "").count() == 0
    assert corpus_pipeline.rules(spark, no_documents(spark), "").count() == 0
    assert corpus_pipeline.pack(spark, no_documents(spark), "").count() == 0


def test_deduplicate_takes_five_words_and_similarity_of_eighty_percent(spark):
    words = prose(21, 200, 4000).split()
    near, far = list(words), list(words)
    near[50:56] = [f"new{i}" for i in range(6)]  # 181 of 211 shingles of five words, 187 of 209 of three words
    near[120] = "other"
    for i in range(10, 200, 18):
        far[i] = "else"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == [1, 3]
