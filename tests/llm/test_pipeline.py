import random

import corpus_pipeline
from engram.llm import decontam, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        seen.append(name)
        if k < 4:
            assert docs.columns == COLUMNS and {r.doc_id for r in rows} <= set(before)
            assert k == 1 or all(r.text == before[r.doc_id].text for r in rows)
            assert all(r.n_chars == len(r.text) for r in rows) or k == 0
        if k == 1:
            assert len(rows) == len(before)
        if k == 2:
            assert all(r.doc_id == r.component_id for r in simhash.near_duplicates(docs).collect())
        if k == 3:
            assert decontam.find_passages(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
        before = {r.doc_id: r for r in rows}
    assert all(r.round_trip for r in rows)
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, rows))
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_near_copies_are_dropped(spark, sf):
    rng = random.Random(4)
    made = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, alone = [], set()
    for i in range(40):
        words = made(240)
        for k, changed in enumerate((0, 1, 2, 4)):
            copy = list(words)
            for at in rng.sample(range(240), changed):
                copy[at] = f"other{i}_{k}_{at}"
            rows.append((10 * i + k, " ".join(copy), "en", "s", 0))
        # half of the words: another text
        rows.append((10 * i + 5, " ".join(words[:120] + made(120)), "en", "s", 0))
        alone |= {10 * i, 10 * i + 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.one_per_group(spark, docs, sf).collect()} == alone


def test_empty_documents(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_odd_documents(spark, sf):
    rows = [(1, None, None, None, None), (None, "a b c", "en", None, 5), (2, "", "en", "s", 0), (3, "x " * 30_000, "en", "s", 60_000), (3, "x " * 30_000, "en", "s", 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    # nulls and empty texts are one group, the repeated rows another
    assert {r.doc_id for r in docs.collect()} == {1, None, 3}
