import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.plans import skew
from engram.session import new_dir
from engram.sources.manifests import Manifests
from engram.sources.vector_store import VectorStore


@pytest.fixture
def counted(spark):
    """An embedder that counts the texts it is sent, and the largest call."""
    sent = spark.sparkContext.accumulator(0)

    def embed(texts):
        sent.add(len(texts))
        assert len(texts) == len(set(texts)) <= 7
        return [np.full(3 if "wide" not in t else 4, len(t), np.float32) for t in texts]

    return sent, embed


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(3)


def run(store, df, embed, **more):
    rows, rejects = store.embed(df, embed, batch_size=7, **more)
    return {r.id: None if r.embedding is None else list(r.embedding) for r in rows.collect()}, {r.id: r.width for r in rejects.collect()}


def test_each_text_is_sent_once(spark, counted):
    sent, embed = counted
    store = VectorStore(spark, new_dir(spark, "vectors"), 3)
    texts = [f"text {i % 40:04d}" for i in range(200)] + [None, "", ""]
    rows, rejects = run(store, frame(spark, texts), embed)
    assert sent.value == 41 and not rejects
    assert rows == {i: None if t is None else [float(len(t))] * 3 for i, t in enumerate(texts)}
    assert run(store, frame(spark, texts), embed)[0] == rows and sent.value == 41
    more = [*texts, "one more", "one more"]
    assert len(run(store, frame(spark, more), embed)[0]) == len(more) and sent.value == 42
    assert store.rows().count() == 42


def test_wrong_widths_are_rejects(spark, counted):
    sent, embed = counted
    store = VectorStore(spark, new_dir(spark, "vectors"), 3)
    df = frame(spark, ["a", "wide b", "wide b", "c", None])
    for calls in (3, 3):
        rows, rejects = run(store, df, embed)
        assert rows == {0: [1.0] * 3, 3: [1.0] * 3, 4: None} and rejects == {1: 4, 2: 4} and sent.value == calls
    run(store, df, embed, retry_rejects=True)
    assert sent.value == 4


def test_runs_are_merged_and_hot_texts_split(spark, counted, monkeypatch):
    sent, embed = counted
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    store = VectorStore(spark, new_dir(spark, "vectors"), 3, bucket_rows=4)
    for i in range(6):
        rows, _ = run(store, frame(spark, ["hot"] * 50 + [f"t{j:02d}" for j in range(3 * i, 3 * i + 5)]), embed)
        assert len(rows) == 55
    texts = {f"t{j:02d}" for j in range(20)} | {"hot"}
    assert sent.value == len(texts) == store.rows().count()
    levels = [r.level for r in store._runs()[1]]
    assert len(levels) < 6 and max(levels) == 1 and max(r.buckets for r in store._runs()[1]) > 1


def test_failed_use_and_second_writer(spark, counted, monkeypatch):
    sent, embed = counted
    path = new_dir(spark, "vectors")
    store, other = VectorStore(spark, path, 3), VectorStore(spark, path, 3)
    df = frame(spark, ["a", "bb"])
    rows, _ = store.embed(df, embed, batch_size=7)
    with pytest.raises(Exception, match="later"):
        rows.select(F.raise_error(F.lit("later"))).collect()
    run(store, df, embed)
    assert sent.value == 2
    # another writer publishes between this one's look and its own manifest
    published = Manifests.publish

    def late(self, version, manifest):
        monkeypatch.undo()
        run(other, frame(spark, ["ccc"]), embed)
        published(self, version, manifest)

    monkeypatch.setattr(Manifests, "publish", late)
    run(store, frame(spark, ["dddd"]), embed)
    assert {r.embedding[0] for r in store.rows().collect()} == {1.0, 2.0, 3.0, 4.0} and sent.value == 4


def test_empty_frame_and_short_answers(spark, counted):
    sent, embed = counted
    store = VectorStore(spark, new_dir(spark, "vectors"), 3)
    assert run(store, frame(spark, [""]).limit(0), embed) == ({}, {}) and sent.value == 0 and store.rows().count() == 0
    with pytest.raises(Exception, match="0 vectors for 1 texts"):
        store.embed(frame(spark, ["x"]), lambda texts: [])
    assert store.rows().count() == 0
