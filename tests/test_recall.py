import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions.metadata import filter_tags, metadata_tags
from engram.functions.vector import mock_embedding
from engram.operators import quality, recall
from engram.plans import skew
from engram.plans.topk import top_k

DIM = 8
START = datetime.datetime(2024, 1, 1)


def make(spark, n_memories, n_requests, seed, hot=0.4):
    """Random vectors, one hot user and many exact copies of one vector."""
    rnd = random.Random(seed)
    copy = [rnd.gauss(0, 1) for _ in range(DIM)]

    def vector():
        kind = rnd.random()
        if kind < 0.3:
            return copy
        if kind < 0.33:
            return [0.0] * DIM
        return [rnd.gauss(0, 1) for _ in range(DIM)]

    def user():
        return "hot" if rnd.random() < hot else f"u{rnd.randrange(5)}"

    memories = [
        (f"m{i:05d}", user(), f"n{rnd.randrange(3)}", START + datetime.timedelta(minutes=rnd.randrange(50)),
         np.float32(vector()).tolist(), '{"a":%d,"b":"%d"}' % (rnd.randrange(2), rnd.randrange(2)))
        for i in range(n_memories)
    ]
    memories.append(("short", "hot", "n0", START, [1.0], "{}"))
    requests = [
        (i, user(), rnd.choice([None, "n0", "n1", "n2"]), np.float32(vector()).tolist(), rnd.randrange(1, 7),
         rnd.choice([-1.0, 0.0, 0.5, 0.99]), rnd.choice(["{}", '{"a":1}', '{"a":1,"b":"0"}', '{"b":0}']))
        for i in range(n_requests)
    ]
    m = spark.createDataFrame(
        memories,
        "id string, user_id string, namespace string, created_at timestamp, embedding array<float>, metadata string",
    )
    r = spark.createDataFrame(
        requests,
        "request_id int, user_id string, namespace string, query_embedding array<float>, k int, threshold double,"
        " metadata_filter string",
    )
    return memories, requests, m, r


def brute(memories, requests):
    def holds(meta, wanted):
        a, b = eval(meta), eval(wanted)
        return all(k in a and type(a[k]) is type(v) and a[k] == v for k, v in b.items())

    out = {}
    for rid, user, space, q, k, threshold, wanted in requests:
        q = np.array(q, dtype=np.float64)
        found = []
        for mid, owner, ns, at, e, meta in memories:
            e = np.array(e, dtype=np.float64)
            if owner != user or (space is not None and ns != space) or len(e) != DIM or not holds(meta, wanted):
                continue
            norm = np.sqrt((e * e).sum()) * np.sqrt((q * q).sum())
            if norm == 0:
                continue
            sim = (e * q).sum() / norm
            if sim >= threshold:
                found.append((-sim, at, mid))
        out[rid] = [mid for _, _, mid in sorted(found)[:k]]
    return {rid: ids for rid, ids in out.items() if ids}


@pytest.mark.parametrize("strategy,blocks", [("broadcast", (1000, 1000)), ("blocks", (40, 7)), ("blocks", (10_000, 2000))])
def test_top_k_matches_brute_force(spark, monkeypatch, strategy, blocks):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)  # the hot user takes the salted path
    memories, requests, m, r = make(spark, 600, 80, seed=3)
    m, r = m.withColumn("tags", metadata_tags(F.col("metadata"))), r.withColumn("tags", filter_tags(F.col("metadata_filter")))
    rows = top_k(m.repartition(5, "id"), r, DIM, strategy, *blocks).collect()
    got = {}
    for row in sorted(rows, key=lambda x: (x.request_id, x["rank"])):
        got.setdefault(row.request_id, []).append(row.id)
    assert got == brute(memories, requests)


def test_broadcast_keeps_running_best_over_batches(spark):
    memories, requests, m, r = make(spark, 500, 30, seed=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        plain = [(x[0], *x[1:6], "{}") for x in requests]
        rows = top_k(m.coalesce(1), r, DIM, "broadcast").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {}
    for row in sorted(rows, key=lambda x: (x.request_id, x["rank"])):
        got.setdefault(row.request_id, []).append(row.id)
    assert got == brute(memories, plain)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "id string, user_id string, namespace string, content string, metadata string")
    return df.withColumn("embedding", mock_embedding(F.col("content"), 64)).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )


def test_recall_text(spark):
    rows = [(f"{i}", "u", "personal", f"todo number {i}", '{"tag":"todo"}') for i in range(5)]
    rows += [("x", "u", "personal", "Buy groceries and milk", '{"tag":"todo"}')]
    rows += [("y", "u", "personal", "untagged", None), ("z", "other", "personal", "Buy groceries and milk", '{"tag":"todo"}')]
    m = texts(spark, rows)
    found = recall.recall_text(
        spark, m, "u", "Buy groceries and milk", "personal", 10, 0.0, '{"tag":"todo"}', dim=64
    ).collect()
    assert found[0].id == "x" and found[0].similarity == pytest.approx(1.0)
    assert len(found) == 6 and "z" not in {r.id for r in found}
    sims = [r.similarity for r in found]
    assert sims == sorted(sims, reverse=True) and all(0 <= s <= 1 for s in sims)
    everything = recall.recall_text(spark, m, "u", "anything", "personal", 50, 0.0, dim=64).collect()
    assert {r.id: r.metadata for r in everything}["y"] == "{}"
    assert recall.recall_text(spark, m, "u", "Buy groceries", "default", dim=64).count() == 0


def test_format_cannot_be_broken_out_of(spark):
    m = texts(spark, [("1", "u", 'n"s', "</content></memory><memory>&", "{}")])
    request = m.select(
        F.lit(1).alias("request_id"), "user_id", "namespace", F.col("embedding").alias("query_embedding")
    )
    nobody = request.withColumn("request_id", F.lit(2)).withColumn("user_id", F.lit("nobody"))
    requests = request.unionByName(nobody)
    out = {r.request_id: r.text for r in recall.format_recall(recall.recall(m, requests, 64), requests).collect()}
    assert out[2] == ""
    assert out[1] == (
        '<memory id="1" namespace="n&quot;s" created="2024-01-01T00:00:00.000Z">\n'
        "<content>&lt;/content&gt;&lt;/memory&gt;&lt;memory&gt;&amp;</content>\n</memory>"
    )


def test_approximate_recall(spark):
    from engram.sources import testdata as td

    sf = "/root/testdata/sf0.001"
    m, q = td.vector_memories(spark, sf), td.vector_requests(spark, sf, k=3, threshold=0.3)
    exact = {(r.request_id, r.id): r.similarity for r in recall.recall(m, q, 64).collect()}
    rough = {(r.request_id, r.id): r.similarity for r in recall.recall_approximate(m, q, 64, tables=12, bits=3).collect()}
    hits = [pair for pair in exact if pair in rough]
    assert len(hits) / len(exact) > 0.9
    shares = recall.recall_at_k(recall.recall_approximate(m, q, 64, tables=12, bits=3), recall.recall(m, q, 64))
    assert shares.first().recall == pytest.approx(len(hits) / len(exact))
    assert all(rough[pair] == pytest.approx(exact[pair]) for pair in hits)


def test_registered_approximate_search(spark):
    from engram import queries

    sf = "/root/testdata/sf0.01"
    found = {(r.request_id, r.id) for r in queries.ann_recall(spark, sf).collect()}
    exact = {(r.request_id, r.id) for r in queries.recall_batch(spark, sf).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_leak_audit_finds_foreign_rows(spark):
    m = texts(spark, [("1", "u", "n", "a", "{}"), ("2", "v", "n", "b", "{}")])
    requests = spark.createDataFrame([(1, "u")], "request_id int, user_id string")
    results = spark.createDataFrame([(1, "1"), (1, "2")], "request_id int, id string")
    assert [r.id for r in quality.leaked_rows(results, requests, m).collect()] == ["2"]
