import random

import pytest
from pyspark.sql import functions as F

from engram.operators import paging
from engram.session import new_dir
from engram.sources.pages import PageDirectory

SCHEMA = "id string, user_id string, namespace string, content string, created_at timestamp, updated_at timestamp"


@pytest.fixture(scope="module")
def memories(spark):
    rng = random.Random(1)
    # a third of all rows are one scope; times collide, so ids decide
    rows = [(f"{i:04d}", "hot" if i % 3 == 0 else f"u{i % 5}", "n" if i % 3 == 0 else f"n{i % 2}", f"text {i}", rng.randrange(60), rng.randrange(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, user_id string, namespace string, content string, c int, u int")
    return df.select("id", "user_id", "namespace", "content", F.timestamp_seconds("c").alias("created_at"), F.timestamp_seconds("u").alias("updated_at")).cache()


@pytest.fixture(scope="module")
def pages(spark, memories):
    made = PageDirectory(spark, new_dir(spark, "pages"))
    made.build(memories, block=16, part_rows=200)
    return made


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_offset_pages(spark, memories, pages):
    rng = random.Random(2)
    asked = [
        (i, rng.choice(["hot", "u0", "u1", "nobody"]), rng.choice(["n", "n0", "n1", None]), rng.choice([1, 5, 40]), rng.choice([0, 3, 15, 16, 100, 10_000]), rng.choice(["created_at", "updated_at", "other"]))
        for i in range(80)
    ]
    requests = spark.createDataFrame(asked, "request_id int, user_id string, namespace string, k int, offset int, order string")
    columns = ["request_id", "rank", "id", "content", "namespace", "created_at", "updated_at"]
    wanted = rows_of(paging.list_pages(memories, requests), *columns)
    assert len(wanted) > 100 and rows_of(pages.list_pages(requests), *columns) == wanted


def test_cursor_pages(spark, memories, pages):
    rng = random.Random(3)
    known = memories.select("id", "created_at").collect()
    asked = []
    for i in range(80):
        row = rng.choice(known)
        # some cursors name a row of another scope, or none
        cursor = rng.choice([(None, None), (row.created_at, row.id), (row.created_at, "~gone"), (row.created_at, "")])
        asked.append((i, rng.choice(["hot", "u0", "u2", "nobody"]), rng.choice(["n", "n0", "", None]), rng.choice([1, 7, 50]), *cursor))
    requests = spark.createDataFrame(asked, "request_id int, user_id string, namespace string, k int, cursor_created_at timestamp, cursor_id string")
    columns = ["request_id", "rank", "id", "content", "created_at", "has_more", "next_id"]
    key = lambda rows: [tuple("" if v is None else v for v in r) for r in rows]
    wanted = sorted(key(tuple(r[c] for c in columns) for r in paging.keyset_pages(memories, requests).collect()))
    got = sorted(key(tuple(r[c] for c in columns) for r in pages.keyset_pages(requests).collect()))
    assert len(wanted) > 200 and got == wanted


def test_a_page_reads_only_its_blocks(spark, pages):
    one = spark.createDataFrame([(1, "hot", "n", 5, 100)], "request_id int, user_id string, namespace string, k int, offset int")
    opened = []
    real = PageDirectory._open

    def count(self, name, wanted):
        rows = real(self, name, wanted)
        opened.append((name, rows.count(), rows._jdf.queryExecution().executedPlan().toString()))
        return rows

    PageDirectory._open = count
    try:
        assert [r.id for r in pages.list_pages(one).orderBy("rank").collect()]
        cursor = spark.createDataFrame([(1, "hot", "n", 5, None, None)], "request_id int, user_id string, namespace string, k int, cursor_created_at timestamp, cursor_id string")
        assert pages.keyset_pages(cursor).count() == 5
    finally:
        PageDirectory._open = real
    # a block of 16 and the k rows that may reach into the next
    assert opened and all(n <= 2 * 16 for _, n, _ in opened)
    assert all("PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] for _, _, plan in opened)


def test_empty(spark, memories):
    none = PageDirectory(spark, new_dir(spark, "pages"))
    none.build(memories.limit(0))
    requests = spark.createDataFrame([(1, "hot", "n", 5, None, None)], "request_id int, user_id string, namespace string, k int, cursor_created_at timestamp, cursor_id string")
    assert none.list_pages(requests).count() == 0 and none.keyset_pages(requests).count() == 0
