import datetime
import random

import pytest
from pyspark.sql import functions as F

from engram.functions.tiers import TIER_BUCKETS, Bucket
from engram.operators import paging, ratelimit, usage
from engram.plans import intervals, skew
from engram.plans.intervals import stabbing_min
from engram.plans.ordered import arrival_numbers, next_in_key, numbered
from engram.plans.skew import hot_keys, salted_lookup

START = datetime.datetime(2024, 1, 1)


def test_salted_lookup_keeps_all_rows(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(1000)], "id int, key string")
    facts = spark.createDataFrame([("hot", 1)] + [(f"k{i}", 2) for i in range(5)], "key string, v int")
    hot = hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", hot_rows=100)
    assert [r.key for r in hot.collect()] == ["hot"]
    got = salted_lookup(rows, facts, ["key"], hot, ["id"]).orderBy("id").collect()
    want = rows.join(facts, "key", "left").orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == [(r.id, r.v) for r in want]


def test_numbered(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if rnd.random() < 0.6 else f"g{rnd.randrange(9)}", rnd.randrange(60), rnd.random() < 0.8) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, g string, t int, counts boolean")
    got = {r.id: r.position for r in numbered(df, ["g"], [F.col("t"), F.col("id")], F.col("counts")).collect()}
    seen, want = {}, {}
    for i, g, _, counts in sorted(rows, key=lambda r: (r[2], r[0])):
        seen[g] = seen.get(g, 0) + counts
        want[i] = seen[g]
    assert got == want
    numbers = arrival_numbers(df, [F.col("t"), F.col("id")], "n").orderBy("n").collect()
    assert [r.id for r in numbers] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert [r.n for r in numbers] == list(range(1, 901))


@pytest.mark.parametrize("chunk", [3, 1000])
def test_next_in_key(spark, chunk):
    rnd = random.Random(4)
    rows = sorted({(rnd.choice("aab"), rnd.randrange(200)) for _ in range(120)})
    df = spark.createDataFrame(rows, "k string, n bigint")
    got = {(r.k, r.n): r.nxt for r in next_in_key(df, "k", "n", "nxt", chunk).collect()}
    want = {}
    for k, n in rows:
        later = [m for j, m in rows if j == k and m > n]
        want[(k, n)] = min(later) if later else None
    assert got == want


@pytest.mark.parametrize("upper", [5, 300, 5000])
def test_stabbing_min(spark, upper):
    rnd = random.Random(upper)
    intervals = []
    for _ in range(150):
        a, b = rnd.randrange(upper + 1), rnd.randrange(upper + 2)
        intervals.append((rnd.choice("xxy"), a, b, f"u{rnd.randrange(30):02d}"))
    points = [(i, rnd.choice("xxyz"), rnd.randrange(upper + 1)) for i in range(300)]
    p = spark.createDataFrame(points, "pid bigint, k string, at bigint")
    s = spark.createDataFrame(intervals, "k string, start bigint, stop bigint, u string")
    got = {r.pid: (r.u, r.n_bound) for r in stabbing_min(p, s, "k", "pid", "at", "u", upper).collect()}
    want = {}
    for i, k, at in points:
        held = [u for j, a, b, u in intervals if j == k and a <= at < b]
        if held:
            want[i] = (min(held), len(held))
    assert got == want


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_stabbing_min_writes_blocks_of_crowded_keys_only(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(intervals, "FEW", 5)
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    held, blocks = [("few", 0, 900, "b"), ("few", 10, 1000, "a"), ("few", 5, 5, "0"), (None, 0, 1000, "n")], []
    held += [("many", i, 1000 - i, f"u{i}") for i in range(9)]
    s = spark.createDataFrame(held, "k string, start bigint, stop bigint, u string")
    p = spark.createDataFrame([(i, k, at) for i, (k, at) in enumerate((k, at) for k in ("few", "many", None) for at in range(0, 1000, 7))], "pid bigint, k string, at bigint")
    whole = intervals._by_blocks
    monkeypatch.setattr(intervals, "_by_blocks", lambda points, rows, *rest: blocks.extend(rows.select("k").collect()) or whole(points, rows, *rest))
    got = {r.pid: (r.u, r.n_bound) for r in stabbing_min(p, s, "k", "pid", "at", "u", 1000).collect()}
    want = {}
    for r in p.collect():
        over = [u for k, a, b, u in held if k is not None and k == r.k and a <= r.at < b]
        if over:
            want[r.pid] = (min(over), len(over))
    assert got == want
    # one row per interval of the crowded key; those of the other keys are never written as blocks
    assert [r.k for r in blocks] == ["many"] * 9


def serve_calls(calls, buckets):
    units, held, out = ratelimit.Units.of(buckets), {}, {}
    for key, tier, ts, seq in sorted(calls, key=lambda c: (c[0], c[2], c[3])):
        tier = tier if tier in buckets else "free"
        if key in held:
            level, last = held[key]
            level = min(units.capacity[tier], level + (ts - last) * units.gain[tier])
        else:
            level = units.capacity[tier]
        allowed = level >= units.token
        level -= units.token if allowed else 0
        held[key] = (level, ts)
        out[seq] = (allowed, level // units.token if allowed else 0)
    return out


CALLS = "key string, tier string, ts_ms bigint, seq bigint"


@pytest.mark.parametrize(
    "mean,buckets",
    [(20, TIER_BUCKETS), (900, TIER_BUCKETS), (5900, TIER_BUCKETS), (400, {"free": Bucket(2, 2, 7000), "pro": Bucket(5, 3, 4000)}),
     (2000, {"free": Bucket(1, 1, 2500)})],
)
def test_replay_of_a_hot_key_over_many_parts(spark, mean, buckets):
    rnd, t, calls = random.Random(mean), 0, []
    for i in range(2500):
        t += int(rnd.expovariate(1 / mean)) if rnd.random() < 0.95 else rnd.choice([0, 0, 60_000])
        calls.append(("hot", rnd.choice(["free"] * 5 + ["pro", "?"]) if mean == 900 else "free", t, i))
    calls += [(f"k{rnd.randrange(30)}", rnd.choice(list(buckets)), rnd.randrange(10**6), i) for i in range(2500, 3200)]
    rnd.shuffle(calls)
    got = {r.seq: (r.allowed, r.remaining) for r in ratelimit.replay(spark.createDataFrame(calls, CALLS), buckets, 13).collect()}
    assert got == serve_calls(calls, buckets)


def test_bucket_cases(spark):
    def run(times, tier="free"):
        df = spark.createDataFrame([("k", tier, t, i) for i, t in enumerate(times)], CALLS)
        return ratelimit.replay(df).orderBy("seq").collect()

    rows = run([0] * 11 + [6000, 6000])
    assert [r.allowed for r in rows] == [True] * 10 + [False, True, False]
    assert rows[0].remaining == 9 and rows[10].remaining == 0 and rows[10].retry_after == 6 and rows[0].retry_after is None
    assert [r.allowed for r in run([0] + [3_600_000] * 11)] == [True] * 11 + [False]
    rows = run([0] * 61, "starter")
    assert [r.allowed for r in rows] == [True] * 60 + [False] and rows[60].retry_after == 1
    with pytest.raises(ValueError):
        ratelimit.check_idle_ttl({"free": Bucket(2, 2, 86_400_000)})
    ratelimit.check_idle_ttl(TIER_BUCKETS)


def paged(spark):
    rnd = random.Random(8)
    rows = [
        (f"m{i:03d}", "hot" if rnd.random() < 0.6 else "u", rnd.choice("ab"), START + datetime.timedelta(seconds=rnd.randrange(40)),
         START + datetime.timedelta(seconds=rnd.randrange(40)), "t")
        for i in range(300)
    ]
    schema = "id string, user_id string, namespace string, created_at timestamp, updated_at timestamp, content string"
    return rows, spark.createDataFrame(rows, schema)


def test_list_pages(spark):
    rows, m = paged(spark)
    requests, rnd = [], random.Random(1)
    for i in range(40):
        order = rnd.choice(["created_at", "updated_at", "nonsense", None])
        requests.append((i, rnd.choice(["hot", "u", "nobody"]), rnd.choice("ab"), rnd.randrange(1, 9), rnd.choice([0, 3, 50, 500]), order))
    df = spark.createDataFrame(requests, "request_id int, user_id string, namespace string, k int, offset int, order string")
    got = {}
    for r in sorted(paging.list_pages(m, df).collect(), key=lambda r: (r.request_id, r["rank"])):
        got.setdefault(r.request_id, []).append(r.id)
    want = {}
    for i, user, space, k, offset, order in requests:
        col = 4 if order == "updated_at" else 3
        held = sorted((r[col], r[0]) for r in rows if r[1] == user and r[2] == space)
        want[i] = [id_ for _, id_ in held[offset : offset + k]]
    assert got == {i: ids for i, ids in want.items() if ids}
    one = [r.id for r in paging.list_memories(m, "hot", "a", 5, 3).collect()]
    held = sorted((r[3], r[0]) for r in rows if r[1] == "hot" and r[2] == "a")
    assert one == [id_ for _, id_ in held[3:8]]


def test_keyset_pages_walk_everything_once(spark):
    rows, m = paged(spark)
    held = sorted(((r[3], r[0]) for r in rows if r[1] == "hot"), reverse=True)
    cursor, walked = None, []
    for _ in range(3):
        page = paging.list_page_after(m, "hot", None, 40, cursor).orderBy("rank").collect()
        walked += [r.id for r in page]
        assert all(r.has_more for r in page)
        cursor = (page[-1].created_at, page[-1].id)
    assert walked == [id_ for _, id_ in held[:120]]
    schema = "request_id int, user_id string, namespace string, k int, cursor_created_at timestamp, cursor_id string"
    missing = (START + datetime.timedelta(seconds=20), "m0005")
    requests = [(1, "hot", None, 40, None, None), (2, "hot", "", 40, *held[39][::1]), (3, "u", "a", 10, *missing), (4, "hot", None, 1000, *held[5])]
    out = {}
    for r in sorted(paging.keyset_pages(m, spark.createDataFrame(requests, schema)).collect(), key=lambda r: (r.request_id, r["rank"])):
        out.setdefault(r.request_id, []).append(r)
    assert [r.id for r in out[1]] == [id_ for _, id_ in held[:40]] and out[1][-1].next_id == held[39][1]
    assert [r.id for r in out[2]] == [id_ for _, id_ in held[40:80]]
    after = [x for x in sorted(((r[3], r[0]) for r in rows if r[1] == "u" and r[2] == "a"), reverse=True) if x < missing]
    assert [r.id for r in out[3]] == [id_ for _, id_ in after[:10]]
    assert len(out[4]) == len(held) - 6 and not out[4][-1].has_more and out[4][-1].next_id is None


def test_usage_rollup_and_headroom(spark):
    events = spark.createDataFrame(
        [("u", "recall", 1, True, None), ("u", "recall", 1, False, "internal_error"), ("v", "unknown", 0, False, "rate_limited")],
        "user_id string, tool_name string, tokens_consumed int, success boolean, error_code string",
    )
    rows = usage.usage_summary(events, ["user_id"], totals=True).collect()
    got = {r.user_id: (r.calls, r.tokens, r.successes, r.failures, r.rate_limited) for r in rows}
    assert got == {"u": (2, 2, 1, 1, 0), "v": (1, 0, 0, 1, 1), None: (3, 2, 1, 2, 1)}
    memories = spark.createDataFrame([("u",)] * 105 + [("v",)] * 3, "user_id string")
    tiers = spark.createDataFrame([("u", "free"), ("v", "free"), ("v", "pro"), ("w", "free"), ("x", "pro")], "user_id string, tier string")
    assert {r.user_id: r.headroom for r in usage.quota_headroom(memories, tiers).collect()} == {"u": 0, "v": 97, "w": 100}


def test_percentiles(spark):
    import numpy as np

    rnd = random.Random(6)
    values = [(rnd.choice("ab"), int(rnd.expovariate(0.01))) for _ in range(997)] + [("c", 5)]
    df = spark.createDataFrame(values, "tool_name string, latency_ms int")
    for r in usage.latency_percentiles(df).collect():
        own = [v for t, v in values if t == r.tool_name]
        assert r.p50_ms == pytest.approx(np.percentile(own, 50)) and r.p95_ms == pytest.approx(np.percentile(own, 95))
        assert (r.calls, r.max_ms) == (len(own), max(own))
    assert usage.latency_sketch(df).count() == 3


def test_any_number_of_hot_keys(spark):
    rows = spark.range(9000).select(F.col("id"), (F.col("id") % 300).alias("key"))
    facts = spark.range(300).select(F.col("id").alias("key"), (F.col("id") * 2).alias("fact"))
    hot = hot_keys(rows.groupBy("key").agg(F.count("*").alias("n")), ["key"], "n", hot_rows=10)
    assert hot.count() == 300 and {r.splits for r in hot.collect()} == {4}
    got = salted_lookup(rows, facts, ["key"], hot, ["id"])
    assert got.count() == 9000 and got.where("fact <> key * 2 or fact is null").count() == 0
