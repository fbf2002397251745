import datetime
import json
import random
import time

import pytest

from engram.operators.billing import fold
from engram.operators.ratelimit import replay
from engram.operators.usage import usage_windows
from engram.plans.keyed_log import KeyedLog
from engram.schemas import BILLING_EVENTS, USAGE_EVENTS, USERS
from engram.sources.tables import read_billing_inbox, read_table, stream_billing_inbox, usage_of
from engram.streaming import pending, sinks
from engram.streaming.ratelimit import rate_limit_stream

START = datetime.datetime(2024, 1, 1)
AS_OF = "2025-01-01 00:00:00"


def test_rate_limit_over_micro_batches(spark, tmp_path):
    schema = "key string, tier string, ts_ms bigint, seq bigint"
    calls = [("k" + str(i % 3), "free", i * 400, i) for i in range(300)]
    out, ckpt, src = str(tmp_path / "out"), str(tmp_path / "ckpt"), str(tmp_path / "in")
    for part in range(3):  # each availableNow run continues from the state of the last
        spark.createDataFrame(calls[part * 100 : part * 100 + 100], schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        sinks.write_table(rate_limit_stream(stream), out, ckpt, once=True).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).select("seq", "allowed", "remaining", "retry_after").collect()))
    want = replay(spark.createDataFrame(calls, schema)).select("seq", "allowed", "remaining", "retry_after")
    assert got == sorted(map(tuple, want.collect()))


def test_idle_ttl_on_a_live_stream(spark, tmp_path):
    schema = "key string, tier string, ts_ms bigint, seq bigint"
    src, out = str(tmp_path / "in"), tmp_path / "out"
    spark.createDataFrame([("k", "free", 0, i) for i in range(12)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    query = sinks.write_table(rate_limit_stream(stream, idle_ttl_seconds=600), str(out), str(tmp_path / "ckpt"))
    try:
        deadline = time.time() + 60
        while not (out / "batch=0" / "_SUCCESS").exists() and time.time() < deadline and query.isActive:
            time.sleep(0.2)
    finally:
        query.stop()
    assert spark.read.parquet(str(out / "batch=0")).where("allowed").count() == 10


def usage_rows(spark, moments):
    rows = [(str(i), "u", "k", str(i), "recall", 1, 5, True, None, m) for i, m in enumerate(moments)]
    return spark.createDataFrame(rows, USAGE_EVENTS)


def test_usage_windows_drop_late_rows(spark, tmp_path):
    minutes = [0, 1, 61, 62, 180]
    src, out, ckpt = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")

    def feed(values):
        usage_rows(spark, [START + datetime.timedelta(minutes=m) for m in values]).write.mode("append").parquet(src)
        stream = spark.readStream.schema(USAGE_EVENTS).parquet(src)
        sinks.write_usage_windows(stream, out, ckpt, "1 hour", "10 minutes", once=True).awaitTermination()

    feed(minutes)
    feed([5])  # its window is final
    rows = {r.window_start.hour: r.calls for r in spark.read.parquet(out).collect()}
    assert rows == {0: 2, 1: 2}
    whole = usage_windows(read_table(spark, "usage_events", src), "1 hour").collect()
    assert {r.window_start.hour: r.calls for r in whole} == {0: 3, 1: 2, 3: 1}
    newest = usage_of(read_table(spark, "usage_events", src), "user_id", "u", until=START + datetime.timedelta(minutes=62))
    assert [r.occurred_at.minute for r in newest.collect()] == [1, 5, 1, 0]


def test_usage_sink(spark, tmp_path):
    src, out = str(tmp_path / "in"), tmp_path / "out"
    usage_rows(spark, [START]).write.parquet(src)
    stream = spark.readStream.schema(USAGE_EVENTS).parquet(src)
    sinks.write_usage(stream, str(out), str(tmp_path / "c1"), once=True).awaitTermination()
    assert spark.read.parquet(str(out)).count() == 1
    (tmp_path / "file").write_text("x")
    problems = []
    query = sinks.write_usage(stream, str(tmp_path / "file" / "in"), str(tmp_path / "c2"), problems.append, once=True)
    query.awaitTermination()
    assert query.exception() is None and len(problems) == 1
    # the same with a dead-letter table, replayed until the way is free
    dead, late = str(tmp_path / "dead"), str(tmp_path / "late")
    query = sinks.write_usage(stream, str(tmp_path / "file" / "in"), str(tmp_path / "c3"), problems.append, once=True, dead_letters=dead)
    query.awaitTermination()
    assert query.exception() is None and len(problems) == 2
    with pytest.raises(Exception):  # noqa: B017
        sinks.replay_usage(spark, dead, str(tmp_path / "file" / "in"))
    assert sinks.replay_usage(spark, dead, late) == [0] and sinks.replay_usage(spark, dead, late) == []
    assert spark.read.parquet(late).count() == 1 and sinks.replay_usage(spark, str(tmp_path / "none"), late) == []


def subscription(id_, kind, customer, price, at):
    payload = {"data": {"object": {"customer": customer, "items": {"data": [{"price": {"id": price}}]}}}}
    return (id_, "customer.subscription." + kind, START + datetime.timedelta(seconds=at), None, json.dumps(payload))


def test_billing_stream_applies_each_event_once(spark, tmp_path):
    src, ckpt = str(tmp_path / "in"), str(tmp_path / "ckpt")
    users = spark.createDataFrame([("u", "a@b.c", "free", "c1", START), ("v", "d@e.f", "free", "c2", START)], USERS)
    prices = spark.createDataFrame([("p", "pro"), ("t", "team"), ("bad", "gold")], "price_id string, tier string")
    tables = sinks.BillingTables(spark, str(tmp_path / "tables"))
    tables.begin(users)

    def deliver(events):
        spark.createDataFrame(events, BILLING_EVENTS).write.mode("append").json(src)
        query = sinks.apply_billing(stream_billing_inbox(spark, src), tables, prices, AS_OF, ckpt, once=True)
        query.awaitTermination()
        last = query.lastProgress["batchId"]
        return last, {r.id: r.tier for r in tables.users(last).collect()}

    first = [subscription("a", "created", "c1", "p", 1), subscription("a", "created", "c1", "p", 1), subscription("x", "created", "c2", "bad", 2)]
    assert deliver(first)[1] == {"u": "pro", "v": "free"}
    assert deliver([subscription("b", "deleted", "c1", "p", 3)])[1] == {"u": "free", "v": "free"}
    # a is delivered again and changes nothing; c is new
    last, tiers = deliver([subscription("a", "created", "c1", "p", 1), subscription("c", "updated", "c2", "t", 4)])
    assert tiers == {"u": "free", "v": "team"}
    assert {r.id for r in tables.processed().collect()} == {"a", "b", "c"}
    # running the last batch again leaves the same tables
    again = spark.createDataFrame([subscription("c", "updated", "c2", "t", 4)], BILLING_EVENTS)
    tables.apply(again, last, prices, AS_OF)
    assert {r.id: r.tier for r in tables.users(last).collect()} == tiers
    assert read_billing_inbox(spark, src).count() == 6


def test_tokens_on_a_stream(spark, tmp_path):
    until = START + datetime.timedelta(minutes=5)
    previews = spark.createDataFrame(
        [("t1", "u", ["a", "b"], START, until), ("t2", "u", ["c"], START, until)],
        "token string, user_id string, memory_ids array<string>, at timestamp, expires_at timestamp",
    )

    def at(seconds):
        return START + datetime.timedelta(seconds=seconds)

    tries = [("t1", "v", 1, at(1)), ("t1", "u", 2, at(2)), ("t1", "u", 3, at(3)), ("t2", "u", 4, at(300)), ("zz", "u", 5, at(1))]
    confirms = spark.createDataFrame(tries, "token string, user_id string, seq bigint, at timestamp")
    events, src, out = pending.token_events(previews, confirms), str(tmp_path / "in"), str(tmp_path / "out")
    for wanted in ("expires_at is not null", "expires_at is null"):
        events.where(wanted).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        decided = pending.confirm_stream(stream, live=False)
        sinks.write_table(decided, out, str(tmp_path / "ckpt"), once=True).awaitTermination()
    rows = {r.seq: (r.status, r.memory_ids) for r in spark.read.parquet(out).collect()}
    assert rows == {
        1: ("rejected", None), 2: ("deleted", ["a", "b"]), 3: ("rejected", None), 4: ("rejected", None), 5: ("rejected", None)
    }


def billing_tables(spark, path, n_users=40, bucket_rows=10):
    users = spark.createDataFrame([(f"u{i}", f"{i}@b.c", "free", f"c{i}", START) for i in range(n_users)], USERS)
    tables = sinks.BillingTables(spark, str(path), bucket_rows)
    tables.begin(users)
    return tables


def bind(id_, user, customer, at):
    payload = json.dumps({"data": {"object": {"id": customer, "metadata": {"app_user_id": user}}}})
    return (id_, "customer.created", START + datetime.timedelta(seconds=at), None, payload)


def test_billing_log_equals_one_fold(spark, tmp_path):
    rng = random.Random(8)
    prices = spark.createDataFrame([("p", "pro"), ("t", "team"), ("f", "free"), ("bad", "gold")], "price_id string, tier string")
    tables = billing_tables(spark, tmp_path)
    users = tables.users(-1)
    events, at = [], 0
    for batch in range(6):
        new = []
        for i in range(rng.randrange(3, 9)):
            at += 1
            if rng.random() < 0.3:
                new.append(bind(f"e{at}", f"u{rng.randrange(45)}", f"c{rng.randrange(40)}", at))
            else:
                new.append(subscription(f"e{at}", rng.choice(["created", "updated", "deleted"]), f"c{rng.randrange(42)}", rng.choice(["p", "t", "f", "bad", "zz"]), at))
        # deliveries that come again; a rejected one would be judged anew, by the bindings of then
        new += rng.sample([e for e in events if '"bad"' not in e[4]], 2 if batch else 0)
        tables.apply(spark.createDataFrame(new, BILLING_EVENTS), batch, prices, AS_OF)
        events += new
    none = spark.createDataFrame([], BILLING_EVENTS)
    whole = fold(users, none, spark.createDataFrame(events, BILLING_EVENTS), prices, AS_OF)
    assert sorted(tables.users(5).collect()) == sorted(whole.users.collect())
    assert {r.id for r in tables.processed().collect()} == {r.id for r in whole.processed.collect()}
    live = tables.runs(5)
    # merged by size: fewer runs than batches, and a second level
    assert all(len(runs) < 6 for runs in live.values()) and any(run.level == 1 for run in live["processed"])


def test_killed_billing_batch_starts_again(spark, tmp_path, monkeypatch):
    prices = spark.createDataFrame([("p", "pro"), ("t", "team")], "price_id string, tier string")
    tables = billing_tables(spark, tmp_path)
    batch = lambda i: spark.createDataFrame([subscription(f"e{i}", "created", f"c{i}", "p", 10 * i), bind(f"b{i}", f"u{i}", f"x{i}", 10 * i + 1)], BILLING_EVENTS)
    for i in range(3):
        tables.apply(batch(i), i, prices, AS_OF)
    before = sorted(tables.users(2).collect())
    for name in ("write", "_commit"):
        owner = KeyedLog if name == "write" else sinks.BillingTables
        kept, calls = getattr(owner, name), []

        def stop(self, *args, kept=kept, calls=calls, **more):
            calls.append(args)
            if len(calls) == (3 if kept.__name__ == "write" else 1):
                raise RuntimeError("killed")
            return kept(self, *args, **more)

        monkeypatch.setattr(owner, name, stop)
        with pytest.raises(RuntimeError, match="killed"):
            tables.apply(batch(3), 3, prices, AS_OF)
        monkeypatch.setattr(owner, name, kept)
        assert sorted(tables.users(2).collect()) == before
    tables.apply(batch(3), 3, prices, AS_OF)
    once = sorted(tables.users(3).collect())
    tables.apply(batch(3), 3, prices, AS_OF)
    assert sorted(tables.users(3).collect()) == once
    assert {r.id: r.tier for r in once if r.tier == "pro"} == {f"u{i}": "pro" for i in range(4)}
    assert {r.id for r in tables.processed().collect()} == {f"{k}{i}" for k in "eb" for i in range(4)}


def test_billing_batch_reads_only_its_buckets(spark, tmp_path):
    tables = billing_tables(spark, tmp_path, n_users=200)
    runs = tables.runs(-1)
    assert runs["users"][0].buckets == 32
    events = spark.createDataFrame([subscription("e", "created", "c7", "p", 1)], BILLING_EVENTS)
    found = tables._concerned(runs, events)
    assert [r.id for r in found.collect()] == ["u7"]
    log = tables.logs["users"]
    read = log.lookup(runs["users"], spark.createDataFrame([("u7",)], "id string"))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "(bucket#" in plan.split("PartitionFilters")[1][:120]
    # a batch writes what its own events change
    tables.apply(events, 0, spark.createDataFrame([("p", "pro")], "price_id string, tier string"), AS_OF)
    assert {name: [run.rows for run in live if run.seq == 0] for name, live in tables.runs(0).items()} == {"users": [1], "bindings": [1], "processed": [1]}


def test_event_time_frees_tokens_without_confirms(spark, tmp_path):
    def at(seconds):
        return START + datetime.timedelta(seconds=seconds)

    previews = spark.createDataFrame(
        [(f"t{i}", "u", ["a"], at(i), at(i + 60)) for i in range(20)], "token string, user_id string, memory_ids array<string>, at timestamp, expires_at timestamp"
    )
    confirms = spark.createDataFrame([("t3", "u", 1, at(30)), ("t4", "u", 2, at(500))], "token string, user_id string, seq bigint, at timestamp")
    events, src, out = pending.token_events(previews, confirms), str(tmp_path / "in"), str(tmp_path / "out")
    held = []
    for wanted in ("expires_at is not null", "seq = 1", "seq = 2"):
        events.where(wanted).write.mode("append").parquet(src)
        stream = spark.readStream.schema(events.schema).parquet(src)
        query = sinks.write_table(pending.confirm_by_event_time(stream), out, str(tmp_path / "ckpt"), once=True)
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = {r.seq: (r.status, r.memory_ids) for r in spark.read.parquet(out).collect()}
    assert rows == {1: ("deleted", ["a"]), 2: ("rejected", None)}
    # all are held until the last event moves the clock past every expiry
    assert held[0] >= 20 and held[-1] == 0
