import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.vector import VECTOR
from engram.operators import forget, tenancy, usage, writes
from engram.plans import skew
from engram.sources.sinks import append_memories, append_usage, write_clustered
from engram.sources.tables import read_table

AS_OF = "2025-01-01 00:00:00"
MEMORY = (
    "id string, user_id string, namespace string, content string, metadata string, embedding array<float>,"
    " content_hash string, created_at timestamp, updated_at timestamp"
)


def digest(text):
    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()


def memory(id_, user, space, content, at=0):
    moment = datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)
    return (id_, user, space, content, "{}", [1.0, 0.0], digest(content), moment, moment)


def table(spark, rows):
    return spark.createDataFrame(rows, MEMORY)


def serve_one_by_one(stored, requests):
    """The service's rule on one request after the other."""
    held, counts, out = {}, {}, {}
    for id_, user, space, content, *_ in stored:
        held.setdefault((user, space, digest(content)), id_)
        counts[user] = counts.get(user, 0) + 1
    for seq, user, tier, space, content in sorted(requests):
        key = (user, space, digest(content))
        if key in held:
            out[seq] = ("deduped", held[key])
        elif tier == "free" and counts.get(user, 0) >= 100:
            out[seq] = ("rejected", None)
        else:
            held[key] = f"new{seq}"
            counts[user] = counts.get(user, 0) + 1
            out[seq] = ("stored", held[key])
    return out


@pytest.mark.parametrize("seed,hot_rows", [(1, None), (2, 20)])
def test_remember_equals_serving_one_by_one(spark, monkeypatch, seed, hot_rows):
    if hot_rows:  # take the salted path for many keys
        monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rnd = random.Random(seed)
    stored = [memory(f"s{i}", f"u{i % 4}", "n", f"text {i}", i) for i in range(250)]
    stored += [memory(f"d{i}", "u1", "n", "text 5", 900 + i) for i in range(3)]
    stored += [memory(f"full{i}", "full", "n", f"old {i}", i) for i in range(110)]
    requests = []
    for seq in range(3000):
        user = rnd.choice(["hot"] * 3 + ["full"] + [f"u{i}" for i in range(4)])
        text = f"  text\t{rnd.randrange(400)} " if rnd.random() < 0.9 else "spam"
        requests.append((seq, user, rnd.choice(["free"] * 4 + ["pro", "starter"]), rnd.choice(["n", "m"]), text))
    df = spark.createDataFrame(requests, "seq bigint, user_id string, tier string, namespace string, content string")
    inserted, outcomes = writes.remember(table(spark, stored), df.repartition(7), AS_OF, writes.mock_embedder(4))
    rows, wanted = outcomes.collect(), serve_one_by_one(stored, requests)
    assert {r.seq: r.status for r in rows} == {seq: status for seq, (status, _) in wanted.items()}
    # ids of stored rows are hashes: map them to the serial names
    names = {r.id: f"new{r.seq}" for r in rows if r.status == "stored"}
    assert {r.seq: names.get(r.id, r.id) for r in rows} == {seq: id_ for seq, (_, id_) in wanted.items()}
    assert all(r.error_code == ("limit_exceeded" if r.status == "rejected" else None) for r in rows)
    new = inserted.collect()
    assert sorted(r.id for r in new) == sorted(names)
    assert all(r.content == " ".join(r.content.split()) and len(r.embedding) == 4 and r.metadata == "{}" for r in new)


def test_quota_edge(spark):
    stored = [memory(f"s{i}", "u", "n", f"text {i}") for i in range(99)]
    df = spark.createDataFrame([(i, "u", "free", f"fresh {i}") for i in range(200)], "seq bigint, user_id string, tier string, content string")
    counts = {r.status: r["count"] for r in writes.remember(table(spark, stored), df, AS_OF)[1].groupBy("status").count().collect()}
    assert counts == {"stored": 1, "rejected": 199}
    none = table(spark, [])
    counts = {r.status: r["count"] for r in writes.remember(none, df, AS_OF)[1].groupBy("status").count().collect()}
    assert counts == {"stored": 100, "rejected": 100}


def test_only_accepted_rows_are_embedded(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(df):
        def count(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf.assign(embedding=[[0.0]] * len(pdf))

        return df.mapInPandas(count, T.StructType([*df.schema.fields, T.StructField("embedding", VECTOR)]))

    stored = table(spark, [memory("s", "u", "default", "known")])
    df = spark.createDataFrame(
        [(1, "u", "free", "known"), (2, "u", "free", "new"), (3, "u", "free", " new ")], "seq bigint, user_id string, tier string, content string"
    )
    inserted, _ = writes.remember(stored, df, AS_OF, embed)
    assert [r.content for r in inserted.collect()] == ["new"]
    assert seen.value == 1


def update_frame(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, user_id string, id string, content string, metadata string")


def test_update(spark):
    stored = table(
        spark, [memory("a", "u", "n", "one"), memory("b", "u", "n", "two"), memory("c", "u", "m", "three"), memory("d", "v", "n", "four")]
    )
    requests = [
        (1, "u", "a", " new  text ", None),
        (2, "u", "b", "one", '{"x":1}'),  # held by a when the batch began: refused with its metadata
        (3, "u", "c", "", None),  # empty text changes nothing
        (4, "u", "d", "mine?", None),  # not the owner
        (5, "u", "b", None, '{"y":2}'),
        (6, "u", "b", "two", None),  # its own text is no duplicate
        (7, "u", "c", "new text", None),  # other namespace
        (8, "u", "b", "new text", None),  # taken by request 1
        (9, "u", "a", "newer", "{}"),
    ]
    new, outcomes = writes.update(stored, update_frame(spark, requests), AS_OF, writes.mock_embedder(2))
    errors = {r.seq: r.error_code for r in outcomes.collect()}
    bad = {2: "validation_error", 4: "not_found", 8: "validation_error"}
    assert errors == {seq: bad.get(seq) for seq in range(1, 10)}
    rows = {r.id: r for r in new.collect()}
    assert {k: r.content for k, r in rows.items()} == {"a": "newer", "b": "two", "c": "new text", "d": "four"}
    assert rows["b"].metadata == '{"y":2}' and rows["a"].metadata == "{}"
    assert rows["a"].content_hash == digest("newer")
    assert str(rows["c"].updated_at) == AS_OF and str(rows["d"].updated_at) != AS_OF
    assert new.columns == stored.columns


def test_update_fields(spark):
    stored = table(spark, [memory("a", "u", "n", "one"), memory("b", "u", "n", "two")])
    schema = "seq bigint, user_id string, id string, content string, metadata string, namespace string, embedding array<float>, content_hash string"
    requests = spark.createDataFrame(
        [
            (1, "u", "a", "x", None, "moved", [0.5, 0.5], None),
            (2, "u", "missing", None, None, None, None, None),
            (3, "v", "b", "stolen", None, None, None, None),
        ],
        schema,
    )
    new, outcomes = writes.update_fields(stored, requests, AS_OF)
    got = {r.seq: (r.updated_fields, r.error_code) for r in outcomes.collect()}
    assert got == {1: (["content", "namespace", "embedding"], None), 2: ([], None), 3: (None, "not_found")}
    rows = {r.id: r for r in new.collect()}
    assert (rows["a"].content, rows["a"].namespace, rows["a"].embedding) == ("x", "moved", [0.5, 0.5])
    assert rows["b"].content == "two"


def test_forget_and_delete(spark):
    stored = table(spark, [memory("a", "u", "n", "one"), memory("b", "u", "n", "two"), memory("c", "v", "n", "x")])
    requests = spark.createDataFrame(
        [(1, "u", "a"), (2, "u", "a"), (3, "u", "c"), (4, "u", "zzz")], "seq bigint, user_id string, id string"
    )
    left, outcomes = writes.forget(stored, requests)
    assert {r.seq: r.status for r in outcomes.collect()} == {1: "deleted", 2: "rejected", 3: "rejected", 4: "rejected"}
    assert {r.id for r in left.collect()} == {"b", "c"}


def test_forget_tokens(spark):
    stored = table(spark, [memory(i, "u", "n", i) for i in "abc"] + [memory("x", "v", "n", "x")])
    moment = datetime.datetime(2025, 1, 1)
    until = moment + datetime.timedelta(minutes=5)
    pending = spark.createDataFrame(
        [("t1", "u", ["a", "gone"], until), ("t2", "u", ["a", "b"], until), ("t3", "u", ["c"], until), ("t4", "u", ["x"], until)],
        "token string, user_id string, memory_ids array<string>, expires_at timestamp",
    )

    def at(seconds):
        return moment + datetime.timedelta(seconds=seconds)

    tries = [
        (1, "v", "t1", at(1)), (2, "u", "t1", at(2)), (3, "u", "t1", at(3)), (4, "u", "t2", at(299)),
        (5, "u", "t3", at(300)), (6, "u", "t3", at(301)), (7, "u", "nope", at(1)), (8, "u", "t4", at(4)),
    ]
    confirms = spark.createDataFrame(tries, "seq bigint, user_id string, token string, at timestamp")
    left, outcomes, still = forget.confirm(stored, pending, confirms)
    got = {r.seq: (r.status, r.deleted_count) for r in outcomes.collect()}
    assert got == {
        1: ("rejected", None), 2: ("deleted", 1), 3: ("rejected", None), 4: ("deleted", 1),
        5: ("rejected", None), 6: ("rejected", None), 7: ("rejected", None), 8: ("deleted", 0),
    }
    messages = {r.seq: r.message for r in outcomes.collect()}
    assert messages[5] == "Confirmation token has expired" and messages[6] == "Invalid or expired confirmation token"
    assert {r.id for r in left.collect()} == {"c", "x"}
    assert still.count() == 0


def test_preview_without_matches(spark):
    stored = table(spark, [memory("a", "u", "n", "one")])
    request = spark.createDataFrame([(1, "u", None, [1.0, 0.0], 1.5)], "request_id int, user_id string, namespace string, query_embedding array<float>, threshold double")
    summaries, matches, pending = forget.preview(stored, request, AS_OF, "salt", 2)
    row = summaries.first()
    assert (row.total_matches, row.confirmation_token, row.expires_at) == (0, "", "")
    assert matches.count() == 0 and pending.count() == 0


def test_delete_users(spark):
    users = spark.createDataFrame([("u",), ("v",), ("w",)], "id string")
    keys = spark.createDataFrame([("k1", "u"), ("k2", "v"), ("k3", "w")], "id string, user_id string")
    events = spark.createDataFrame([("v", "k9"), ("other", "k3")], "user_id string, api_key_id string")
    stored = table(spark, [memory("a", "u", "n", "one"), memory("b", "v", "n", "two")])
    wanted = spark.createDataFrame([("u",), ("v",), ("w",), ("nobody",), ("u",)], "user_id string")
    tables, outcomes = writes.delete_users(users, stored, keys, events, wanted)
    assert {r.user_id: r.status for r in outcomes.collect()} == {
        "u": "deleted", "v": "blocked", "w": "blocked", "nobody": "not_found"
    }
    assert {r.id for r in tables["users"].collect()} == {"v", "w"}
    assert {r.id for r in tables["memories"].collect()} == {"b"}
    assert {r.id for r in tables["api_keys"].collect()} == {"k2", "k3"}


def test_append_and_tenant_check(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "u", "n", "one", None, [1.0], "h"), (2, "v", "n", "two", '{"a":1}', [2.0], "g")],
        "seq bigint, user_id string, namespace string, content string, metadata string, embedding array<float>, content_hash string",
    )
    path = str(tmp_path / "memories")
    ids = {r.id for r in append_memories(rows, path, "batch-1", AS_OF).collect()}
    back = read_table(spark, "memories", path)
    assert {r.id for r in back.collect()} == ids and len(ids) == 2
    assert {r.metadata for r in back.collect()} == {"{}", '{"a":1}'}
    good, bad = tenancy.split_by_tenant(back.withColumn("ctx_user_id", F.lit("u")))
    assert (good.count(), bad.count()) == (1, 1)
    contexts = spark.createDataFrame([("v",), (None,), ("v",)], "user_id string")
    assert [r.user_id for r in tenancy.visible_rows(back, contexts).collect()] == ["v"]
    with pytest.raises(Exception, match="Invalid user ID format: v"):
        tenancy.require_contexts(contexts.where("user_id is not null")).collect()


def test_clustered_layout(spark, tmp_path):
    rows = [memory(f"m{i:04d}", "big" if i % 3 else f"u{i % 9}", "n", f"text {i}", i) for i in range(600)]
    path = str(tmp_path / "memories")
    write_clustered(table(spark, rows), path, 4)
    back = read_table(spark, "memories", path)
    assert back.count() == 600
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    # files hold ranges of users: a small user is in one or two files, the big one in several
    found = files.collect()
    assert sum(r.lo <= "u6" <= r.hi for r in found) <= 2 and sum(r.lo <= "big" <= r.hi for r in found) >= 2


def test_usage_write_failure_is_reported(spark, tmp_path):
    calls = spark.createDataFrame(
        [
            ("r1", "u", "k", "recall", 5, None), ("r2", "u", "k", "recall", 7, "not_found"), ("r3", "u", "k", "recall", 9, None),
            ("r4", "u", "k", "no_such_tool", 1, None),
        ],
        "request_id string, user_id string, api_key_id string, tool_name string, latency_ms int, error_code string",
    ).withColumn("occurred_at", F.lit(AS_OF).cast("timestamp"))
    decisions = spark.createDataFrame([("r1", True), ("r3", False)], "request_id string, allowed boolean")
    events = usage.build_usage_events(calls, decisions)
    got = {r.request_id: (r.tool_name, r.tokens_consumed, r.latency_ms, r.success, r.error_code) for r in events.collect()}
    assert got == {
        "r1": ("recall", 1, 5, True, None),
        "r2": ("recall", 1, 7, False, "not_found"),
        "r3": ("unknown", 0, 0, False, "rate_limited"),
    }
    assert append_usage(events, str(tmp_path / "usage"))
    problems = []
    (tmp_path / "file").write_text("x")
    assert not append_usage(events, str(tmp_path / "file" / "inside"), problems.append)
    assert len(problems) == 1


def test_insert_once_ties_do_not_depend_on_the_order(spark):
    rows = [(i % 5, "2024-01-01", f"payload {i}") for i in range(50)]
    schema = "id int, received_at string, payload string"
    none = spark.createDataFrame([], schema)
    once = lambda part: sorted(map(tuple, writes.insert_once(none, spark.createDataFrame(part, schema).repartition(4)).collect()))
    assert once(rows) == once(rows[::-1]) and len(once(rows)) == 5


def test_insert_once_sorts_in_bounded_parts(spark, monkeypatch):
    """Arrivals are dealt by id first, also those without one; no aggregate sorts a piece of the input as it was read."""
    monkeypatch.setattr(writes, "PART_ROWS", 100)
    schema = "id int, received_at string, payload string"
    rows = [(i % 400 if i % 50 else None, f"2024-01-{1 + i % 28:02d}", f"payload {i}") for i in range(1_000)]
    held = [(i, "2023-01-01", "held") for i in range(0, 400, 3)]
    arrivals, table = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(held, schema)
    got = writes.insert_once(table, arrivals)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 10" in plan.split("RepartitionByExpression")[1].split("\n")[0]
    wanted = {}
    for i, at, text in rows:
        if i is None or i % 3:
            wanted[i] = min(wanted.get(i, at), at)
    assert {r.id: r.received_at for r in got.collect()} == wanted


def test_rows_that_stay_are_not_shuffled(spark):
    """An update and a deletion leave the other rows in the task that read them."""
    rows = spark.range(0, 400, 1, 4).select(
        F.col("id").cast("string").alias("id"), F.lit("u").alias("user_id"), F.lit("n").alias("namespace"), F.concat(F.lit("text "), F.col("id")).alias("content"),
        F.lit("{}").alias("metadata"), F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("embedding"),
        F.sha2(F.concat(F.lit("text "), F.col("id")), 256).alias("content_hash"), F.lit(AS_OF).cast("timestamp").alias("created_at"), F.lit(AS_OF).cast("timestamp").alias("updated_at"),
    )
    asked = update_frame(spark, [(i, "u", str(i * 50), f"new {i}", None) for i in range(8)])
    broadcast_up_to = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for new, left in ((writes.update(rows, asked, AS_OF, writes.mock_embedder(2))[0], 400), (writes.forget(rows, asked)[0], 392)):
            got = new.select("id", "content", F.spark_partition_id().alias("task")).collect()
            assert len(got) == left
            read_by = {}
            for r in got:
                if r.content.startswith("text"):
                    read_by.setdefault(r.task, set()).add(int(r.id) // 100)
            assert len(read_by) == 4 and all(len(x) == 1 for x in read_by.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast_up_to)
