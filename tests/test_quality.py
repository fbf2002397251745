import json

import pytest

from engram.operators import quality

UUID = "3f0c8a52-5d5e-4b8e-9a8b-0d5a3a1c9f10"


def codes(judged):
    return {r.n: (r.error_code, r.message, len(r.issues)) for r in judged.collect()}


def test_remember_rules(spark):
    rows = [
        (1, "ok", None), (2, "", None), (3, None, None), (4, "   ", None), (5, "x" * 50_000, None), (6, "x" * 50_001, None),
        (7, "\U0001f600" * 25_000, None), (8, "\U0001f600" * 25_001, None), (9, "ok", json.dumps({"k": "x" * 4000})),
        (10, "ok", json.dumps({"k": "x" * 5000})), (11, "ok", "[1]"), (12, "ok", "{bad"), (13, "ok", '{"k":"' + "é" * 2045 + '"}'),
    ]
    got = codes(quality.check_remember(spark.createDataFrame(rows, "n int, content string, metadata string")))
    assert {n for n, (code, _, _) in got.items() if code} == {2, 3, 6, 8, 10, 11, 12, 13}
    assert got[10][1] == "Metadata must not exceed 4096 bytes serialized (got 5008 bytes)"
    assert got[6][1] == "Content must not exceed 50000 characters"


def test_recall_rules(spark):
    nine = json.dumps({f"k{i}": 1 for i in range(9)})
    eight = json.dumps({f"k{i}": 1 for i in range(8)})
    rows = [
        (1, "q", 10.0, 0.7, None), (2, "", 10.0, 0.7, None), (3, "q", 0.0, 0.7, None), (4, "q", 51.0, 0.7, None), (5, "q", 2.5, 0.7, None),
        (6, "q", 50.0, 1.0, eight), (7, "q", 1.0, 1.1, nine), (8, "q", None, None, '{"a":null}'), (9, "q", 1.0, 0.0, '{"a":[1]}'),
        (10, "q", 1.0, 0.0, '{"a":1,"b":"x","c":true,"d":1.5}'), (11, "q", 1.0, -0.1, "{}"), (12, "x" * 10_001, 1.0, 0.0, None),
    ]
    df = spark.createDataFrame(rows, "n int, query string, limit double, threshold double, metadata_filter string")
    judged = quality.check_recall(df)
    got = codes(judged)
    assert {n for n, (code, _, _) in got.items() if code} == {2, 3, 4, 5, 7, 8, 9, 11, 12}
    assert got[7][2] == 2
    valid, rejects = quality.split(judged)
    assert valid.count() == 3 and rejects.count() == 9 and "issues" not in valid.columns


def test_list_update_forget_rules(spark):
    rows = [(1, 20.0, 0.0, "created_at"), (2, 101.0, 0.0, None), (3, None, -1.0, None), (4, 1.0, 0.0, "id"), (5, 0.0, 0.5, "updated_at")]
    got = codes(quality.check_list(spark.createDataFrame(rows, "n int, limit double, offset double, order string")))
    assert {n: c for n, (_, _, c) in got.items()} == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}

    rows = [(1, UUID, "x", None), (2, "abc", "x", None), (3, UUID, None, None), (4, UUID, "", None), (5, UUID, None, "{}"), (6, UUID, "x" * 50_001, None)]
    judged = quality.check_update(spark.createDataFrame(rows, "n int, id string, content string, metadata string"))
    assert {n for n, (code, _, _) in codes(judged).items() if code} == {2, 3}
    assert {r.n for r in judged.where("warning is not null").collect()} == {6}

    rows = [
        (1, "by_id", UUID, None, None), (2, "by_id", "x", None, None), (3, "by_query", None, "q", None), (4, "by_query", None, None, "tok"),
        (5, "by_query", None, "q", "tok"), (6, "by_query", None, "", None), (7, "by_query", None, "", "tok"), (8, "other", None, None, None),
    ]
    judged = quality.check_forget(
        spark.createDataFrame(rows, "n int, mode string, id string, query string, confirmation_token string")
    )
    assert {r.n: (r.kind, r.error_code is None) for r in judged.collect()} == {
        1: ("by_id", True), 2: ("by_id", False), 3: ("preview", True), 4: ("confirm", True), 5: ("preview", True),
        6: ("preview", False), 7: ("confirm", True), 8: (None, False),
    }


def test_result_contract(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 1.5), (None, 0.1), ("c", float("nan"))], "id string, similarity double")
    assert quality.check_results(df, ["id"]).count() == 3
    assert quality.require_valid_results(df.limit(1), ["id"]).count() == 1
    with pytest.raises(Exception, match="Output shape validation failed"):
        quality.require_valid_results(df, ["id"]).collect()


def test_integrity_audits(spark):
    users = spark.createDataFrame(
        [("u", "a@b.c", "free"), ("v", "a@b.c", "gold"), ("w", "bad mail", "pro")], "id string, email string, tier string"
    )
    keys = spark.createDataFrame([("k", "u", "h", "free"), ("l", "zz", "h", "pro")], "id string, user_id string, key_hash string, tier string")
    memories = spark.createDataFrame([("m", "u"), ("n", "zz"), ("o", "zz")], "id string, user_id string")
    events = spark.createDataFrame([("e", "u", "k", 1, -5), ("f", "v", "qq", -1, 0)], "id string, user_id string, api_key_id string, tokens_consumed int, latency_ms int")
    inbox = spark.createDataFrame([("x",), ("x",), ("y",)], "id string")
    report = {(r.relation, r.key): r.n for r in quality.fk_audit(users, keys, memories, events).collect()}
    assert report == {("memories.user_id", "zz"): 2, ("api_keys.user_id", "zz"): 1, ("usage_events.api_key_id", "qq"): 1}
    rules = {(r.rule, r.key): r.n for r in quality.constraint_audit(users, keys, events, inbox).collect()}
    assert rules == {
        ("users.tier", "v"): 1, ("users.email", "a@b.c"): 2, ("users.email_shape", "w"): 1, ("api_keys.key_hash", "h"): 2,
        ("usage_events.tokens_consumed", "f"): 1, ("usage_events.latency_ms", "e"): 1, ("stripe_events.id", "x"): 2,
    }
