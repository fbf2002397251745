import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from engram.operators import billing, keys
from engram.plans import skew
from engram.schemas import API_KEYS, BILLING_EVENTS, USERS

AS_OF = "2025-01-01 00:00:00"
START = datetime.datetime(2024, 1, 1)
PRICES = {"p_free": "free", "p_pro": "pro", "p_team": "team", "p_bad": "gold", "p_blank": ""}
KINDS = {"new": "customer.subscription.created", "change": "customer.subscription.updated", "end": "customer.subscription.deleted"}


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def event(id_, kind, seconds, obj):
    payload = json.dumps({"id": id_, "type": kind, "data": {"object": obj}})
    return (id_, kind, START + datetime.timedelta(seconds=seconds), None, payload)


def random_events(rnd, n):
    out = []
    for i in range(n):
        customer = f"cus{rnd.randrange(6)}"
        kind = rnd.choice(["new", "change", "end", "bind", "bind", "other"])
        at = rnd.randrange(200)
        if kind == "bind":
            who = rnd.choice([uid(rnd.randrange(5)), uid(rnd.randrange(5)), uid(99), "not-an-id", "", None])
            obj = {"id": customer, "metadata": {} if who is None else {"app_user_id": who}}
            out.append(event(f"e{i:04d}", "customer.created", at, obj))
        elif kind == "other":
            out.append(event(f"e{i:04d}", "invoice.paid", at, {"customer": customer}))
        else:
            price = rnd.choice([*PRICES, "p_unknown", None])
            items = {"data": [] if price is None else [{"price": {"id": price}}]}
            out.append(event(f"e{i:04d}", KINDS[kind], at, {"customer": customer, "items": items}))
    return out


def serve(users, events, seen):
    """One event after the other, in order of (received_at, id)."""
    tiers, bound = {u: t for u, t, _ in users}, {u: c for u, _, c in users}
    processed, rejected = set(), set()
    for id_, kind, _, _, payload in sorted(events, key=lambda e: (e[2], e[0])):
        if id_ in seen or id_ in processed or id_ in rejected:
            continue
        obj = json.loads(payload)["data"]["object"]
        if kind == "customer.created":
            who = obj["metadata"].get("app_user_id")
            if who == "not-an-id":
                rejected.add(id_)
                continue
            if who in bound:
                bound[who] = obj["id"]
        elif kind in KINDS.values():
            data = obj["items"]["data"]
            new = "free" if kind == KINDS["end"] else PRICES.get(data[0]["price"]["id"]) if data else None
            owners = sorted(u for u, c in bound.items() if c == obj["customer"])
            if new and owners:
                if new == "gold":
                    rejected.add(id_)
                    continue
                tiers[owners[0]] = new
        processed.add(id_)
    return tiers, bound, processed, rejected


def frames(spark, users, events):
    u = spark.createDataFrame([(i, f"{i}@x.y", t, c, START) for i, t, c in users], USERS)
    return u, spark.createDataFrame(events, BILLING_EVENTS), spark.createDataFrame(list(PRICES.items()), "price_id string, tier string")


@pytest.mark.parametrize("seed,hot_rows", [(1, None), (2, None), (3, 20)])
def test_fold_equals_serving_one_by_one(spark, monkeypatch, seed, hot_rows):
    if hot_rows:
        monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)
    rnd = random.Random(seed)
    users = [(uid(i), "free", rnd.choice([None, "cus0", "cus1"])) for i in range(5)]
    events = random_events(rnd, 400)
    u, e, prices = frames(spark, users, events + rnd.sample(events, 50))
    seen = {x[0] for x in rnd.sample(events, 40)}
    inbox = e.where(F.col("id").isin(*seen)).dropDuplicates(["id"])
    result = billing.fold(u, inbox, e.repartition(5), prices, AS_OF)
    tiers, bound, processed, rejected = serve(users, events, seen)
    rows = result.users.collect()
    assert {r.id: r.tier for r in rows} == tiers
    assert {r.id: r.stripe_customer_id for r in rows} == bound
    assert {r.id for r in result.processed.collect()} == processed
    assert {r.id for r in result.rejects.collect()} == rejected
    assert result.processed.where("processed_at is null").count() == 0


def test_event_before_its_binding_is_lost(spark):
    users = [(uid(1), "free", None)]
    sub = {"customer": "c", "items": {"data": [{"price": {"id": "p_pro"}}]}}
    bind = {"id": "c", "metadata": {"app_user_id": uid(1)}}
    early = [event("a", KINDS["new"], 1, sub), event("b", "customer.created", 2, bind)]
    u, e, prices = frames(spark, users, early)
    empty = e.where("false")
    first = billing.fold(u, empty, e, prices, AS_OF)
    assert first.users.first().tier == "free" and first.processed.count() == 2
    again = billing.fold(first.users, first.processed, e, prices, AS_OF)
    assert again.processed.count() == 0
    late = spark.createDataFrame([event("z", KINDS["change"], 3, sub)], BILLING_EVENTS)
    assert billing.fold(first.users, first.processed, late, prices, AS_OF).users.first().tier == "pro"


def test_small_billing_jobs(spark):
    users = [(uid(1), "free", "c"), (uid(2), "pro", "c"), (uid(3), "pro", None)]
    u, _, _ = frames(spark, users, [])
    assert [(r.stripe_customer_id, r.n_users) for r in billing.ambiguous_customers(u).collect()] == [("c", 2)]
    messages = spark.createDataFrame(
        [(1, uid(1), "team"), (2, uid(1), "starter"), (3, uid(2), "gold"), (4, uid(9), "pro")], "seq int, user_id string, tier string"
    )
    new, rejects = billing.set_tiers(u, messages)
    assert {r.id: r.tier for r in new.collect()} == {uid(1): "starter", uid(2): "pro", uid(3): "pro"}
    assert [r.seq for r in rejects.collect()] == [3]


KEY_ROWS = [
    ("k1", "u", "h1", "p", "one", None, None, START, "pro"),
    ("k2", "u", "h2", "p", "two", None, START, START + datetime.timedelta(days=1), "free"),
    ("k3", "u", "h3", "p", None, None, None, START + datetime.timedelta(days=2), ""),
    ("k4", "v", "h4", "p", "four", None, None, START, "team"),
    ("k5", "ghost", "h5", "p", "five", None, None, START, "team"),
]


def test_key_listing_and_tiers(spark):
    table = spark.createDataFrame(KEY_ROWS, API_KEYS)
    users = spark.createDataFrame([("u", "starter"), ("v", "free")], "id string, tier string")
    assert {r.key_id: r.tier for r in keys.key_tiers(table, users).collect()} == {"k1": "pro", "k3": "starter", "k4": "team"}
    listed = keys.list_keys(table, "u")
    assert [r.id for r in listed.collect()] == ["k3", "k1"]
    assert listed.columns == ["id", "label", "tier", "last_used_at", "created_at"]
    everything = keys.list_keys(table, "u", include_revoked=True)
    assert [r.id for r in everything.collect()] == ["k3", "k2", "k1"] and "revoked_at" in everything.columns


def test_issue_revoke_rotate(spark):
    table = spark.createDataFrame(KEY_ROWS, API_KEYS)
    schema = "seq int, auth_key_id string, auth_tier string, user_id string, new_id string, key_hash string, key_prefix string, label string, tier string"
    asked = [
        (1, "k1", "pro", "u", "n1", "h", "p", "x", "team"), (2, "k1", "pro", "u", "n2", "h", "p", "", "starter"),
        (3, "k1", "pro", "u", "n3", "h", "p", None, None), (4, "k1", "pro", "u", "n4", "h", "p", None, "gold"),
        (5, "k3", None, "u", "n5", "h", "p", None, None),
    ]
    added, outcomes = keys.issue(table, spark.createDataFrame(asked, schema), AS_OF)
    assert {r.seq: r.code for r in outcomes.collect()} == {1: 403, 2: 200, 3: 200, 4: 400, 5: 200}
    assert {r.id: (r.tier, r.label) for r in added.collect()} == {"n2": ("starter", None), "n3": ("pro", None), "n5": ("free", None)}

    revokes = spark.createDataFrame(
        [(1, "u", "k1", "k1"), (2, "u", "k1", "k3"), (3, "u", "k1", "k3"), (4, "u", "k1", "k2"), (5, "u", "k1", "k4")],
        "seq int, user_id string, auth_key_id string, id string",
    )
    after, outcomes = keys.revoke(table, revokes, AS_OF)
    assert {r.seq: r.code for r in outcomes.collect()} == {1: 409, 2: 204, 3: 404, 4: 404, 5: 404}
    assert {r.id for r in after.where("revoked_at is null").collect()} == {"k1", "k4", "k5"}

    rotations = spark.createDataFrame(
        [(1, "u", "k1", "r1", "h", "p"), (2, "u", "k2", "r2", "h", "p"), (3, "u", "k4", "r3", "h", "p")],
        "seq int, user_id string, id string, new_id string, key_hash string, key_prefix string",
    )
    after, outcomes = keys.rotate(table, rotations, AS_OF)
    assert {r.seq: r.code for r in outcomes.collect()} == {1: 200, 2: 200, 3: 404}
    rows = {r.id: r for r in after.collect()}
    assert str(rows["k1"].revoked_at) == AS_OF and str(rows["k2"].revoked_at) == AS_OF and rows["k4"].revoked_at is None
    assert (rows["r1"].tier, rows["r1"].label, rows["r1"].user_id) == ("pro", "one", "u") and len(rows) == 7


def test_touch_keys(spark):
    table = spark.createDataFrame(KEY_ROWS, API_KEYS)
    at = [START + datetime.timedelta(hours=h) for h in (1, 5, 3)]
    seen = spark.createDataFrame([("k1", t) for t in at] + [("zz", at[0])], "api_key_id string, at timestamp")
    rows = {r.id: r.last_used_at for r in keys.touch_keys(table, seen).collect()}
    assert rows["k1"] == at[1] and rows["k4"] is None
