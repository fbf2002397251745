"""Folding billing events into user tiers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import is_uuid
from engram.functions.tiers import blank_to_null, is_tier
from engram.operators.writes import insert_once
from engram.plans.intervals import stabbing_min
from engram.plans.ordered import arrival_numbers, next_in_key
from engram.session import checkpoint
from engram.sources.tables import billing_fields

# The event types that have an effect.
SUBSCRIPTION_CHANGED = ("customer.subscription.created", "customer.subscription.updated")
SUBSCRIPTION_DELETED = "customer.subscription.deleted"
CUSTOMER_CREATED = "customer.created"

@dataclass
class BillingResult:
    users: DataFrame
    processed: DataFrame
    rejects: DataFrame
    effects: DataFrame


def lookup_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Add ``new_tier`` from ``price_id``; unmapped or missing prices give null."""
    named = prices.select("price_id", blank_to_null(F.col("tier")).alias("new_tier"))
    return events.join(named, "price_id", "left")


def fold(
    users: DataFrame,
    inbox: DataFrame,
    events: DataFrame,
    prices: DataFrame,
    as_of,
) -> BillingResult:
    """Apply new billing events in arrival order (received_at, id).

    Each event id is applied once: ids already in ``inbox`` and repeats in
    ``events`` are dropped. The user of a subscription event is the one bound to
    its customer id at that moment; if several are, the least user id. Events
    that cannot be applied (malformed user id in a binding, price mapped to no real
    tier) are rejects and stay unprocessed; all others are processed.
    """
    # effects and the processed table must agree on which delivery counts
    fresh = checkpoint(insert_once(inbox, events))
    fields = billing_fields(F.col("payload"))
    # parsed once into a narrow table; ordering reads it several times
    parsed = checkpoint(fresh.select("id", "event_type", "received_at", *[c.alias(n) for n, c in fields.items()]))
    ordered = arrival_numbers(parsed, [F.col("received_at"), F.col("id")], "n")
    priced = lookup_prices(ordered, prices)

    changed, deleted = F.col("event_type").isin(*SUBSCRIPTION_CHANGED), F.col("event_type") == SUBSCRIPTION_DELETED
    tier = F.when(deleted, F.lit("free")).when(changed, F.col("new_tier"))
    subscription = priced.select("n", "id", "customer_id", tier.alias("tier")).where(
        F.col("tier").isNotNull() & F.col("customer_id").isNotNull()
    )
    # narrow, and read by several steps below
    subscription = checkpoint(subscription)
    # only bindings are joined to users, so the many events without a user id never meet on a null key
    binding = (F.col("event_type") == CUSTOMER_CREATED) & (F.col("app_user_id") != "")
    known = users.select(F.col("id").alias("app_user_id"), F.lit(True).alias("known"))
    bindings = checkpoint(ordered.where(binding).select("n", "id", "app_user_id", "object_id").join(known, "app_user_id", "left"))

    # Customer bindings as intervals of the arrival order: a user's customer id
    # holds until the user's next binding.
    starts = users.where(F.col("stripe_customer_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("stripe_customer_id").alias("customer_id"), F.lit(0).cast("bigint").alias("start")
    )
    bound = bindings.where("known").select(
        F.col("app_user_id").alias("user_id"), F.col("object_id").alias("customer_id"), F.col("n").alias("start")
    )
    upper = (ordered.agg(F.max("n")).first()[0] or 0) + 1
    intervals = next_in_key(starts.unionByName(bound), "user_id", "start", "stop")
    intervals = checkpoint(intervals.withColumn("stop", F.coalesce("stop", F.lit(upper))))
    owners = stabbing_min(subscription, intervals, "customer_id", "n", "n", "user_id", upper)

    # users, rejects and processed events all follow from these
    effects = checkpoint(subscription.join(owners, "n").select("n", "id", "user_id", "tier", "n_bound"))
    bad_tier = effects.where(~is_tier(F.col("tier"))).select("id", F.lit("invalid_tier").alias("error_code"))
    # a well-formed id of no user binds nothing and is done; a malformed one can never be applied
    malformed = F.col("known").isNull() & ~is_uuid(F.col("app_user_id"))
    unbound = bindings.where(malformed).select("id", F.lit("invalid_app_user_id").alias("error_code"))
    rejects = bad_tier.unionByName(unbound)
    effects = effects.where(is_tier(F.col("tier")))

    last_tier = effects.groupBy("user_id").agg(F.max(F.struct("n", "tier"))["tier"].alias("new_tier"))
    last_customer = bound.groupBy("user_id").agg(F.max(F.struct("start", "customer_id"))["customer_id"].alias("new_customer"))
    folded = (
        users.withColumnRenamed("id", "user_id")
        .join(last_tier, "user_id", "left")
        .join(last_customer, "user_id", "left")
        .withColumn("tier", F.coalesce("new_tier", "tier"))
        .withColumn("stripe_customer_id", F.coalesce("new_customer", "stripe_customer_id"))
        .withColumnRenamed("user_id", "id")
        .select(*users.columns)
    )
    processed = (
        fresh.join(rejects.select("id"), "id", "left_anti")
        .withColumn("processed_at", F.lit(as_of).cast("timestamp"))
        .select(*events.columns)
    )
    return BillingResult(folded, processed, rejects, effects)


def ambiguous_customers(users: DataFrame) -> DataFrame:
    """Customer ids bound to more than one user."""
    bound = users.where(F.col("stripe_customer_id").isNotNull())
    return bound.groupBy("stripe_customer_id").agg(F.count("*").alias("n_users")).where("n_users > 1")


def unprocessed(inbox: DataFrame) -> DataFrame:
    """Events waiting in the inbox, oldest first."""
    return inbox.where(F.col("processed_at").isNull()).orderBy("received_at", "id")


def set_tiers(users: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Direct subscription messages seq, user_id, tier (B6): (users, rejects).

    The last valid message of a user wins; unknown users are ignored.
    """
    valid = is_tier(F.col("tier"))
    rejects = messages.where(~valid).withColumn("error_code", F.lit("invalid_tier"))
    last = messages.where(valid).groupBy("user_id").agg(F.max(F.struct("seq", "tier"))["tier"].alias("new_tier"))
    updated = users.join(last.withColumnRenamed("user_id", "id"), "id", "left").withColumn(
        "tier", F.coalesce("new_tier", "tier")
    )
    return updated.select(*users.columns), rejects
