"""API-key inventory jobs (J1, P6, R11, K1-K4). Secrets are never made here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.tiers import blank_to_null, effective_tier, is_tier, tier_rank
from engram.schemas import API_KEYS


def key_tiers(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Active keys with their user's existence checked and the effective tier."""
    owners = users.select(F.col("id").alias("user_id"), F.col("tier").alias("user_tier"))
    active = keys.where(F.col("revoked_at").isNull()).select(F.col("id").alias("key_id"), "user_id", "tier")
    return active.join(owners, "user_id").select(
        "key_id", "user_id", effective_tier(F.col("tier"), F.col("user_tier")).alias("tier")
    )


def list_keys(keys: DataFrame, user_id: str | None = None, include_revoked: bool = False) -> DataFrame:
    """Keys of a user (or of all), newest first, never the hash."""
    rows = keys if user_id is None else keys.where(F.col("user_id") == user_id)
    columns = ["id", "label", "tier", "last_used_at", "created_at"]
    if include_revoked:
        columns.append("revoked_at")
    else:
        rows = rows.where(F.col("revoked_at").isNull())
    if user_id is None:
        return rows.select("user_id", *columns)
    return rows.select(*columns).orderBy(F.col("created_at").desc(), F.col("id").desc())


def issue(keys: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """New keys (K1): (rows to append, outcomes).

    ``requests``: seq, auth_key_id, auth_tier, user_id, new_id, key_hash,
    key_prefix, label, tier. An unknown tier is refused (400), as is one above
    the authenticating key's tier (403); no tier means that key's own.
    """
    own = keys.select(F.col("id").alias("auth_key_id"), F.col("tier").alias("own_tier"))
    asked = requests.withColumn("asked_tier", blank_to_null(F.col("tier"))).drop("tier")
    asked = asked.join(own, "auth_key_id", "left")
    tier = F.coalesce("asked_tier", blank_to_null(F.col("own_tier")), F.lit("free"))
    ceiling = F.coalesce(blank_to_null(F.col("auth_tier")), F.lit("free"))
    code = F.when(F.col("asked_tier").isNotNull() & ~is_tier(F.col("asked_tier")), 400).when(
        tier_rank(tier) > tier_rank(ceiling), 403
    )
    judged = asked.withColumn("tier", tier).withColumn("code", F.coalesce(code, F.lit(200)))
    added = judged.where(F.col("code") == 200).select(
        F.col("new_id").alias("id"),
        "user_id",
        "key_hash",
        "key_prefix",
        blank_to_null(F.col("label")).alias("label"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.lit(None).cast("timestamp").alias("revoked_at"),
        F.lit(as_of).cast("timestamp").alias("created_at"),
        "tier",
    )
    return added, judged.select("seq", "code", F.when(F.col("code") == 200, F.col("new_id")).alias("id"))


def revoke(keys: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Revoke own active keys (K2): (keys table, outcomes).

    ``requests``: seq, user_id, auth_key_id, id. The key in use is refused (409);
    a key that is not own, not active or revoked earlier in the batch is 404.
    """
    own = keys.where(F.col("revoked_at").isNull()).select("id", "user_id", F.lit(True).alias("active"))
    asked = requests.join(own, ["id", "user_id"], "left")
    asked = asked.withColumn("in_use", F.coalesce(F.col("id") == F.col("auth_key_id"), F.lit(False)))
    able = asked.where(F.col("active") & ~F.col("in_use"))
    first = able.groupBy("id").agg(F.min("seq").alias("seq"))
    done = first.select("seq", F.lit(True).alias("done"))
    code = F.when(F.col("in_use"), 409).when(F.col("done"), 204).otherwise(404)
    outcomes = asked.join(done, "seq", "left").select("seq", "id", code.alias("code"))
    gone = first.select("id", F.lit(as_of).cast("timestamp").alias("new_revoked_at"))
    table = keys.join(gone, "id", "left").withColumn("revoked_at", F.coalesce("revoked_at", "new_revoked_at"))
    return table.select(*keys.columns), outcomes


def rotate(keys: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Replace own keys by copies with a new secret (K3): (keys table, outcomes).

    ``requests``: seq, user_id, id, new_id, key_hash, key_prefix. The key in use
    and an already revoked key may be rotated; each rotation revokes the old key
    at ``as_of``.
    """
    old = keys.select("id", "user_id", "label", "tier", F.lit(True).alias("own"))
    asked = requests.join(old, ["id", "user_id"], "left")
    good = asked.where("own")
    moment = F.lit(as_of).cast("timestamp")
    added = good.select(
        F.col("new_id").alias("id"),
        "user_id",
        "key_hash",
        "key_prefix",
        "label",
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.lit(None).cast("timestamp").alias("revoked_at"),
        moment.alias("created_at"),
        "tier",
    )
    gone = good.select("id").distinct().withColumn("rotated_at", moment)
    revoked = keys.join(gone, "id", "left").withColumn("revoked_at", F.coalesce("rotated_at", "revoked_at"))
    outcomes = asked.select(
        "seq", "id", F.when(F.col("own"), 200).otherwise(404).alias("code"), F.when(F.col("own"), F.col("new_id")).alias("new_id")
    )
    return revoked.select(*API_KEYS.names).unionByName(added), outcomes


def touch_keys(keys: DataFrame, authentications: DataFrame) -> DataFrame:
    """Set last_used_at to the last full authentication of each key (K4).

    ``authentications``: api_key_id, at. Times are reduced per key before the join.
    """
    last = authentications.groupBy(F.col("api_key_id").alias("id")).agg(F.max("at").alias("used"))
    table = keys.join(last, "id", "left").withColumn("last_used_at", F.greatest("last_used_at", "used"))
    return table.select(*keys.columns)
