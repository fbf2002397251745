"""Bulk writes as pure functions: (tables, requests) -> (new table, outcomes).

Files hold no row updates, so the caller writes the new table to a new path.
Updates and deletes of one batch are all judged against the table as it was
when the batch began, plus "first request wins" inside the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import content_hash, uuid_from, with_normalized
from engram.functions.vector import mock_embedding
from engram.operators.recall import nearest
from engram.plans.skew import hot_keys, salted_lookup
from engram.schemas import DEFAULT_NAMESPACE, EMBEDDING_DIM, FREE_MEMORY_QUOTA
from engram.session import checkpoint

# arrivals that one task takes; up to this many parts a shuffle writes without gathering its rows in memory
PART_ROWS, MOST_PARTS = 50_000, 200
# arrivals whose ids may be broadcast
FEW_ROWS = 200_000
# changed or deleted ids that may be broadcast to find the rows of a table that stay as they are
FEW_CHANGED = 1_000_000

Embed = Callable[[DataFrame], DataFrame]

_KEY = ["user_id", "namespace", "content_hash"]


def mock_embedder(dim: int = EMBEDDING_DIM) -> Embed:
    """Adds ``embedding`` to a frame with ``content``."""
    return lambda df: df.withColumn("embedding", mock_embedding(F.col("content"), dim))


def earliest_by_hash(memories: DataFrame) -> DataFrame:
    """The earliest memory of each (user, namespace, content_hash)."""
    oldest = F.min(F.struct("created_at", "id"))["id"]
    return memories.groupBy(_KEY).agg(oldest.alias("existing_id"))


def find_by_hash(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """The earliest memory per (user, namespace, content_hash) of ``wanted`` (P10)."""
    keys = wanted.select(_KEY).distinct()
    return earliest_by_hash(memories.join(keys, _KEY, "left_semi"))


def remember(
    memories: DataFrame,
    requests: DataFrame,
    as_of,
    embed: Embed | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Normalise, dedupe and insert under the free-tier quota.

    ``requests``: seq (unique, the order of the batch), user_id, tier, content
    and optionally namespace, metadata. Equal to serving the requests one by
    one. Returns (rows to append, outcomes with seq, status, id, error_code).

    Only narrow columns are grouped, ranked and joined; texts are fetched at
    the end for the accepted requests.
    """
    for name, default in (("namespace", DEFAULT_NAMESPACE), ("metadata", "{}")):
        given = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(given, F.lit(default)))
    hashed = with_normalized(requests, "content", "content").withColumn("content_hash", content_hash(F.col("content")))
    # one pass over the texts; everything up to the accepted rows works on this narrow table
    keyed = checkpoint(hashed.select("seq", "user_id", "tier", "namespace", "content_hash"))
    per_key = keyed.groupBy(_KEY).agg(
        F.min("seq").alias("first_seq"),
        F.min(F.when(F.col("tier").eqNullSafe("free"), None).otherwise(F.col("seq"))).alias("first_paid_seq"),
        F.count("*").alias("n"),
    )
    hot = hot_keys(per_key, _KEY, "n")
    # of the table only the keys and users of the batch are grouped
    per_key = per_key.join(find_by_hash(memories, per_key), _KEY, "left")

    # Only the first 100 new keys of a user can fall inside the quota, so the
    # rank is cut to 100 rows per user before its shuffle.
    new_keys = per_key.where(F.col("existing_id").isNull()).select(*_KEY, "first_seq")
    by_seq = Window.partitionBy("user_id").orderBy("first_seq")
    ranked = new_keys.withColumn("rank", F.row_number().over(by_seq)).where(F.col("rank") <= FREE_MEMORY_QUOTA)
    asking = keyed.select("user_id").distinct()
    stored = memories.join(asking, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n_stored"))
    room = F.lit(FREE_MEMORY_QUOTA) - F.coalesce("n_stored", F.lit(0))
    within = ranked.join(stored, "user_id", "left").where(F.col("rank") <= room)
    within = within.select(*_KEY, F.lit(True).alias("within"))

    accepted = F.when(F.col("within"), F.col("first_seq")).otherwise(F.col("first_paid_seq"))
    facts = per_key.join(within, _KEY, "left").select(
        *_KEY, "existing_id", F.when(F.col("existing_id").isNull(), accepted).alias("accepted_seq")
    )
    judged = salted_lookup(keyed, facts, _KEY, hot, ["seq"])
    new_id = uuid_from(*[F.col(c) for c in _KEY], F.col("accepted_seq"))
    status = (
        F.when(F.col("existing_id").isNotNull(), "deduped")
        .when(F.col("seq") == F.col("accepted_seq"), "stored")
        .when(F.col("seq") > F.col("accepted_seq"), "deduped")
        .otherwise("rejected")
    )
    outcomes = judged.withColumn("status", status).select(
        "seq",
        "user_id",
        "status",
        F.when(F.col("status") != "rejected", F.coalesce("existing_id", new_id)).alias("id"),
        F.when(F.col("status") == "rejected", "limit_exceeded").alias("error_code"),
    )
    chosen = facts.where(F.col("accepted_seq").isNotNull()).select(
        F.col("accepted_seq").alias("seq"), "content_hash", new_id.alias("id")
    )
    moment = F.lit(as_of).cast("timestamp")
    rows = with_normalized(chosen.join(requests, "seq"), "content", "content")
    rows = (embed or mock_embedder())(rows)
    inserted = rows.select(
        "id", "user_id", "namespace", "content", "metadata", "embedding", "content_hash",
        moment.alias("created_at"), moment.alias("updated_at"),
    )
    return inserted, outcomes


def _first(*order: str) -> Column:
    return F.min(F.struct(*order))


def update(
    memories: DataFrame,
    requests: DataFrame,
    as_of,
    embed: Embed | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Update content and/or metadata of owned memories.

    ``requests``: seq, user_id, id, content, metadata (null = not given; empty
    content = no change). A text that another memory of the namespace holds, or
    that an earlier request of the batch gives to another memory, is refused
    with its whole request. Several accepted requests for one memory apply in
    order of seq. Returns (new memories table, outcomes).
    """
    requests = requests.withColumn("content", F.nullif("content", F.lit("")))
    hashed = with_normalized(requests, "content", "content").select(
        "seq", "id", "user_id", content_hash(F.col("content")).alias("content_hash"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )
    owner = memories.select("id", "user_id", "namespace")
    # one pass over the texts; the verdicts work on this narrow table
    asked = checkpoint(hashed.join(owner, ["id", "user_id"], "left"))
    owned = F.col("namespace").isNotNull()

    targets = asked.where(owned & F.col("content_hash").isNotNull()).select(*_KEY, "seq", "id")
    # a holder other than this memory exists when the least or the greatest holder id differs from it
    named = memories.join(targets.select(_KEY).distinct(), _KEY, "left_semi")
    holders = named.groupBy(_KEY).agg(F.min("id").alias("least_id"), F.max("id").alias("most_id"))
    free_targets = targets.join(holders, _KEY, "left").where(
        F.coalesce((F.col("least_id") == F.col("id")) & (F.col("most_id") == F.col("id")), F.lit(True))
    )
    claims = free_targets.groupBy(_KEY).agg(_first("seq", "id")["id"].alias("claimed_by"))
    allowed = free_targets.join(claims, _KEY).where(F.col("id") == F.col("claimed_by"))
    allowed = allowed.select("seq", F.lit(True).alias("allowed"))

    judged = asked.join(allowed, "seq", "left")
    error = F.when(~owned, "not_found").when(
        F.col("content_hash").isNotNull() & F.col("allowed").isNull(), "validation_error"
    )
    judged = judged.withColumn("error_code", error)
    outcomes = judged.select(
        "seq", "id", F.when(F.col("error_code").isNull(), "ok").otherwise("rejected").alias("status"), "error_code"
    )
    has_text = F.col("content_hash").isNotNull()
    # last given value per column
    last = checkpoint(
        judged.where(F.col("error_code").isNull() & (has_text | F.col("has_metadata")))
        .groupBy("id")
        .agg(
            F.max(F.when(has_text, F.struct("seq", "content_hash"))).alias("text"),
            F.max(F.when(F.col("has_metadata"), F.col("seq"))).alias("metadata_seq"),
        )
        .select("id", F.col("text.seq").alias("content_seq"), "text.content_hash", "metadata_seq")
    )
    texts = requests.select(F.col("seq").alias("content_seq"), "content")
    texts = texts.join(last.select("content_seq"), "content_seq", "left_semi")
    texts = (embed or mock_embedder())(with_normalized(texts, "content", "content"))
    metas = requests.select(F.col("seq").alias("metadata_seq"), "metadata")
    # the texts come last, since they bring the vectors
    changes = last.join(metas, "metadata_seq", "left").join(texts, "content_seq", "left").select(
        "id", *[F.col(c).alias("new_" + c) for c in ("content", "content_hash", "embedding", "metadata")],
        F.lit(as_of).cast("timestamp").alias("new_updated_at"),
    )
    return _apply(memories, changes, last.select("id")), outcomes


def _apply(memories: DataFrame, changes: DataFrame, ids: DataFrame) -> DataFrame:
    """The table after ``changes``, which has each of ``ids`` (distinct, checkpointed). Only rows that change are shuffled."""
    columns = [
        F.coalesce("new_" + c, c).alias(c) if "new_" + c in changes.columns else F.col(c) for c in memories.columns
    ]
    if ids.count() > FEW_CHANGED:
        return memories.join(changes, "id", "left").select(*columns)
    listed = F.broadcast(ids)
    changed = memories.join(listed, "id", "left_semi").join(changes, "id").select(*columns)
    return memories.join(listed, "id", "left_anti").select(*memories.columns).unionByName(changed)


UPDATABLE = ["content", "metadata", "namespace", "embedding", "content_hash"]


def update_fields(memories: DataFrame, requests: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Generic partial update; null = not given.

    Several requests for one memory apply in order of seq: the last given value
    of each column stays. Outcomes name the updated fields; a request with none is ok without a lookup.
    """
    given = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in UPDATABLE]))
    owner = memories.select("id", "user_id", F.lit(True).alias("owned"))
    asked = requests.withColumn("updated_fields", given).join(owner, ["id", "user_id"], "left")
    error = F.when((F.size("updated_fields") > 0) & F.col("owned").isNull(), "not_found")
    asked = asked.withColumn("error_code", error)
    outcomes = asked.select(
        "seq", "id", F.when(F.col("error_code").isNull(), F.col("updated_fields")).alias("updated_fields"), "error_code"
    )
    last_given = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias("new_" + c) for c in UPDATABLE]
    accepted = asked.where(F.col("error_code").isNull() & (F.size("updated_fields") > 0))
    changes = accepted.groupBy("id").agg(*last_given).withColumn("new_updated_at", F.lit(as_of).cast("timestamp"))
    return _apply(memories, changes, checkpoint(accepted.select("id").distinct())), outcomes


def forget(memories: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete by id; not owned or already deleted in the batch -> not_found."""
    owner = memories.select("id", "user_id", F.lit(True).alias("owned"))
    first = requests.groupBy("id", "user_id").agg(F.min("seq").alias("first_seq"))
    deleted = first.join(owner, ["id", "user_id"]).select(F.col("first_seq").alias("seq"), F.lit(True).alias("done"))
    outcomes = requests.join(deleted, "seq", "left").select(
        "seq",
        "id",
        F.when(F.col("done"), "deleted").otherwise("rejected").alias("status"),
        F.when(F.col("done").isNull(), "not_found").alias("error_code"),
    )
    return delete_ids(memories, requests)[0], outcomes


def delete_ids(memories: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(survivors, deleted ids) for a frame of (id, user_id)."""
    keys = checkpoint(wanted.select("id", "user_id").distinct())
    # the rows that stay are not shuffled
    keys = F.broadcast(keys) if keys.count() <= FEW_CHANGED else keys
    deleted = memories.select("id", "user_id").join(keys, ["id", "user_id"], "left_semi")
    return memories.join(keys, ["id", "user_id"], "left_anti"), deleted


def delete_nearest(memories: DataFrame, requests: DataFrame, dim: int = EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """Delete the k nearest of each request without confirmation (W9): (survivors, request_id, id)."""
    found = nearest(memories, requests, dim).join(requests.select("request_id", "user_id"), "request_id")
    survivors, _ = delete_ids(memories, found)
    return survivors, found.select("request_id", "rank", "id")


def delete_users(
    users: DataFrame,
    memories: DataFrame,
    keys: DataFrame,
    usage: DataFrame,
    wanted: DataFrame,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete users with their memories and keys; usage rows block it.

    A user is blocked by a usage row of the user or of one of the user's keys.
    Returns ({users, memories, api_keys}, outcomes with user_id and status).
    """
    asked = wanted.select(F.col("user_id").alias("id")).distinct()
    known = asked.join(users.select("id"), "id", "left_semi")
    # usage is reduced to distinct ids before any join, so a busy user is one row
    by_user = usage.select(F.col("user_id").alias("id")).distinct()
    by_key = (
        keys.select(F.col("id").alias("api_key_id"), "user_id")
        .join(usage.select("api_key_id").distinct(), "api_key_id", "left_semi")
        .select(F.col("user_id").alias("id"))
    )
    blocked = known.join(by_user.unionByName(by_key).distinct(), "id", "left_semi").withColumn("blocked", F.lit(True))
    state = asked.join(known.withColumn("known", F.lit(True)), "id", "left").join(blocked, "id", "left")
    status = F.when(F.col("known").isNull(), "not_found").when(F.col("blocked"), "blocked").otherwise("deleted")
    outcomes = state.select(F.col("id").alias("user_id"), status.alias("status"))
    gone = outcomes.where(F.col("status") == "deleted").select("user_id")
    tables = {
        "users": users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti"),
        "memories": memories.join(gone, "user_id", "left_anti"),
        "api_keys": keys.join(gone, "user_id", "left_anti"),
    }
    return tables, outcomes


def insert_once(table: DataFrame, arrivals: DataFrame, key: str = "id", order: str = "received_at") -> DataFrame:
    """Arrivals whose id the table does not hold yet, the first delivery of each.

    The long table is first cut to the ids that arrive, which needs no shuffle
    of it while the arrivals are few. The arrivals are dealt by id into parts
    of a bounded number of rows (more rows in each beyond ``MOST_PARTS``
    parts) before anything sorts them: no task sorts a whole piece of the input.
    """
    n = arrivals.count()
    dealt = arrivals.repartition(min(MOST_PARTS, max(1, -(-n // PART_ROWS))), key)
    # ids look small in files; many of them must not be a table that every task holds
    few = lambda ids: ids if n <= FEW_ROWS else ids.hint("merge")
    held = table.select(key).join(few(dealt.select(key).distinct()), key, "left_semi")
    fresh = dealt.join(few(held), key, "left_anti")
    # deliveries of the same moment are told apart by their content, so a re-run picks the same one
    first = fresh.groupBy(key).agg(
        F.min_by(F.struct(*arrivals.columns), F.struct(order, F.xxhash64(*arrivals.columns))).alias("row")
    )
    return first.select("row.*")
