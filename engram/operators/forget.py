"""Two-step deletion by query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import iso_millis
from engram.functions.vector import clamp_unit
from engram.operators.recall import search
from engram.operators.writes import delete_ids
from engram.schemas import EMBEDDING_DIM, PENDING_DELETION_TTL_SECONDS
from engram.session import checkpoint


def preview(
    memories: DataFrame,
    requests: DataFrame,
    now,
    salt: str,
    dim: int = EMBEDDING_DIM,
    strategy: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Find what would be deleted: (summaries, matches, pending table).

    Null or empty namespace = all; threshold 0.85 and k 10 by default. A request
    without matches gets an empty token and expiry, and no pending row. The token
    is a salted hash, so a re-run task repeats it; keep the salt secret.
    """
    for name, default in (("threshold", 0.85), ("k", 10)):
        given = F.col(name) if name in requests.columns else F.lit(None)
        requests = requests.withColumn(name, F.coalesce(given, F.lit(default)))
    space = F.col("namespace") if "namespace" in requests.columns else F.lit(None).cast("string")
    requests = requests.withColumn("namespace", F.nullif(space, F.lit("")))
    found = search(memories, requests, dim, strategy)
    # at most k rows per request; all three results read them, so they are scored once
    matches = checkpoint(
        found.select("request_id", "rank", "id", "content", clamp_unit(F.col("similarity")).alias("similarity"))
    )
    # at most k ids per request
    per_request = matches.groupBy("request_id").agg(
        F.count("*").alias("total_matches"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("memory_ids"),
    )
    expires = F.lit(now).cast("timestamp") + F.expr(f"interval {PENDING_DELETION_TTL_SECONDS} seconds")
    token = F.sha2(F.concat_ws("\x1f", F.col("request_id").cast("string"), F.lit(salt)), 256)
    hits = F.col("total_matches") > 0
    everyone = requests.select("request_id", "user_id").join(per_request, "request_id", "left")
    everyone = everyone.withColumn("total_matches", F.coalesce("total_matches", F.lit(0)))
    summaries = everyone.select(
        "request_id",
        "user_id",
        "total_matches",
        F.when(hits, token).otherwise(F.lit("")).alias("confirmation_token"),
        F.when(hits, iso_millis(expires)).otherwise(F.lit("")).alias("expires_at"),
    )
    pending = everyone.where(hits).select(token.alias("token"), "user_id", "memory_ids", expires.alias("expires_at"))
    return summaries, matches, pending


def confirm(
    memories: DataFrame, pending: DataFrame, confirms: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consume tokens: (surviving memories, outcomes, tokens still pending).

    ``confirms``: seq, user_id, token, at. Per token the first try of its owner
    (by at, seq) counts: it deletes before the expiry and is refused from the
    expiry on; either way the token is gone. Other users change nothing.
    """
    tokens = pending.select("token", F.col("user_id").alias("owner"), "expires_at")
    tries = confirms.join(tokens, "token", "left").withColumn(
        "own", F.coalesce(F.col("owner") == F.col("user_id"), F.lit(False))
    )
    first = tries.where("own").groupBy("token").agg(F.min(F.struct("at", "seq"))["seq"].alias("first_seq"))
    first = first.withColumnRenamed("first_seq", "seq").select("seq", F.lit(True).alias("is_first"))
    judged = tries.join(first, "seq", "left")
    error = (
        F.when(F.col("is_first").isNull(), "Invalid or expired confirmation token")
        .when(F.col("expires_at") <= F.col("at"), "Confirmation token has expired")
    )
    judged = judged.withColumn("error", error)
    good = judged.where(F.col("error").isNull()).select("token", "seq", "at", "user_id")
    ids = good.join(pending.select("token", "memory_ids"), "token").select(
        "seq", "at", "user_id", F.explode("memory_ids").alias("id")
    )
    # an id named by several confirmed previews is deleted by the earliest
    deleter = ids.groupBy("id", "user_id").agg(F.min(F.struct("at", "seq"))["seq"].alias("seq"))
    survivors, deleted = delete_ids(memories, ids)
    counts = deleted.join(deleter, ["id", "user_id"]).groupBy("seq").agg(F.count("*").alias("n_deleted"))
    outcomes = judged.join(counts, "seq", "left").select(
        "seq",
        F.when(F.col("error").isNull(), "deleted").otherwise("rejected").alias("status"),
        F.when(F.col("error").isNull(), F.coalesce("n_deleted", F.lit(0))).alias("deleted_count"),
        F.when(F.col("error").isNotNull(), "validation_error").alias("error_code"),
        F.col("error").alias("message"),
    )
    used = judged.where("is_first").select("token").distinct()
    return survivors, outcomes, pending.join(used, "token", "left_anti")
