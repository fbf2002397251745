"""Pending deletions as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.schemas import PENDING_DELETION_TTL_SECONDS

OUTCOMES = "token string, seq bigint, user_id string, status string, message string, memory_ids array<string>"
_SWEEP_SECONDS = 60


def token_events(previews: DataFrame, confirms: DataFrame) -> DataFrame:
    """One stream of both: previews (token, user_id, memory_ids, at, expires_at) and confirms (token, user_id, seq, at)."""
    left = previews.select(
        "token", "user_id", F.lit(None).cast("bigint").alias("seq"), F.unix_micros("at").alias("at"),
        F.unix_micros("expires_at").alias("expires_at"), "memory_ids",
    )
    right = confirms.select(
        "token", "user_id", "seq", F.unix_micros("at").alias("at"),
        F.lit(None).cast("bigint").alias("expires_at"), F.lit(None).cast("array<string>").alias("memory_ids"),
    )
    return left.unionByName(right)


class _TokenProcessor(StatefulProcessor):
    def __init__(self, ttl_seconds: int | None, timers: bool = False):
        self.ttl_ms = None if ttl_seconds is None else ttl_seconds * 1000
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = "user_id string, expires_at bigint, memory_ids array<string>"
        self.pending = handle.getValueState("pending", schema, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"], na_position="first")
        held = self.pending.get() if self.pending.exists() else None
        out = []
        for user, seq, at, expires, ids in zip(
            events["user_id"], events["seq"], events["at"], events["expires_at"], events["memory_ids"]
        ):
            if not pd.isna(expires):
                held = (user, int(expires), list(ids))
                continue
            if held is None or held[0] != user:
                out.append((key[0], int(seq), user, "rejected", "Invalid or expired confirmation token", None))
            elif held[1] <= at:
                held = None
                out.append((key[0], int(seq), user, "rejected", "Confirmation token has expired", None))
            else:
                out.append((key[0], int(seq), user, "deleted", None, list(held[2])))
                held = None
        if held is None:
            self.pending.clear()
        else:
            self.pending.update(held)
            if self.timers:
                self.handle.registerTimer(-(-held[1] // 1000))
        columns = ["token", "seq", "user_id", "status", "message", "memory_ids"]
        yield pd.DataFrame(out, columns=columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a token that was previewed again later expires later
        if self.pending.exists() and self.pending.get()[1] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.pending.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def confirm_by_event_time(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """As ``confirm_stream``, on the clock of the events themselves.

    A token leaves the state once the watermark, the latest time seen less
    ``lateness``, has passed its expiry; a replay of old events frees its state
    like a live stream and ends. Rows older than the watermark are dropped.
    """
    timed = events.withColumn("moment", F.timestamp_micros("at")).withWatermark("moment", lateness)
    return timed.groupBy("token").transformWithStateInPandas(
        statefulProcessor=_TokenProcessor(None, timers=True), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime"
    )


def confirm_stream(events: DataFrame, live: bool = True) -> DataFrame:
    """Consume tokens on a stream; an accepted row carries the ids to delete.

    On a live stream unused tokens leave the state a sweep after their expiry.
    With ``live=False`` (replay of old events) they stay, since that clock is
    processing time, and the availableNow trigger can end. Needs the RocksDB state store.
    """
    ttl = PENDING_DELETION_TTL_SECONDS + _SWEEP_SECONDS if live else None
    return events.groupBy("token").transformWithStateInPandas(
        statefulProcessor=_TokenProcessor(ttl),
        outputStructType=OUTCOMES,
        outputMode="Append",
        timeMode="ProcessingTime" if live else "None",
    )
