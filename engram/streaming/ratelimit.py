"""Token buckets as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from engram.functions.tiers import TIER_BUCKETS, Bucket
from engram.operators.ratelimit import Units, check_idle_ttl, step

DECISIONS = "key string, seq bigint, ts_ms bigint, allowed boolean, remaining bigint, retry_after bigint"


class _BucketProcessor(StatefulProcessor):
    def __init__(self, buckets: dict[str, Bucket], idle_ttl_seconds: int | None):
        self.units = Units.of(buckets)
        self.retry = {tier: b.retry_after_seconds for tier, b in buckets.items()}
        self.ttl_ms = None if idle_ttl_seconds is None else idle_ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "level bigint, last_ms bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows)).sort_values(["ts_ms", "seq"])
        units = self.units
        level, last = self.state.get() if self.state.exists() else (None, None)
        allowed, remaining, retry = [], [], []
        for ts, tier in zip(calls["ts_ms"].tolist(), calls["tier"].tolist()):
            tier = tier if tier in units.capacity else "free"
            most = units.capacity[tier]
            if level is None:
                level = most
            else:
                level = min(most, level + max(0, ts - last) * units.gain[tier])
            last = ts if last is None else max(last, ts)
            ok, level = step(level, units.token)
            allowed.append(ok)
            remaining.append(level // units.token if ok else 0)
            retry.append(None if ok else self.retry[tier])
        self.state.update((level, last))
        yield pd.DataFrame(
            {
                "key": key[0],
                "seq": calls["seq"].to_numpy(),
                "ts_ms": calls["ts_ms"].to_numpy(),
                "allowed": allowed,
                "remaining": remaining,
                "retry_after": pd.array(retry, dtype="Int64"),
            }
        )

    def close(self) -> None:
        pass


def rate_limit_stream(
    calls: DataFrame,
    buckets: dict[str, Bucket] = TIER_BUCKETS,
    idle_ttl_seconds: int | None = None,
) -> DataFrame:
    """Decide a stream of calls (key, tier, ts_ms, seq). Needs the RocksDB state store.

    Order holds inside a micro-batch; later batches never change earlier
    decisions. Give ``idle_ttl_seconds`` on a live stream to drop idle buckets;
    leave it out when old calls are replayed, since it runs on processing time
    (such a stream also never ends by itself under the availableNow trigger).
    """
    if idle_ttl_seconds is not None:
        check_idle_ttl(buckets, idle_ttl_seconds)
    return calls.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_BucketProcessor(buckets, idle_ttl_seconds),
        outputStructType=DECISIONS,
        outputMode="Append",
        timeMode="ProcessingTime" if idle_ttl_seconds is not None else "None",
    )
