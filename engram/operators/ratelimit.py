"""Token-bucket replay.

Tokens are counted in whole units, so a decision does not depend on rounding:
a call that arrives exactly when a token is complete is allowed. A service that
sums fractions of tokens in floating point may refuse such a call.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.tiers import TIER_BUCKETS, Bucket
from engram.plans.ordered import range_sorted
from engram.schemas import IDLE_BUCKET_TTL_SECONDS


@dataclass(frozen=True)
class Units:
    """Bucket sizes in units: one token = ``token`` units, whole gains per millisecond."""

    token: int
    capacity: dict[str, int]
    gain: dict[str, int]

    @staticmethod
    def of(buckets: dict[str, Bucket]) -> "Units":
        token = lcm(*[b.refill_ms for b in buckets.values()])
        return Units(
            token,
            {tier: b.capacity * token for tier, b in buckets.items()},
            {tier: b.refill_tokens * token // b.refill_ms for tier, b in buckets.items()},
        )


def check_idle_ttl(buckets: dict[str, Bucket], ttl_seconds: int = IDLE_BUCKET_TTL_SECONDS) -> None:
    """Dropping idle buckets is invisible only if they are full again by then."""
    for tier, bucket in buckets.items():
        if bucket.fill_ms > ttl_seconds * 1000:
            raise ValueError(f"tier {tier!r} refills in {bucket.fill_ms} ms, longer than the idle limit")


def step(tokens: int, token: int) -> tuple[bool, int]:
    """Serve one call from refilled ``tokens``."""
    return (True, tokens - token) if tokens >= token else (False, tokens)


@dataclass
class _Pieces:
    """What a stretch of calls does to any level the bucket may start with.

    Piece i covers start levels from lo[i] up to lo[i+1]; its result is
    add[i], plus the start level where moves[i]. There are about as many pieces
    as the bucket holds tokens: fuller starts only serve a few calls more.
    """

    lo: list[int] = field(default_factory=lambda: [0])
    add: list[int] = field(default_factory=lambda: [0])
    moves: list[bool] = field(default_factory=lambda: [True])
    top: int = 0

    def constant(self) -> int | None:
        return None if len(self.lo) > 1 or self.moves[0] else self.add[0]

    def _each(self) -> Iterator[tuple[int, int, int, bool]]:
        ends = [*self.lo[1:], self.top + 1]
        yield from zip(self.lo, ends, self.add, self.moves)

    def _set(self, pieces: list[tuple[int, int, bool]]) -> None:
        self.lo, self.add, self.moves = [], [], []
        for lo, add, moves in pieces:
            if not self.lo or (add, moves) != (self.add[-1], self.moves[-1]):
                self.lo.append(lo)
                self.add.append(add)
                self.moves.append(moves)

    def gain(self, units: int, cap: int) -> None:
        out = []
        for lo, end, add, moves in self._each():
            add += units
            if not moves:
                out.append((lo, min(add, cap), False))
                continue
            full_from = max(lo, cap - add)  # start levels from here reach the cap
            if full_from > lo:
                out.append((lo, add, True))
            if full_from < end:
                out.append((full_from, cap, False))
        self._set(out)

    def call(self, token: int) -> None:
        out = []
        for lo, end, add, moves in self._each():
            if not moves:
                out.append((lo, step(add, token)[1], False))
                continue
            served_from = max(lo, token - add)
            if served_from > lo:
                out.append((lo, add, True))
            if served_from < end:
                out.append((served_from, add - token, True))
        self._set(out)

    def below(self, token: int) -> bool:
        """Do all starts end below one token?"""
        return all((end - 1 + add if moves else add) < token for _, end, add, moves in self._each())

    def turn(self, units: int, token: int) -> None:
        """Many calls at once while no gain exceeds a token: the level just wraps around."""
        out = []
        for lo, end, add, moves in self._each():
            if not moves:
                out.append((lo, (add + units) % token, False))
                continue
            wraps = (lo + add + units) // token
            cut = (wraps + 1) * token - add - units
            out.append((lo, add + units - wraps * token, True))
            if cut < end:
                out.append((cut, add + units - (wraps + 1) * token, True))
        self._set(out)

    def result(self, start: int) -> int:
        i = int(np.searchsorted(self.lo, start, side="right")) - 1
        return self.add[i] + (start if self.moves[i] else 0)


def _gains(ts: np.ndarray, before: int, rate: np.ndarray, cap: np.ndarray) -> np.ndarray:
    elapsed = np.diff(ts, prepend=before)
    full = -(-cap // rate)  # more time than this cannot add more than the cap
    return np.minimum(elapsed, full) * rate


class _Run:
    """The calls of one key inside a part, from a known level or from any."""

    def __init__(self, units: Units, key, level: int | None):
        self.units, self.key, self.level = units, key, level
        self.pieces = None if level is not None else _Pieces(top=max(units.capacity.values()))
        self.last_ts: int | None = None
        self.first_ts: int | None = None
        self.first_tier: str | None = None

    def feed(self, ts: np.ndarray, cap: np.ndarray, rate: np.ndarray) -> tuple[list, list] | None:
        """Serve calls in order; returns (allowed, level) lists when the level is known."""
        token = self.units.token
        fresh = self.last_ts is None
        gains = _gains(ts, int(ts[0]) if fresh else self.last_ts, rate, cap)
        if fresh:
            self.first_ts = int(ts[0])
        self.last_ts = int(ts[-1])
        at = 0
        if self.pieces is not None:
            at = self._feed_pieces(gains, cap, token)
            if self.pieces is not None:
                return None
        allowed, levels = [], []
        level = self.level
        for gain, most in zip(gains[at:].tolist(), cap[at:].tolist()):
            level += gain
            if level > most:
                level = most
            if level >= token:
                level -= token
                allowed.append(True)
            else:
                allowed.append(False)
            levels.append(level)
        self.level = level
        return allowed, levels

    def _feed_pieces(self, gains: np.ndarray, cap: np.ndarray, token: int) -> int:
        """Feed calls until they end or the level no longer depends on the start."""
        at = 0
        big = np.flatnonzero((gains > token) | (cap < 2 * token))
        while at < len(gains):
            if self.pieces.below(token):
                nxt = np.searchsorted(big, at)
                stop = int(big[nxt]) if nxt < len(big) else len(gains)
                if stop > at:
                    self.pieces.turn(int(gains[at:stop].sum()), token)
                    at = stop
                    continue
            self.pieces.gain(int(gains[at]), int(cap[at]))
            self.pieces.call(token)
            at += 1
            known = self.pieces.constant()
            if known is not None:
                self.level, self.pieces = known, None
                break
        return at


def _batches(pdfs: Iterator[pd.DataFrame]):
    """Per batch: keys, arrays, and the row ranges of its runs."""
    for pdf in pdfs:
        if not len(pdf):
            continue
        cap, rate = pdf["cap"].to_numpy(np.int64), pdf["rate"].to_numpy(np.int64)
        keys = pdf["key"].to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        yield pdf, keys, pdf["ts_ms"].to_numpy(np.int64), cap, rate, list(zip(starts, np.append(starts[1:], len(keys))))


_SUMMARY = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("first_key", T.StringType()),
        T.StructField("last_key", T.StringType()),
        T.StructField("first_ts", T.LongType()),
        T.StructField("last_ts", T.LongType()),
        T.StructField("first_cap", T.LongType()),
        T.StructField("first_rate", T.LongType()),
        T.StructField("level", T.LongType()),
        T.StructField("lo", T.ArrayType(T.LongType())),
        T.StructField("add", T.ArrayType(T.LongType())),
        T.StructField("moves", T.ArrayType(T.BooleanType())),
        T.StructField("top", T.LongType()),
    ]
)


def _summarize(units: Units):
    """One row per part: what its last key leaves behind for the next part."""

    def run_part(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, head, part = None, None, None
        for pdf, keys, ts, cap, rate, ranges in _batches(pdfs):
            if head is None:
                part = int(pdf["_part"].iloc[0])
                head = (keys[0], int(ts[0]), int(cap[0]), int(rate[0]))
                # the first key may have begun in an earlier part
                run = _Run(units, keys[0], None)
            lo, hi = ranges[0]
            if keys[0] == run.key and len(ranges) == 1:
                run.feed(ts[lo:hi], cap[lo:hi], rate[lo:hi])
                continue
            # only the last key of the part matters, and it starts inside this part
            lo, hi = ranges[-1]
            run = _Run(units, keys[-1], int(cap[lo]))
            run.feed(ts[lo:hi], cap[lo:hi], rate[lo:hi])
        if head is not None:
            p = run.pieces
            yield pd.DataFrame(
                {
                    "part": [part], "first_key": [head[0]], "last_key": [run.key], "first_ts": [head[1]],
                    "last_ts": [run.last_ts], "first_cap": [head[2]], "first_rate": [head[3]],
                    "level": [run.level], "lo": [p.lo if p else None], "add": [p.add if p else None],
                    "moves": [p.moves if p else None], "top": [p.top if p else None],
                }
            )

    return run_part


def _entry_levels(summaries: list) -> dict[int, int]:
    """Level at the first call (already refilled) of each part that continues a key."""
    entries, before, level = {}, None, None
    for row in sorted(summaries, key=lambda r: r["part"]):
        entry = row["first_cap"]
        if before is not None and before["last_key"] == row["first_key"]:
            gain = (row["first_ts"] - before["last_ts"]) * row["first_rate"]
            entry = min(row["first_cap"], level + gain)
            entries[row["part"]] = entry
        if row["lo"] is not None:
            level = _Pieces(row["lo"], row["add"], row["moves"], row["top"]).result(entry)
        else:
            level = row["level"]
        before = row
    return entries


def replay(calls: DataFrame, buckets: dict[str, Bucket] = TIER_BUCKETS, partitions: int | None = None) -> DataFrame:
    """Decide every call in order (key, ts_ms, seq): allowed, remaining, retry_after.

    The calls are range-partitioned by (key, time), so a hot key fills many
    parts. A first pass gives one small row per part (how its last key leaves
    the bucket; for a part inside one key, as a function of the level it starts
    with). Chaining those rows gives each part its starting level, and a second
    pass decides all parts at once. The driver sees one row per part, never calls.
    """
    if "free" not in buckets:
        raise ValueError("unknown tiers use the 'free' bucket, so it must be given")
    units = Units.of(buckets)
    retry = {tier: b.retry_after_seconds for tier, b in buckets.items()}

    def by_tier(values: dict[str, int]) -> Column:
        pairs = F.create_map(*[F.lit(x).cast(t) for item in values.items() for x, t in zip(item, ("string", "bigint"))])
        return F.coalesce(F.try_element_at(pairs, F.col("tier")), F.lit(values["free"]).cast("bigint"))

    named = calls.select(
        F.col("key").cast("string").alias("key"), "ts_ms", "seq",
        by_tier(units.capacity).alias("cap"), by_tier(units.gain).alias("rate"), by_tier(retry).alias("wait"),
    )
    rows = range_sorted(named, [F.col("key"), F.col("ts_ms"), F.col("seq")], partitions)
    narrow = rows.select("key", "ts_ms", "cap", "rate", "_part")
    entries = _entry_levels(narrow.mapInPandas(_summarize(units), _SUMMARY).collect())
    shared = calls.sparkSession.sparkContext.broadcast(entries)
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()),
            T.StructField("seq", calls.schema["seq"].dataType),
            T.StructField("ts_ms", T.LongType()),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("remaining", T.LongType()),
            T.StructField("retry_after", T.LongType()),
        ]
    )

    def decide(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = None
        for pdf, keys, ts, cap, rate, ranges in _batches(pdfs):
            allowed, levels = [], []
            for lo, hi in ranges:
                if run is None:
                    level = shared.value.get(int(pdf["_part"].iloc[0]), int(cap[lo]))
                    run = _Run(units, keys[lo], level)
                elif run.key != keys[lo]:
                    run = _Run(units, keys[lo], int(cap[lo]))
                a, v = run.feed(ts[lo:hi], cap[lo:hi], rate[lo:hi])
                allowed += a
                levels += v
            ok = np.array(allowed)
            yield pd.DataFrame(
                {
                    "key": keys,
                    "seq": pdf["seq"].to_numpy(),
                    "ts_ms": ts,
                    "allowed": ok,
                    "remaining": np.where(ok, np.array(levels, dtype=np.int64) // units.token, 0),
                    "retry_after": pdf["wait"].to_numpy(),
                }
            )

    decided = rows.drop("_idx").mapInPandas(decide, schema)
    return decided.withColumn("retry_after", F.when(~F.col("allowed"), F.col("retry_after")))
