"""Tier domain, rank and token-bucket settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.schemas import TIER_RANK


@dataclass(frozen=True)
class Bucket:
    """A token bucket that gains ``refill_tokens`` every ``refill_ms``."""

    capacity: int
    refill_tokens: int
    refill_ms: int

    @property
    def retry_after_seconds(self) -> int:
        return -(-self.refill_ms // (1000 * self.refill_tokens))

    @property
    def fill_ms(self) -> float:
        """Time to refill an empty bucket."""
        return self.capacity * self.refill_ms / self.refill_tokens


# Bucket size and refill per tier; unknown tiers use "free".
TIER_BUCKETS = {
    "free": Bucket(10, 10, 60_000),
    "starter": Bucket(60, 60, 60_000),
    "pro": Bucket(60, 60, 60_000),
    "team": Bucket(60, 60, 60_000),
}


def is_tier(tier: Column) -> Column:
    return F.coalesce(tier.isin(*TIER_RANK), F.lit(False))


def tier_rank(tier: Column) -> Column:
    """Rank of a tier; unknown or missing tiers rank as the lowest."""
    rank = F.lit(0)
    for name, value in TIER_RANK.items():
        rank = F.when(tier == name, F.lit(value)).otherwise(rank)
    return rank


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def effective_tier(key_tier: Column, user_tier: Column) -> Column:
    return F.coalesce(blank_to_null(key_tier), blank_to_null(user_tier), F.lit("free"))
