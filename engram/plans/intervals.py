"""Smallest value among the intervals that hold a point, with equi-joins only.

The intervals of a key that has few travel as one short list, which each point
of the key looks through. Those of a crowded key are written as the aligned
blocks that make them up (sizes are powers of the radix); a point lies in one
block per level. So "which intervals hold this point" becomes a join on
(key, level, block), and only the minimum per block is kept: no pair of all
points and intervals of a key is formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.plans.skew import hot_keys, salted_lookup
from engram.session import checkpoint

RADIX = 16
# intervals of one key that a point looks through one by one
FEW = 32


def _levels(upper: int) -> int:
    levels = 1
    while RADIX**levels <= upper:
        levels += 1
    return levels


def _with_levels(df: DataFrame, levels: int) -> DataFrame:
    sizes = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(RADIX**n).alias("size")) for n in range(levels)])
    return df.withColumn("_s", F.explode(sizes)).select("*", "_s.level", "_s.size").drop("_s")


def stabbing_min(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    point_id: str,
    at: str,
    value: str,
    upper: int,
) -> DataFrame:
    """``point_id`` and the least ``value`` over intervals [start, stop) of its key that hold ``at``.

    Integers only; 0 <= start, stop and at <= ``upper``. Points in no interval
    are absent. ``n_bound`` counts the intervals found, to report ambiguity.
    Both frames are read several times.
    """
    intervals = intervals.where("start < stop")
    points = points.select(*dict.fromkeys([key, point_id, at]))
    hot = hot_keys(points.groupBy(key).agg(F.count("*").alias("n")), [key], "n")
    crowded = intervals.groupBy(key).agg(F.count("*").alias("_m")).where((F.col("_m") > FEW) & F.col(key).isNotNull())
    # both hold a row for each of a few large keys; as a rule they are empty and their joins fall away
    hot, crowded = checkpoint(hot), checkpoint(crowded.select(key))
    no_hot, no_crowd = hot.isEmpty(), crowded.isEmpty()

    def found(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(facts, keys) if no_hot else salted_lookup(rows, facts, keys, hot, [point_id], how="inner")

    some = intervals if no_crowd else intervals.join(crowded, key, "left_anti")
    lists = some.groupBy(key).agg(F.collect_list(F.struct("start", "stop", F.col(value).alias("value"))).alias("_held"))
    holding = F.filter("_held", lambda x: (x["start"] <= F.col(at)) & (F.col(at) < x["stop"]))
    listed = found(points, lists, [key]).select(point_id, holding.alias("_held"))
    hits = listed.select(point_id, F.array_min(F.col("_held")["value"]).alias(value), F.size("_held").cast("bigint").alias("n_bound"))
    if not no_crowd:
        dense = points.join(crowded, key, "left_semi"), intervals.join(crowded, key, "left_semi")
        hits = hits.unionByName(_by_blocks(*dense, key, point_id, at, value, upper, found))
    return hits.groupBy(point_id).agg(F.min(value).alias(value), F.sum("n_bound").alias("n_bound")).where("n_bound > 0")


def _by_blocks(
    points: DataFrame, intervals: DataFrame, key: str, point_id: str, at: str, value: str, upper: int, found: Callable[..., DataFrame]
) -> DataFrame:
    """Per point and level the least value and the number of the intervals whose block of that level holds it."""
    levels = _levels(upper + 1)
    size = F.col("size")
    lo, hi = F.ceil(F.col("start") / size), F.floor(F.col("stop") / size)
    up_lo, up_hi = F.ceil(F.col("start") / (size * RADIX)) * RADIX, F.floor(F.col("stop") / (size * RADIX)) * RADIX
    last = F.col("level") == levels - 1

    def span(first, end):
        return F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<bigint>"))

    # blocks of this level that no block of the next level covers
    edges = F.when(last | (up_lo >= up_hi), span(lo, hi)).otherwise(F.concat(span(lo, up_lo), span(up_hi, hi)))
    blocks = (
        _with_levels(intervals, levels)
        .select(key, "level", F.explode(edges).alias("block"), value)
        .groupBy(key, "level", "block")
        .agg(F.min(value).alias(value), F.count("*").alias("n_bound"))
    )
    spots = _with_levels(points, levels).select(key, point_id, "level", F.floor(F.col(at) / F.col("size")).alias("block"))
    return found(spots, blocks, [key, "level", "block"]).select(point_id, value, "n_bound")
