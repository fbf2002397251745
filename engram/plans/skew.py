"""Lookup joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# rows of one key that one task takes
HOT_ROWS = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, hot_rows: int | None = None) -> DataFrame:
    """The keys with at least ``hot_rows`` (``HOT_ROWS``) rows and the number of ``splits`` each needs."""
    most = HOT_ROWS if hot_rows is None else hot_rows
    summed = counts.groupBy(*keys).agg(F.sum(count_col).alias("_n"))
    return summed.where(F.col("_n") >= most).select(*keys, (F.ceil(F.col("_n") / most) + 1).cast("int").alias("splits"))


def salted_lookup(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    hot: DataFrame,
    spread: list[str],
    how: str = "left",
) -> DataFrame:
    """Join ``rows`` to ``facts`` (one row per key), with the hot keys salted.

    ``hot`` lists hot values of some or all of the keys (see ``hot_keys``), as
    many as there are. The rows of such a key are spread over its ``splits`` by a
    hash of the ``spread`` columns (a hash, not a random number, so a re-run task
    places them alike); the one fact row of the key is repeated per split.
    """
    hot_cols = [c for c in hot.columns if c != "splits"]
    splits = F.coalesce(F.col("splits"), F.lit(1))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), splits).cast("int")
    left = rows.join(hot, hot_cols, "left").withColumn("_salt", salt).drop("splits")
    every = F.explode(F.sequence(F.lit(0), splits - 1))
    right = facts.join(hot, hot_cols, "left").withColumn("_salt", every).drop("splits")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
