"""Order numbers inside groups without sorting a whole group in one task.

Rows are range-partitioned on (group, order), so a group of any size is spread
over as many partitions as its rows need. The sorted rows are checkpointed once:
the place of a row must not move when a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import checkpoint

ROWS_PER_PART = 5_000_000
_INDEX_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def range_sorted(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Sorted, evenly split, checkpointed rows with ``_part`` and ``_idx`` (place in the part).

    Without ``partitions`` their number follows the row count.
    """
    if partitions is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(least, -(-df.count() // ROWS_PER_PART))
    split = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    return checkpoint(
        split.withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", _INDEX_BITS).cast("int"))
        .withColumn("_idx", F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)))
        .drop("_place")
    )


def numbered(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    counted: Column | None = None,
    out: str = "position",
) -> DataFrame:
    """Add the 1-based running count of ``counted`` rows (default: all) in each group.

    A row that is not counted gets the number of counted rows before it.
    """
    counted = F.lit(True) if counted is None else counted
    rows = range_sorted(df.withColumn("_counted", counted.cast("int")), [*[F.col(g) for g in groups], *order])
    piece = Window.partitionBy(*groups, "_part").orderBy("_idx")
    local = rows.withColumn("_local", F.sum("_counted").over(piece))
    totals = rows.groupBy(*groups, "_part").agg(F.sum("_counted").alias("_n"))
    # one row per group and part: at most the number of groups plus the number of parts
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        local.join(starts, [*groups, "_part"])
        .withColumn(out, F.col("_start") + F.col("_local"))
        .drop("_start", "_local", "_part", "_idx", "_counted")
    )


def arrival_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """1-based place of each row in the order of the whole frame.

    Per part only its row count is needed; that one row per part is broadcast.
    """
    rows = range_sorted(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + F.col("_idx") + 1)
        .drop("_start", "_part", "_idx")
    )


def next_in_key(df: DataFrame, key: str, order_col: str, out: str, chunk: int = 1_000_000) -> DataFrame:
    """Add the next value of the integer ``order_col`` within ``key`` (null for the last).

    A hot key is cut into chunks of the order axis: inside a chunk by ``lead``,
    across chunks by the first value of the next chunk that has any.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(order_col) / chunk))
    local = F.lead(order_col).over(Window.partitionBy(key, "_chunk").orderBy(order_col))
    heads = rows.groupBy(key, "_chunk").agg(F.min(order_col).alias("_head"))
    following = F.lead("_head").over(Window.partitionBy(key).orderBy("_chunk"))
    heads = heads.select(key, "_chunk", following.alias("_next"))
    return (
        rows.withColumn("_local", local)
        .join(heads, [key, "_chunk"])
        .withColumn(out, F.coalesce("_local", "_next"))
        .drop("_chunk", "_local", "_next")
    )
