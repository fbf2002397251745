"""Usage accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.text import uuid_from
from engram.schemas import FREE_MEMORY_QUOTA

# The tools whose calls are recorded.
TOOLS = ("remember", "recall", "list_memories", "update_memory", "forget")


def build_usage_events(calls: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Usage rows of calls (T5).

    One row per call that reached a tool (1 token, ok or failed) and one per
    rate-limited call (tool ``unknown``, 0 tokens, 0 ms). Calls of an unknown
    tool or without arguments leave no row. ``decisions`` has request_id, allowed.
    """
    if decisions is not None:
        calls = calls.join(decisions.select("request_id", "allowed"), "request_id", "left")
    else:
        calls = calls.withColumn("allowed", F.lit(True))
    limited = ~F.coalesce("allowed", F.lit(True))
    has_args = F.col("has_arguments") if "has_arguments" in calls.columns else F.lit(True)
    kept = calls.where(limited | (F.col("tool_name").isin(*TOOLS) & has_args))

    def either(when_limited, value):
        return F.when(limited, when_limited).otherwise(value)

    ok = F.col("error_code").isNull()
    return kept.select(
        uuid_from(F.col("request_id"), F.col("occurred_at"), F.col("tool_name")).alias("id"),
        "user_id",
        "api_key_id",
        "request_id",
        either(F.lit("unknown"), F.col("tool_name")).alias("tool_name"),
        either(F.lit(0), F.lit(1)).alias("tokens_consumed"),
        either(F.lit(0), F.col("latency_ms")).alias("latency_ms"),
        either(F.lit(False), ok).alias("success"),
        either(F.lit("rate_limited"), F.col("error_code")).alias("error_code"),
        "occurred_at",
    )


def usage_summary(events: DataFrame, by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Calls, tokens, successes, failures and rate-limited calls per group (A4).

    ``by`` may name user_id, api_key_id, tool_name and day. ``totals`` adds
    roll-up rows (null group columns).
    """
    by = by or ["user_id", "tool_name", "day"]
    rows = events.withColumn("day", F.to_date("occurred_at")) if "day" in by else events
    grouped = rows.rollup(*by) if totals else rows.groupBy(*by)
    limited = F.col("error_code").eqNullSafe("rate_limited")
    return grouped.agg(
        F.count("*").alias("calls"),
        F.sum("tokens_consumed").alias("tokens"),
        F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
        F.count_if(limited).alias("rate_limited"),
    )


def latency_percentiles(events: DataFrame, by: str = "tool_name", points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Exact interpolated percentiles and maximum of latency per group (A5).

    Latencies are whole milliseconds, so rows first shrink to one count per
    distinct value; ranks are then running sums of counts.
    """
    histogram = events.groupBy(by, "latency_ms").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(by).orderBy("latency_ms").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    ranked = histogram.withColumn("last", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))

    def value_at(index):
        """Value with 0-based sorted position ``index``."""
        inside = (F.col("last") - F.col("n") <= index) & (index < F.col("last"))
        return F.max(F.when(inside, F.col("latency_ms")))

    aggregates = [F.max("total").alias("calls"), F.max("latency_ms").alias("max_ms")]
    for i, p in enumerate(points):
        spot = (F.col("total") - 1) * F.lit(p)
        aggregates += [
            value_at(F.floor(spot)).alias(f"lo{i}"),
            value_at(F.ceil(spot)).alias(f"hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"part{i}"),
        ]
    out = ranked.groupBy(by).agg(*aggregates)
    percentiles = [
        (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")).alias(f"p{round(p * 100)}_ms")
        for i, p in enumerate(points)
    ]
    return out.select(by, "calls", *percentiles, "max_ms")


def latency_sketch(events: DataFrame, by: str = "tool_name", accuracy: int = 10_000) -> DataFrame:
    """Approximate percentiles in bounded memory, for a quick look at huge logs (A5)."""
    cut = F.percentile_approx("latency_ms", [0.5, 0.95], accuracy)
    return events.groupBy(by).agg(cut[0].alias("p50_ms"), cut[1].alias("p95_ms"), F.max("latency_ms").alias("max_ms"))


# width of the quantile sketches (rank error about 0.4 %) and log2 of the counters of the distinct counts (about 0.8 %)
KLL_WIDTH, HLL_LOG = 800, 14


def usage_states(events: DataFrame) -> DataFrame:
    """Per day and tool: calls, tokens, failures, and mergeable sketches of latencies and users (A4, A5)."""
    rows = events.withColumn("day", F.to_date("occurred_at"))
    return rows.groupBy("day", "tool_name").agg(
        F.count("*").alias("calls"),
        F.sum("tokens_consumed").alias("tokens"),
        F.count_if(~F.col("success")).alias("failures"),
        F.max("latency_ms").alias("max_ms"),
        F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), KLL_WIDTH).alias("latencies"),
        F.hll_sketch_agg("user_id", HLL_LOG).alias("users"),
    )


def write_states(events: DataFrame, path: str) -> None:
    """Store the states of the days that ``events`` covers whole; other days keep theirs, a day that comes again is replaced."""
    usage_states(events).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def usage_between(states: DataFrame, since: str, until: str, points: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Usage per tool over the days from ``since`` to before ``until``, from states alone."""
    days = states.where((F.col("day") >= F.lit(since).cast("date")) & (F.col("day") < F.lit(until).cast("date")))
    merged = days.groupBy("tool_name").agg(
        F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("failures").alias("failures"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("latencies", KLL_WIDTH).alias("latencies"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
    )
    cuts = [F.kll_sketch_get_quantile_bigint("latencies", F.lit(p)).alias(f"p{round(p * 100)}_ms") for p in points]
    return merged.select("tool_name", "calls", "tokens", "failures", "max_ms", "users", *cuts)


def usage_errors(events: DataFrame) -> DataFrame:
    """Failed calls per tool and error code."""
    return events.where(~F.col("success")).groupBy("tool_name", "error_code").agg(F.count("*").alias("n"))


def usage_timeline(events: DataFrame, by: str = "user_id", latest: int = 10) -> DataFrame:
    """The newest events per user or key (R12). The rank is cut before the shuffle."""
    newest = Window.partitionBy(by).orderBy(F.col("occurred_at").desc(), F.col("id").desc())
    return events.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= latest)


def memory_counts(memories: DataFrame) -> DataFrame:
    """Memories per user over all namespaces (A1)."""
    return memories.groupBy("user_id").agg(F.count("*").alias("n_memories"))


def quota_headroom(memories: DataFrame, key_tiers: DataFrame) -> DataFrame:
    """Room left per user with an active free key (A7). ``key_tiers`` comes from J1."""
    free = key_tiers.where(F.col("tier") == "free").select("user_id").distinct()
    used = F.coalesce("n_memories", F.lit(0))
    return free.join(memory_counts(memories), "user_id", "left").select(
        "user_id",
        used.alias("n_memories"),
        F.greatest(F.lit(FREE_MEMORY_QUOTA) - used, F.lit(0)).alias("headroom"),
    )


def usage_windows(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Calls and tokens per user and time window (T6); batch or stream.

    On a stream, rows later than ``lateness`` are dropped and a window is final
    once the watermark passes it.
    """
    return (
        events.withWatermark("occurred_at", lateness)
        .groupBy(F.window("occurred_at", window), "user_id")
        .agg(F.count("*").alias("calls"), F.sum("tokens_consumed").alias("tokens"))
        .select("user_id", F.col("window.start").alias("window_start"), "calls", "tokens")
    )
