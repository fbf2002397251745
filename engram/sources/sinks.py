"""Sinks: memories (appended, or laid out for reads), usage events, JSON results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import iso_dates_deep, uuid_from


def new_memory_rows(rows: DataFrame, batch_id: str, as_of) -> DataFrame:
    """Complete inserted memories: id, default metadata, timestamps.

    The id is a hash of the row and the batch, so a re-run task repeats it.
    ``rows`` needs a ``seq`` that is unique in the batch.
    """
    moment = F.lit(as_of).cast("timestamp")
    metadata = F.col("metadata") if "metadata" in rows.columns else F.lit(None)
    return rows.select(
        uuid_from(F.lit(batch_id), F.col("user_id"), F.col("namespace"), F.col("seq")).alias("id"),
        "user_id",
        "namespace",
        "content",
        F.coalesce(metadata, F.lit("{}")).alias("metadata"),
        "embedding",
        "content_hash",
        moment.alias("created_at"),
        moment.alias("updated_at"),
    )


def append_memories(rows: DataFrame, path: str, batch_id: str, as_of) -> DataFrame:
    """Append a batch in a folder of its own: a batch that runs again replaces its rows."""
    complete = new_memory_rows(rows, batch_id, as_of)
    complete.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return complete.select("id")


def write_clustered(memories: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the memories table sorted by (user, namespace, created_at) over all files.

    Parquet's min/max values then let a read of one user or namespace skip the
    other files. Ranges include the time, so a large user fills several files.
    """
    order = ["user_id", "namespace", "created_at", "id"]
    spread = memories.repartitionByRange(partitions, *order) if partitions else memories.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def append_usage(events: DataFrame, path: str, on_error: Callable[[Exception], None] | None = None) -> bool:
    """Append usage events; a failed write is reported and never raised."""
    try:
        events.write.mode("append").parquet(path)
        return True
    except Exception as error:  # the caller's work must not fail with the log
        if on_error is not None:
            on_error(error)
        return False


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with ISO timestamps at any depth."""
    fields = [iso_dates_deep(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("errorifexists").text(path)
