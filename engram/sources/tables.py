"""Readers of the model tables with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.schemas import BILLING_EVENTS, TABLES


def read_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan a model table; the schema is given, never inferred."""
    # a table in folders of batches has their number as one more column
    return spark.read.schema(TABLES[name]).format(fmt).load(path).select(*TABLES[name].names)


def stream_table(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return spark.readStream.schema(TABLES[name]).format(fmt).options(**options).load(path)


def read_billing_inbox(spark: SparkSession, path: str) -> DataFrame:
    """Billing events from JSON files: id, event_type, received_at, payload."""
    return spark.read.schema(BILLING_EVENTS).json(path)


def stream_billing_inbox(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(BILLING_EVENTS).option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def usage_of(events: DataFrame, by: str, value: str, since=None, until=None) -> DataFrame:
    """Usage events of one user or key in a time range, newest first (S3)."""
    rows = events.where(F.col(by) == value)
    if since is not None:
        rows = rows.where(F.col("occurred_at") >= F.lit(since))
    if until is not None:
        rows = rows.where(F.col("occurred_at") < F.lit(until))
    return rows.orderBy(F.col("occurred_at").desc(), F.col("id").desc())


def billing_fields(payload: Column) -> dict[str, Column]:
    """Typed fields of a billing payload."""
    parsed = F.try_parse_json(payload)

    def field(path: str) -> Column:
        return F.try_variant_get(parsed, "$.data.object." + path, "string")

    return {
        "customer_id": field("customer"),
        "price_id": field("items.data[0].price.id"),
        "app_user_id": field("metadata.app_user_id"),
        "object_id": field("id"),
    }
