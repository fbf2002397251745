"""The model tables derived from the driver's test tables (see FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR_DIM = 64


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_memories(spark: SparkSession, sf: str) -> DataFrame:
    """``embeddings`` as memories: 5 users, one namespace per label."""
    vec = F.col("vec_id")
    created = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(vec_id as int),0)")
    even = F.when(vec % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    return _read(spark, sf, "embeddings").select(
        vec.cast("string").alias("id"),
        (vec % 5).cast("string").alias("user_id"),
        F.concat(F.lit("ns"), F.col("label").cast("string")).alias("namespace"),
        F.concat(F.lit("<m> & "), vec.cast("string")).alias("content"),
        F.concat(
            F.lit('{"label":'), F.col("label").cast("string"),
            F.lit(',"even":'), even,
            F.lit(',"bucket":"b'), (vec % 3).cast("string"), F.lit('"}'),
        ).alias("metadata"),
        "embedding",
        F.sha2(F.concat(F.lit("<m> & "), vec.cast("string")), 256).alias("content_hash"),
        created.alias("created_at"),
        (created + F.expr("make_interval(0,0,0,0,cast(vec_id % 7 as int),0,0)")).alias("updated_at"),
    )


def vector_requests(spark: SparkSession, sf: str, k: int = 5, threshold: float = 0.0) -> DataFrame:
    """Every embedding asks for its neighbours in its own namespace."""
    vec = F.col("vec_id")
    return _read(spark, sf, "embeddings").select(
        vec.alias("request_id"),
        (vec % 5).cast("string").alias("user_id"),
        F.concat(F.lit("ns"), F.col("label").cast("string")).alias("namespace"),
        F.col("embedding").alias("query_embedding"),
        F.lit(k).alias("k"),
        F.lit(threshold).alias("threshold"),
    )


def text_requests(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as remember requests: 7 users, the first five on the free tier."""
    user = F.col("doc_id") % 7
    return _read(spark, sf, "documents").select(
        F.col("doc_id").alias("seq"),
        user.cast("string").alias("user_id"),
        F.when(user < 5, F.lit("free")).otherwise(F.lit("pro")).alias("tier"),
        F.col("lang").alias("namespace"),
        F.col("text").alias("content"),
        F.concat(
            F.lit('{"source":"'), F.col("source"), F.lit('","n_chars":'),
            F.col("n_chars").cast("string"), F.lit("}"),
        ).alias("metadata"),
    )


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    tool = (
        F.when(kind.isin("view", "error"), "recall")
        .when(kind == "signup", "remember")
        .when(kind == "click", "list_memories")
        .when(kind == "purchase", "update_memory")
    )
    return _read(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("user_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 2).cast("string").alias("api_key_id"),
        F.col("event_id").cast("string").alias("request_id"),
        tool.alias("tool_name"),
        F.lit(1).alias("tokens_consumed"),
        F.round("value").cast("int").alias("latency_ms"),
        (kind != "error").alias("success"),
        F.when(kind == "error", "internal_error").alias("error_code"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
    )


def rate_calls(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"),
        F.lit("free").alias("tier"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("ts_ms"),
        F.col("event_id").alias("seq"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    tier = (
        F.when(segment == "MACHINERY", "starter")
        .when(segment == "AUTOMOBILE", "pro")
        .when(segment == "FURNITURE", "team")
        .otherwise("free")
    )
    key = F.col("c_custkey").cast("string")
    return _read(spark, sf, "customer").select(
        key.alias("id"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        tier.alias("tier"),
        F.concat(F.lit("cus_"), key).alias("stripe_customer_id"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"),
    )


def api_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Two keys per user: 0 with the user's tier, 1 with an empty one and sometimes revoked."""
    people = users(spark, sf)
    number = F.col("user_id").cast("bigint") * 10 + F.col("n")
    moment = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(n as int),0)")
    revoked = (F.col("n") == 1) & (F.col("user_id").cast("bigint") % 4 == 0)
    pairs = people.select(
        F.col("id").alias("user_id"), F.col("tier").alias("user_tier"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n")
    )
    return pairs.select(
        number.cast("string").alias("id"),
        "user_id",
        F.sha2(number.cast("string"), 256).alias("key_hash"),
        F.concat(F.lit("k"), number.cast("string")).alias("key_prefix"),
        F.concat(F.lit("label "), F.col("n").cast("string")).alias("label"),
        F.lit(None).cast("timestamp").alias("last_used_at"),
        F.when(revoked, F.expr("timestamp'2024-02-01 00:00:00'")).alias("revoked_at"),
        moment.alias("created_at"),
        F.when(F.col("n") == 0, F.col("user_tier")).otherwise(F.lit("")).alias("tier"),
    )


def billing_events(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as subscription events with JSON payloads."""
    status = F.col("o_orderstatus")
    kind = (
        F.when(status == "O", "customer.subscription.created")
        .when(status == "P", "customer.subscription.updated")
        .otherwise("customer.subscription.deleted")
    )
    payload = F.to_json(
        F.struct(
            F.struct(
                F.struct(
                    F.concat(F.lit("sub_"), F.col("o_orderkey").cast("string")).alias("id"),
                    F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer"),
                    F.struct(
                        F.array(F.struct(F.struct(F.col("o_orderpriority").alias("id")).alias("price"))).alias("data")
                    ).alias("items"),
                ).alias("object")
            ).alias("data")
        )
    )
    return _read(spark, sf, "orders").select(
        F.concat(F.lit("evt_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"),
        kind.alias("event_type"),
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.lit(None).cast("timestamp").alias("processed_at"),
        payload.alias("payload"),
    )


# Order priority used as a price id -> tier; "4-NOT SPECIFIED" is unmapped.
PRICE_TO_TIER = {
    "1-URGENT": "team",
    "2-HIGH": "pro",
    "3-MEDIUM": "starter",
    "5-LOW": "free",
}


def price_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICE_TO_TIER.items()), "price_id string, tier string")


def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("content"),
        F.struct(F.col("text").alias("query"), "role").alias("meta"),
    )
