"""Table schemas, limits and tier settings of the memory model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampType()

USERS = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("email", _S, False),
        T.StructField("tier", _S, False),
        T.StructField("stripe_customer_id", _S),
        T.StructField("created_at", _TS),
    ]
)

API_KEYS = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("user_id", _S, False),
        T.StructField("key_hash", _S, False),
        T.StructField("key_prefix", _S, False),
        T.StructField("label", _S),
        T.StructField("last_used_at", _TS),
        T.StructField("revoked_at", _TS),
        T.StructField("created_at", _TS),
        T.StructField("tier", _S, False),
    ]
)

MEMORIES = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("user_id", _S, False),
        T.StructField("namespace", _S, False),
        T.StructField("content", _S, False),
        T.StructField("metadata", _S, False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), containsNull=False), False),
        T.StructField("content_hash", _S, False),
        T.StructField("created_at", _TS),
        T.StructField("updated_at", _TS),
    ]
)

USAGE_EVENTS = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("user_id", _S, False),
        T.StructField("api_key_id", _S, False),
        T.StructField("request_id", _S, False),
        T.StructField("tool_name", _S, False),
        T.StructField("tokens_consumed", T.IntegerType(), False),
        T.StructField("latency_ms", T.IntegerType(), False),
        T.StructField("success", T.BooleanType(), False),
        T.StructField("error_code", _S),
        T.StructField("occurred_at", _TS, False),
    ]
)

BILLING_EVENTS = T.StructType(
    [
        T.StructField("id", _S, False),
        T.StructField("event_type", _S, False),
        T.StructField("received_at", _TS),
        T.StructField("processed_at", _TS),
        T.StructField("payload", _S),
    ]
)

TABLES = {
    "users": USERS,
    "api_keys": API_KEYS,
    "memories": MEMORIES,
    "usage_events": USAGE_EVENTS,
    "stripe_events": BILLING_EVENTS,
}

# Request limits and defaults of the memory service.
DEFAULT_NAMESPACE = "default"
EMBEDDING_DIM = 1536
MAX_CONTENT_UNITS = 50_000
MAX_QUERY_UNITS = 10_000
MAX_METADATA_BYTES = 4_096
MAX_FILTER_KEYS = 8
MAX_RECALL_LIMIT = 50
MAX_LIST_LIMIT = 100
FREE_MEMORY_QUOTA = 100
PENDING_DELETION_TTL_SECONDS = 5 * 60
IDLE_BUCKET_TTL_SECONDS = 10 * 60

# Tier name -> rank.
TIER_RANK = {"free": 0, "starter": 1, "pro": 2, "team": 3}
