"""Data-quality jobs: request rules, integrity and result audits.

Request rules give ``error_code`` (null when valid), the first message and all
issues, like the service's validators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.metadata import json_entries
from engram.functions.text import is_email, is_uuid, json_size_bytes, utf16_length
from engram.functions.tiers import is_tier
from engram.schemas import (
    MAX_CONTENT_UNITS,
    MAX_FILTER_KEYS,
    MAX_LIST_LIMIT,
    MAX_METADATA_BYTES,
    MAX_QUERY_UNITS,
    MAX_RECALL_LIMIT,
)


def _issue(path: str, broken: Column, message: str | Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(path).alias("path"), text.alias("message")))


def _judge(df: DataFrame, issues: list[Column]) -> DataFrame:
    found = F.array_compact(F.array(*issues))
    df = df.withColumn("issues", found)
    bad = F.size("issues") > 0
    return df.withColumn("error_code", F.when(bad, "validation_error")).withColumn(
        "message", F.when(bad, F.col("issues")[0]["message"])
    )


def split(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects with error_code, message and issues)."""
    valid = judged.where(F.col("error_code").isNull()).drop("issues", "error_code", "message")
    return valid, judged.where(F.col("error_code").isNotNull())


def _metadata_issues(col: str) -> list[Column]:
    size = json_size_bytes(F.col(col))
    given = F.col(col).isNotNull()
    too_big = F.format_string("Metadata must not exceed 4096 bytes serialized (got %d bytes)", size)
    is_object = F.col(col).rlike(r"^\s*\{")
    return [
        _issue(col, given & (size.isNull() | ~is_object), "Metadata must be a JSON object"),
        _issue(col, given & (size > MAX_METADATA_BYTES), too_big),
    ]


def _text_issues(col: str, name: str, longest: int | None) -> list[Column]:
    length = utf16_length(F.col(col))
    issues = [
        _issue(col, F.col(col).isNull(), f"{name} is required"),
        _issue(col, length < 1, f"{name} must not be empty"),
    ]
    if longest is not None:
        issues.append(_issue(col, length > longest, f"{name} must not exceed {longest} characters"))
    return issues


def _range_issue(col: str, low, high=None) -> Column:
    value = F.col(col)
    broken = value < low if high is None else (value < low) | (value > high)
    text = f"{col} must be at least {low}" if high is None else f"{col} must be between {low} and {high}"
    return _issue(col, broken, text)


def _whole_issue(col: str) -> Column:
    return _issue(col, F.col(col) != F.floor(F.col(col)), f"{col} must be a whole number")


def _defaults(df: DataFrame, **values) -> DataFrame:
    for name, value in values.items():
        given = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, F.coalesce(given, F.lit(value)))
    return df


def _optional(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def check_remember(requests: DataFrame) -> DataFrame:
    """Content of 1 to 50,000 UTF-16 units before normalising, metadata of at most 4,096 bytes."""
    df = _optional(requests, "metadata")
    return _judge(df, [*_text_issues("content", "Content", MAX_CONTENT_UNITS), *_metadata_issues("metadata")])


def _filter_issues(col: str) -> list[Column]:
    """At most 8 keys, scalar values only (D3)."""
    entries = json_entries(F.col(col))
    kinds = F.transform(entries, lambda e: F.schema_of_variant(e["value"]))
    scalar = r"^(STRING|BOOLEAN|TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
    too_many = F.format_string("Metadata filter must not exceed 8 keys (got %d)", F.size(entries))
    given = F.col(col).isNotNull()
    return [
        _issue(col, given & entries.isNull(), "Metadata filter must be a JSON object"),
        _issue(col, F.size(entries) > MAX_FILTER_KEYS, too_many),
        _issue(
            col,
            F.exists(kinds, lambda kind: ~F.coalesce(kind.rlike(scalar), F.lit(False))),
            "Metadata filter values must be primitives (string, number, boolean)",
        ),
    ]


def check_recall(requests: DataFrame) -> DataFrame:
    """Query of 1 to 10,000 units, limit 1 to 50, threshold 0 to 1, filter rules."""
    df = _optional(_defaults(requests, limit=10, threshold=0.7), "metadata_filter")
    return _judge(
        df,
        [
            *_text_issues("query", "Query", MAX_QUERY_UNITS),
            _whole_issue("limit"),
            _range_issue("limit", 1, MAX_RECALL_LIMIT),
            _range_issue("threshold", 0, 1),
            *_filter_issues("metadata_filter"),
        ],
    )


def check_list(requests: DataFrame) -> DataFrame:
    """Limit 1 to 100, offset from 0, order in two values."""
    df = _defaults(requests, limit=20, offset=0, order="created_at")
    return _judge(
        df,
        [
            _whole_issue("limit"),
            _range_issue("limit", 1, MAX_LIST_LIMIT),
            _whole_issue("offset"),
            _range_issue("offset", 0),
            _issue("order", ~F.col("order").isin("created_at", "updated_at"), "order must be created_at or updated_at"),
        ],
    )


def check_update(requests: DataFrame) -> DataFrame:
    """UUID id and at least one of content and metadata; long content is only a warning."""
    df = _optional(requests, "content", "metadata")
    neither = F.col("content").isNull() & F.col("metadata").isNull()
    judged = _judge(
        df,
        [
            _issue("id", ~is_uuid(F.col("id"), strict=True), "Memory ID must be a valid UUID"),
            *_metadata_issues("metadata"),
            _issue("", neither, "At least one of content or metadata must be provided"),
        ],
    )
    too_long = utf16_length(F.col("content")) > MAX_CONTENT_UNITS
    return judged.withColumn("warning", F.when(too_long, "content_over_limit"))


def check_forget(requests: DataFrame) -> DataFrame:
    """Sort into by_id, preview and confirm, and check each.

    A request with a valid query and a token is a preview: the query form is
    tried first; one whose query form is invalid may still be a confirmation.
    """
    df = _optional(requests, "id", "query", "confirmation_token")
    df = _defaults(df, threshold=0.85, limit=10)
    by_query = F.col("mode") == "by_query"
    length = utf16_length(F.col("query"))
    preview_issues = [
        _issue("query", F.coalesce(length, F.lit(0)) < 1, "Query must not be empty"),
        _range_issue("threshold", 0, 1),
        _whole_issue("limit"),
        _range_issue("limit", 1, MAX_RECALL_LIMIT),
    ]
    previewable = F.size(F.array_compact(F.array(*preview_issues))) == 0
    has_token = F.coalesce(utf16_length(F.col("confirmation_token")) >= 1, F.lit(False))
    kind = (
        F.when(F.col("mode") == "by_id", "by_id")
        .when(by_query & previewable, "preview")
        .when(by_query & has_token, "confirm")
        .when(by_query, "preview")
    )
    df = df.withColumn("kind", kind)
    in_preview = F.col("kind") == "preview"
    issues = [
        _issue("mode", F.col("kind").isNull(), "mode must be by_id or by_query"),
        _issue(
            "id", (F.col("kind") == "by_id") & ~is_uuid(F.col("id"), strict=True), "Memory ID must be a valid UUID"
        ),
        *[F.when(in_preview, issue) for issue in preview_issues],
    ]
    return _judge(df, issues)


def check_results(results: DataFrame, required: list[str]) -> DataFrame:
    """Rows that break the result contract (D7): a missing field or a similarity outside [0, 1]."""
    issues = [_issue(c, F.col(c).isNull(), f"{c} is required") for c in required]
    if "similarity" in results.columns:
        outside = ~F.col("similarity").between(0.0, 1.0) | F.isnan("similarity")
        issues.append(_issue("similarity", outside, "similarity must be between 0 and 1"))
    return _judge(results, issues).where(F.col("error_code").isNotNull())


def require_valid_results(results: DataFrame, required: list[str]) -> DataFrame:
    """The same contract as a post-condition: a broken row fails the job that reads it."""
    broken = F.lit(False)
    for c in required:
        broken = broken | F.col(c).isNull()
    if "similarity" in results.columns:
        broken = broken | ~F.coalesce(F.col("similarity").between(0.0, 1.0), F.lit(False))
    check = F.when(broken, F.raise_error(F.lit("Output shape validation failed")).cast("boolean")).otherwise(F.lit(True))
    return results.where(check)


def missing_owners(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Foreign-key values with no parent, and their row counts.

    Children are counted per key before the join, so a busy key is one row.
    """
    counted = child.groupBy(F.col(fk).alias("key")).agg(F.count("*").alias("n"))
    known = parent.select(F.col(parent_key).alias("key"))
    return counted.where(F.col("key").isNotNull()).join(known, "key", "left_anti")


def fk_audit(users: DataFrame, keys: DataFrame, memories: DataFrame, usage: DataFrame) -> DataFrame:
    """All foreign keys of the model in one report: relation, key, n."""
    checks = [
        ("memories.user_id", memories, "user_id", users),
        ("api_keys.user_id", keys, "user_id", users),
        ("usage_events.user_id", usage, "user_id", users),
        ("usage_events.api_key_id", usage, "api_key_id", keys),
    ]
    report = None
    for name, child, fk, parent in checks:
        part = missing_owners(child, fk, parent).select(F.lit(name).alias("relation"), "key", "n")
        report = part if report is None else report.unionByName(part)
    return report


def repeated(df: DataFrame, col: str) -> DataFrame:
    """Values of a unique column that occur more than once."""
    counted = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("key")).agg(F.count("*").alias("n"))
    return counted.where("n > 1")


def constraint_audit(users: DataFrame, keys: DataFrame, usage: DataFrame, billing: DataFrame) -> DataFrame:
    """Broken domain and uniqueness rules: rule, key, n."""

    def broken(rule: str, df: DataFrame, bad: Column) -> DataFrame:
        return df.where(bad).select(F.lit(rule).alias("rule"), F.col("id").alias("key"), F.lit(1).cast("bigint").alias("n"))

    def unique(rule: str, df: DataFrame, col: str) -> DataFrame:
        return repeated(df, col).select(F.lit(rule).alias("rule"), "key", "n")

    parts = [
        broken("users.tier", users, ~is_tier(F.col("tier"))),
        broken("users.email_shape", users, ~is_email(F.col("email"))),
        broken("api_keys.tier", keys, ~is_tier(F.col("tier"))),
        broken("usage_events.tokens_consumed", usage, F.col("tokens_consumed") < 0),
        broken("usage_events.latency_ms", usage, F.col("latency_ms") < 0),
        unique("users.id", users, "id"),
        unique("users.email", users, "email"),
        unique("api_keys.key_hash", keys, "key_hash"),
        unique("stripe_events.id", billing, "id"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def leaked_rows(results: DataFrame, requests: DataFrame, memories: DataFrame) -> DataFrame:
    """Returned rows whose memory is not the requesting user's (D10); must be empty."""
    asked = results.select("request_id", "id").join(requests.select("request_id", "user_id"), "request_id")
    return asked.join(memories.select("id", "user_id"), ["id", "user_id"], "left_anti")
