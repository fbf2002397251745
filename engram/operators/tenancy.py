"""Tenant isolation of reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions.text import is_uuid


def visible_rows(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows of the users in ``contexts`` (user_id); a missing context sees nothing."""
    allowed = contexts.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    return rows.join(allowed, "user_id", "left_semi")


def require_contexts(contexts: DataFrame) -> DataFrame:
    """Contexts for tables that must not be read without one: a bad user id fails the job."""
    bad = F.raise_error(F.concat(F.lit("Invalid user ID format: "), F.coalesce("user_id", F.lit("")))).cast("boolean")
    return contexts.where(F.when(is_uuid(F.col("user_id")), F.lit(True)).otherwise(bad))


def split_by_tenant(rows: DataFrame, context_user: str = "ctx_user_id") -> tuple[DataFrame, DataFrame]:
    """Write check: rows owned by their context user, and the rejected rest."""
    own = F.coalesce(F.col("user_id") == F.col(context_user), F.lit(False))
    return rows.where(own), rows.where(~own).withColumn("error_code", F.lit("tenant_violation"))
