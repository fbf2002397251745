"""Redaction of sensitive text in log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Field names whose text is hashed, and those dropped outright.
HASHED_FIELDS = ("content", "query", "query_text", "memory_content")
DROPPED_FIELDS = ("embedding", "embeddings")


def _short_hash(text: Column) -> Column:
    return F.concat(F.lit("[redacted:"), F.substring(F.sha2(text, 256), 1, 8), F.lit("]"))


def _redact_map(value: Column, dtype: T.MapType) -> Column:
    """Entries are fields named by their keys; a dropped entry of another type than text becomes null."""
    is_text = isinstance(dtype.valueType, T.StringType)

    def entry(key: Column, item: Column) -> Column:
        gone = F.lit("[redacted]") if is_text else F.lit(None).cast(dtype.valueType)
        kept = F.when(key.isin(*DROPPED_FIELDS), gone)
        if is_text:
            kept = kept.when(key.isin(*HASHED_FIELDS), _short_hash(item))
        return kept.otherwise(_redact("", item, dtype.valueType))

    return F.transform_values(value, entry)


def _redact(name: str, value: Column, dtype: T.DataType) -> Column:
    if name in HASHED_FIELDS and isinstance(dtype, T.StringType):
        return _short_hash(value)
    if name in DROPPED_FIELDS:
        return F.lit("[redacted]")
    if isinstance(dtype, T.StructType):
        fields = [_redact(f.name, value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        return _redact_map(value, dtype)
    return value


def redact_df(df: DataFrame) -> DataFrame:
    """Redact by column name, walking into structs and maps but not into arrays."""
    return df.select(
        *[_redact(f.name, F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )
