"""Text column functions: normalising, hashing, escaping, timestamps."""

from __future__ import annotations

import json
import math
import unicodedata
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters JavaScript counts as white space, ASCII and other.
ASCII_WHITESPACE = r"\t\n\x0B\f\r "
OTHER_WHITESPACE = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# The accepted shapes of ids and addresses.
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
STRICT_UUID_PATTERN = (
    r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    r"|00000000-0000-0000-0000-000000000000|ffffffff-ffff-ffff-ffff-ffffffffffff)$"
)
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


@F.arrow_udf(T.StringType())
def _nfc(text: pa.Array) -> pa.Array:
    # (Arrow's own utf8_normalize leaves combining marks apart)
    return pa.array([s if s is None else unicodedata.normalize("NFC", s) for s in text.to_pylist()], text.type)


def _has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def collapse_whitespace(text: Column) -> Column:
    """One space for every run of white space, none at the ends.

    The wide character class is slow, so only texts that hold such a character use it.
    """
    runs = F.when(
        _has_non_ascii(text) & text.rlike(f"[{OTHER_WHITESPACE}]"),
        F.regexp_replace(text, f"[{ASCII_WHITESPACE}{OTHER_WHITESPACE}]+", " "),
    ).otherwise(F.regexp_replace(text, f"[{ASCII_WHITESPACE}]+", " "))
    return F.trim(runs)


def _compose(flat: Column) -> Column:
    """NFC form. Spark has no such function; the characters below U+0300 are composed
    already, so only texts with a later one go to Python. For the others its column is null."""
    return F.coalesce(_nfc(F.when(_has_non_ascii(flat) & flat.rlike(r"[^\x{0}-\x{2ff}]"), flat)), flat)


def normalize_text(text: Column) -> Column:
    """Trim, collapse white space and compose to NFC."""
    return _compose(collapse_whitespace(text))


def with_normalized(df: DataFrame, source: str, out: str) -> DataFrame:
    """``normalize_text`` as two steps, so the white-space work is done once per row."""
    flat = df.withColumn("_flat", collapse_whitespace(F.col(source)))
    return flat.withColumn(out, _compose(F.col("_flat"))).drop("_flat")


def content_hash(normalized: Column) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes of an already normalised text."""
    return F.sha2(normalized, 256)


def java_string_hash(text: Column) -> Column:
    """Absolute value of the 32-bit 31-polynomial hash over UTF-16 units."""
    code = F.java_method(F.lit("java.util.Objects"), F.lit("hashCode"), text)
    return F.abs(code.cast("bigint"))


def escape_markup(text: Column) -> Column:
    """Escape ``&`` first, then ``<`` and ``>``; quotes stay."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def escape_attribute(text: Column) -> Column:
    return F.replace(escape_markup(text), F.lit('"'), F.lit("&quot;"))


def iso_millis(ts: Column) -> Column:
    """UTC ISO-8601 text with milliseconds, truncated (needs a UTC session)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def json_size_bytes(json_text: Column) -> Column:
    """UTF-8 size of the compact form of a JSON text; null when it does not parse.

    The form keeps the last of repeated keys and writes numbers the shortest way:
    1e2 as 100, 1.50 as 1.5, exponents from 1e21 on and below 1e-6.
    """
    return F.arrow_udf(_compact_sizes, "int")(json_text)


def _shortest_number(text: str) -> str:
    value = float(text)
    if value == 0:
        return "0"
    digits, _, exponent = f"{value!r}".partition("e")
    if math.isinf(value):
        return "null"
    if not exponent:
        return digits.removesuffix(".0")
    if 1e-6 <= abs(value) < 1e21:
        return f"{Decimal(repr(value)):f}".removesuffix(".0")
    return f"{digits.removesuffix('.0')}e{int(exponent):+d}"


class _Number:
    def __init__(self, text: str):
        self.text = _shortest_number(text)


def _no_constant(name: str):
    raise ValueError(name)


def _compact_sizes(texts: pa.Array) -> pa.Array:
    sizes = []
    for text in texts.to_pylist():
        try:
            parsed = None if text is None else json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
        except (ValueError, RecursionError):
            sizes.append(None)
            continue
        compact = _dump(parsed)
        sizes.append(None if text is None else len(compact.encode("utf-8", "surrogatepass")))
    return pa.array(sizes, pa.int32())


def _dump(value) -> str:
    if isinstance(value, _Number):
        return value.text
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def is_uuid(value: Column, strict: bool = False) -> Column:
    pattern = STRICT_UUID_PATTERN if strict else UUID_PATTERN
    return F.coalesce(value.rlike(pattern), F.lit(False))


def is_email(value: Column) -> Column:
    return F.coalesce(value.rlike(EMAIL_PATTERN), F.lit(False))


def uuid_from(*parts: Column) -> Column:
    """A UUID-shaped id derived from the row, so a retried task gives the same id."""
    hexed = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    pieces = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(hexed, start, size) for start, size in pieces])


def iso_dates_deep(value: Column, dtype: T.DataType) -> Column:
    """Replace every timestamp inside ``value``, at any depth, by ISO text."""
    if isinstance(dtype, T.TimestampType):
        return iso_millis(value)
    if isinstance(dtype, T.StructType):
        fields = [iso_dates_deep(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: iso_dates_deep(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: iso_dates_deep(item, dtype.valueType))
    return value
