"""Typed equality of top-level JSON metadata (P5, part of D3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATOR = "\x1f"
_NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


def json_entries(json_text: Column) -> Column:
    """Top-level entries as ``array<struct<key, value: variant>>``; of a repeated key the last one."""
    every = F.map_entries(F.from_json(json_text, "map<string,variant>"))

    def is_last(entry: Column, place: Column) -> Column:
        later = F.slice(every, place + 2, F.size(every))
        return ~F.exists(later, lambda other: other["key"] == entry["key"])

    return F.filter(every, is_last)


def _typed_value(value: Column) -> Column:
    """Scalar with its JSON type, so 1 and 1.0 agree but 1 and "1" do not; null otherwise."""
    kind = F.schema_of_variant(value)
    as_number = F.try_variant_get(value, "$", "double") + F.lit(0.0)
    return (
        F.when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(value, "$", "string")))
        .when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(value, "$", "string")))
        .when(kind.rlike(_NUMBER_KINDS), F.concat(F.lit("n:"), as_number.cast("string")))
    )


def metadata_tags(json_text: Column) -> Column:
    """``key + type + value`` texts of the scalar top-level entries."""
    tags = F.transform(
        json_entries(json_text),
        lambda e: F.concat(e["key"], F.lit(_SEPARATOR), _typed_value(e["value"])),
    )
    return F.coalesce(F.array_compact(tags), F.array().cast("array<string>"))


def filter_tags(json_text: Column) -> Column:
    """Tags a memory must all hold; a non-scalar entry, or a text that is no object, gives a tag none holds.

    Only null and ``{}`` ask for nothing.
    """
    tags = F.transform(
        json_entries(json_text),
        lambda e: F.concat(
            e["key"], F.lit(_SEPARATOR), F.coalesce(_typed_value(e["value"]), F.lit("x:"))
        ),
    )
    nothing = F.array().cast("array<string>")
    no_object = json_text.isNotNull() & F.json_object_keys(json_text).isNull()
    return F.when(no_object, F.array(F.lit(_SEPARATOR + "x:"))).otherwise(F.coalesce(tags, nothing))


def metadata_contains(metadata: Column, wanted: Column) -> Column:
    """True when every top-level entry of ``wanted`` is in ``metadata``; empty matches all."""
    return F.size(F.array_except(filter_tags(wanted), metadata_tags(metadata))) == 0
