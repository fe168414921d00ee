"""JSON of mixed shapes as VARIANT columns: paths with defaults, either of two layouts, and reports of shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_at(v: Column, path: str, kind: str, default: object = None) -> Column:
    """The value at a path such as ``$.a.b[0]`` as ``kind``; ``default`` where the path is absent, the
    value is null, or it can't be read as that type."""
    found = F.try_variant_get(v, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def kind_at(v: Column, path: str = "$") -> Column:
    """The type of the value at a path (OBJECT, ARRAY, STRING, BIGINT, ...), VOID for a null; NULL if absent."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), r"^(\w+)", 1)


def items_of(text: Column, field: str = "results") -> Column:
    """Array of variants that a document holds: an array itself, an object's array ``field``, or the
    document as the only item; NULL where the text is no JSON."""
    v = F.try_parse_json(text)
    inner = F.try_variant_get(v, f"$.{field}", "array<variant>")
    return F.when(v.isNull(), None).otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), inner, F.array(v)))


def shapes(df: DataFrame, keys: list[str], v: Column) -> DataFrame:
    """``keys, shape, n``: the one schema that fits all values of a group, and their number."""
    return df.groupBy(*keys).agg(F.schema_of_variant_agg(v).alias("shape"), F.count("*").alias("n"))


def dumped(row: Column) -> Column:
    """A nested value as JSON text, with fields that are NULL kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})
