"""Attribute access on JSON text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attr(col: Column, path: str, default: str | None = None) -> Column:
    """Value at a dotted path of a JSON text column, or the default when absent or not parsable."""
    value = F.get_json_object(col, f"$.{path}")
    return value if default is None else F.coalesce(value, F.lit(default))


def is_json(col: Column) -> Column:
    """True for exactly one JSON value; text after the value makes it false (the JSON functions ignore such text)."""
    items = F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>")
    return F.coalesce(F.size(items) == 1, F.lit(False))
