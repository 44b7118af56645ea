"""Date and time helpers as Column expressions. Stored times are UTC; the business day is UTC+8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?$"


def business_date(col: Column) -> Column:
    return F.to_date(col + F.expr("INTERVAL 8 HOURS"))


def plan_date(col: Column) -> Column:
    """Trailing YYYY-MM-DD of an id, else empty text."""
    return F.regexp_extract(col, r"(\d{4}-\d{2}-\d{2})$", 1)


def parse_any_date(col: Column) -> Column:
    """ISO text (Z and offsets allowed), plain date or slashed date as a UTC timestamp; else null."""
    c = F.regexp_replace(F.regexp_replace(col, r"(?U)^\s+|\s+$", ""), "Z", "+00:00")
    day = F.regexp_extract(c, r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", 0)
    iso = F.when(F.rlike(c, F.lit(_ISO)), c)
    iso = F.when(F.rlike(iso, F.lit(r"[+-]\d{2}:\d{2}$")), iso).otherwise(F.concat(iso, F.lit("+00:00")))
    plain = F.when(day != "", F.concat(F.translate(day, "/", "-"), F.lit(" 00:00:00+00:00")))
    return F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(plain))


def epoch_micros(col: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col)
