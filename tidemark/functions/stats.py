"""Small numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_pct(num: Column, den: Column) -> Column:
    """num / den * 100, or 0 when the divisor is 0."""
    return F.when(den == 0, 0.0).otherwise(num / den * 100)


def quotient(num: Column, den: Column) -> Column:
    """num / den of doubles as IEEE has it: by 0 infinite, 0 / 0 not a number. Null where either is."""
    by_zero = F.when(num > 0, float("inf")).when(num < 0, float("-inf")).when(num == 0, float("nan"))
    return F.when(den == 0, F.when(F.isnan(num), num).otherwise(by_zero)).otherwise(num / den)


def exclusive_p75(sorted_arr: Column) -> Column:
    """Third exclusive quartile of a sorted array (needs 4 values; fewer give the maximum)."""
    n = F.size(sorted_arr)
    j = F.floor((n + 1) * 3 / 4).cast("int")
    j = F.least(F.greatest(j, F.lit(1)), n - 1)
    delta = (n + 1) * 3 - j * 4
    lo, hi = F.get(sorted_arr, j - 1), F.get(sorted_arr, j)
    return F.when(n < 4, F.element_at(sorted_arr, -1)).otherwise((lo * (4 - delta) + hi * delta) / 4)
