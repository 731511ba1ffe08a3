"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(value: Column) -> Column:
    """NaN becomes null; the engine knows one kind of missing value."""
    return F.when(~F.isnan(value), value)


def minutes(later: Column, earlier: Column) -> Column:
    """Minutes between two times, to the microsecond."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(6e7)


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null where the divisor is zero or null."""
    return F.when(bottom != 0, top / bottom)


def signed_percent(gap: Column, base: Column) -> Column:
    """gap / base * 100; a gap over a zero base is infinite with the gap's sign, 0 over 0 is null."""
    return (
        F.when(base != 0, gap / base * 100)
        .when((base == 0) & (gap > 0), F.lit(float("inf")))
        .when((base == 0) & (gap < 0), F.lit(float("-inf")))
    )


def tidy(text: Column) -> Column:
    """Text without white space at its ends, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
