"""Shift calendar, statistics per shift, baselines and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import signed_percent
from ..schema import DATE_COL, SHIFT_COL, SHIFTS, Columns, require
from .percentiles import SMALL, group_percentiles


def shift_label(ts: Column, calendar: tuple[tuple[str, int], ...] = SHIFTS) -> Column:
    """Name of the shift by hour; ``calendar`` lists (name, hour at which it ends) in order.

    A null time gets the last name, and drops out where its null date is a key.
    """
    out = F.lit(calendar[-1][0])
    for name, end in reversed(calendar[:-1]):
        out = F.when(F.hour(ts) < end, name).otherwise(out)
    return out


def add_shift(long: DataFrame, cols: Columns = Columns(), calendar: tuple[tuple[str, int], ...] = SHIFTS) -> DataFrame:
    """Sets the shift and its date (no shift crosses midnight)."""
    require(long, cols.ts)
    return long.withColumns({SHIFT_COL: shift_label(F.col(cols.ts), calendar), DATE_COL: F.to_date(cols.ts)})


def ensure_shift(long: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Sets the shift or its date only where the column is missing."""
    made = {SHIFT_COL: shift_label(F.col(cols.ts)), DATE_COL: F.to_date(cols.ts)}
    return long.withColumns({c: e for c, e in made.items() if c not in long.columns})


def key_columns(cols: Columns) -> list[str]:
    return [cols.tag, DATE_COL, SHIFT_COL]


def keyed(long: DataFrame, cols: Columns) -> DataFrame:
    """Rows that can be grouped: no null tag, time, date or shift."""
    whole = F.lit(True)
    for c in (*key_columns(cols), cols.ts):
        whole = whole & F.col(f"`{c}`").isNotNull()
    return ensure_shift(long, cols).where(whole)


PERCENTILES = (0.1, 0.5, 0.9)


def moments(cols: Columns) -> list[Column]:
    """Mean, sample deviation, least and greatest; nulls are skipped."""
    v = F.col(cols.value)
    return [F.avg(v).alias("mean_turno"), F.stddev_samp(v).alias("std_turno"), F.min(v).alias("min_turno"), F.max(v).alias("max_turno")]


def shift_percentiles(cols: Columns, approx: bool = False) -> Column:
    """10th, 50th and 90th percentile as an array; exact ones hold a group's distinct values."""
    v, at = F.col(cols.value), list(PERCENTILES)
    return (F.percentile_approx(v, at) if approx else F.percentile(v, F.array(*map(F.lit, at)))).alias("p_")


def has_large(rows: DataFrame, keys: list[str], small: int) -> bool:
    """Whether some group has over ``small`` rows."""
    counts = rows.groupBy(*[f"`{k}`" for k in keys]).agg(F.count("*").alias("n_"))
    return (counts.agg(F.max("n_")).first()[0] or 0) > small


def aggregate_shifts(rows: DataFrame, cols: Columns, more: list[Column], approx: bool = False, small: int | None = None) -> DataFrame:
    """Rows by tag, date and shift: the statistics, percentiles as p_, and ``more`` aggregates, in one aggregation.

    Where a shift has over ``small`` samples, exact percentiles are selected apart and joined on the key.
    """
    keys = key_columns(cols)
    by_key = rows.groupBy(*[f"`{k}`" for k in keys])
    if approx or not has_large(rows, keys, SMALL if small is None else small):
        return by_key.agg(*moments(cols), shift_percentiles(cols, approx), *more)
    return by_key.agg(*moments(cols), *more).join(group_percentiles(rows, keys, cols.value, list(PERCENTILES), "p_", small), keys)


def spread_percentiles(df: DataFrame) -> DataFrame:
    """The array of percentiles as three columns."""
    names = {f"p{k}_turno": F.get("p_", F.lit(i)) for i, k in enumerate((10, 50, 90))}
    return df.withColumns(names).drop("p_")


def shift_stats(long: DataFrame, cols: Columns = Columns(), approx: bool = False, small: int | None = None) -> DataFrame:
    """Seven statistics per tag, date and shift. Raises ``ValueError`` if a column is missing."""
    require(long, cols.tag, cols.ts, cols.value)
    out = spread_percentiles(aggregate_shifts(keyed(long, cols), cols, [], approx, small))
    return out.select(*[f"`{c}`" for c in key_columns(cols)], "mean_turno", "std_turno", "min_turno", "max_turno", "p10_turno", "p50_turno", "p90_turno")


def baseline(long: DataFrame, cols: Columns = Columns(), period: str = "all") -> DataFrame:
    """Mean of all values by tag as ``mean_mes``; by tag and month unless ``period`` is ``all``.

    ``calendar_month`` compares a shift with its own month, ``previous_month`` with the month before.
    """
    require(long, cols.tag, cols.value)
    rows = long.where(F.col(f"`{cols.tag}`").isNotNull())
    if period == "all":
        return rows.groupBy(cols.tag).agg(F.avg(cols.value).alias("mean_mes"))
    month = F.trunc(F.to_date(cols.ts), "month")
    serves = {"calendar_month": month, "previous_month": F.add_months(month, 1)}[period]
    return rows.where(F.col(cols.ts).isNotNull()).groupBy(cols.tag, serves.alias("month_")).agg(F.avg(cols.value).alias("mean_mes"))


def add_gaps(stats: DataFrame, base: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Left join of the baseline, then absolute and relative gap of the shift's mean."""
    own = base.withColumnRenamed(cols.tag, "tag_b")
    on = F.col(f"`{cols.tag}`") == F.col("tag_b")
    if "month_" in own.columns:
        on = on & (F.trunc(DATE_COL, "month") == F.col("month_"))
    gap = F.col("mean_turno") - F.col("mean_mes")
    return stats.join(own, on, "left").drop("tag_b", "month_").withColumn("gap_mean", gap).withColumn("gap_pct", signed_percent(F.col("gap_mean"), F.col("mean_mes")))


def shift_gaps(long: DataFrame, cols: Columns = Columns(), period: str = "all") -> DataFrame:
    """Statistics per shift with the gap to the tag's baseline."""
    return add_gaps(shift_stats(long, cols), baseline(long, cols, period), cols)
