"""Limits of long histories from mergeable quantile sketches, stored by tag and day."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import no_nan
from ..schema import DATE_COL, Columns, require
from ..sources.tables import kept
from .percentiles import SMALL, select_ranks

#: Size of a sketch. A quantile's rank is then off by less than RANK_ERROR (of all values) with 99 % confidence,
#: however many sketches are merged; up to about SIZE values nothing is lost.
SIZE, RANK_ERROR = 4096, 0.002


def number(cols: Columns) -> Column:
    return no_nan(F.col(f"`{cols.value}`").cast("double"))


def sketched(long: DataFrame, cols: Columns) -> DataFrame:
    """The rows that sketches count."""
    return long.where(F.col(f"`{cols.tag}`").isNotNull() & F.col(cols.ts).isNotNull() & number(cols).isNotNull())


def inside(day: Column, start: date | None, end: date | None) -> Column:
    """Whether a date is in the period."""
    out = F.lit(True)
    if start is not None:
        out = out & (day >= F.lit(start))
    if end is not None:
        out = out & (day <= F.lit(end))
    return out


def day_sketches(long: DataFrame, cols: Columns = Columns(), size: int = SIZE) -> DataFrame:
    """A row for each tag and date: n_values and the sketch of its values. Null values and NaN, and rows without tag or
    time, are left out. Written by date, days that change are overwritten alone."""
    require(long, cols.tag, cols.ts, cols.value)
    v = number(cols)
    return sketched(long, cols).groupBy(f"`{cols.tag}`", F.to_date(cols.ts).alias(DATE_COL)).agg(F.count("*").alias("n_values"), F.kll_sketch_agg_double(v, size).alias("sketch"))


def merged_limits(sketches: DataFrame, cols: Columns = Columns(), start: date | None = None, end: date | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """lim_inf and lim_sup by tag over the days from ``start`` to ``end``, both included (None: open), from the
    sketches alone: values at those ranks, off by RANK_ERROR of all values at most (99 %)."""
    merged = sketches.where(inside(F.col(DATE_COL).cast("date"), start, end)).groupBy(f"`{cols.tag}`").agg(F.kll_merge_agg_double("sketch").alias("s_"))
    at = lambda q: F.kll_sketch_get_quantile_double("s_", F.lit(float(q)))
    return merged.select(f"`{cols.tag}`", at(low).alias("lim_inf"), at(high).alias("lim_sup"))


def merged_bounds(sketches: DataFrame, cols: Columns = Columns(), start: date | None = None, end: date | None = None, factor: float = 1.5) -> DataFrame:
    """q1, q3, low and high by tag as :func:`~.quality.iqr_bounds` gives them, from sketches."""
    return add_bounds(merged_limits(sketches, cols, start, end, 0.25, 0.75).withColumnsRenamed({"lim_inf": "q1", "lim_sup": "q3"}), factor)


def exact_quantiles(sketches: DataFrame, long: DataFrame, at: list[float], cols: Columns = Columns(), start: date | None = None, end: date | None = None) -> DataFrame:
    """The tag and the array q_: for each of ``at`` the least value of at least that rank, exactly, over the days from
    ``start`` to ``end``. ``sketches`` are those of the samples ``long``.

    The merged sketches tell between which values a rank is; counts of the samples decide, and only values so near that
    a sketch can't tell them apart are sorted.
    """
    tag = F.col(f"`{cols.tag}`").alias("k0_")
    merged = sketches.where(inside(F.col(DATE_COL).cast("date"), start, end)).groupBy(tag).agg(F.sum("n_values").alias("n_"), F.kll_merge_agg_double("sketch").alias("s_"))
    merged = kept(merged)
    # Decimals, as products of doubles may lie above a whole rank.
    ranks = [F.greatest(F.lit(0), F.ceil(F.lit(Decimal(str(q))) * F.col("n_").cast("decimal(18,0)")).cast("long") - 1) for q in at]
    rows = sketched(long, cols).where(inside(F.to_date(cols.ts), start, end)).select(tag, number(cols).alias("v_"))
    found = select_ranks(rows, ["k0_"], merged.select("k0_", "n_", F.array(*ranks).alias("ranks_")), SMALL, merged.select("k0_", "s_"))
    return found.select(F.col("k0_").alias(cols.tag), F.col("at_").alias("q_"))


def exact_limits(sketches: DataFrame, long: DataFrame, cols: Columns = Columns(), start: date | None = None, end: date | None = None, low: float = 0.05, high: float = 0.95, factor: float = 1.5) -> DataFrame:
    """What :func:`merged_limits` and :func:`merged_bounds` give together, exactly, however many values there are."""
    q = exact_quantiles(sketches, long, [low, high, 0.25, 0.75], cols, start, end)
    names = ("lim_inf", "lim_sup", "q1", "q3")
    return add_bounds(q.select(f"`{cols.tag}`", *[F.get("q_", F.lit(i)).alias(n) for i, n in enumerate(names)]), factor)


def add_bounds(q: DataFrame, factor: float) -> DataFrame:
    """low and high from q1 and q3."""
    reach = F.lit(factor) * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.when(reach != 0, F.col("q1") - reach), "high": F.when(reach != 0, F.col("q3") + reach)})
