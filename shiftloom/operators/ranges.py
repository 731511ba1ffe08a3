"""Normal ranges and time in range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import minutes
from ..schema import RANGE_COLS, Columns
from .percentiles import group_percentiles
from .shifts import key_columns, keyed


def tag_limits(history: DataFrame, cols: Columns = Columns(), low: float = 0.05, high: float = 0.95, approx: bool = False) -> DataFrame:
    """lim_inf and lim_sup by tag: two percentiles of its history.

    Exact ones of a large tag are selected in rounds; ``approx`` takes approximate ones in one pass.
    """
    rows = history.where(F.col(f"`{cols.tag}`").isNotNull())
    out = rows.groupBy(cols.tag).agg(F.percentile_approx(cols.value, [low, high]).alias("p_")) if approx else group_percentiles(rows, [cols.tag], cols.value, [low, high])
    return out.select(f"`{cols.tag}`", F.get("p_", F.lit(0)).alias("lim_inf"), F.get("p_", F.lit(1)).alias("lim_sup"))


def sampling_interval(long: DataFrame, cols: Columns = Columns(), fallback: float = 10.0) -> DataFrame:
    """One row: median minutes between consecutive samples of the first tag (the least name).

    Gaps within a day come from a window over the day, gaps between days from one summary row per
    day, so the tag's history isn't sorted in one task. ``fallback`` if it has fewer than two samples.
    """
    rows = long.where(F.col(f"`{cols.tag}`").isNotNull() & F.col(cols.ts).isNotNull())
    first = rows.agg(F.min(f"`{cols.tag}`").alias("t"))
    own = rows.where(F.col(f"`{cols.tag}`") == first.scalar()).select(F.col(cols.ts).alias("ts"), F.to_date(cols.ts).alias("d"))
    inside = own.select("ts", F.lag("ts").over(Window.partitionBy("d").orderBy("ts")).alias("before"))
    days = own.groupBy("d").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    between = days.select("ts", F.lag("last").over(Window.orderBy("d")).alias("before"))
    gaps = inside.unionByName(between).where(F.col("before").isNotNull()).select(minutes(F.col("ts"), F.col("before")).alias("m"))
    return gaps.agg(F.coalesce(F.percentile("m", 0.5), F.lit(fallback)).alias("interval_min"))


def join_limits(long: DataFrame, limits: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Left join of the limits on the tag; tags without limits have null limits."""
    own = limits.select(F.col(f"`{cols.tag}`").alias("tag_l"), "lim_inf", "lim_sup")
    return long.join(own, F.col(f"`{cols.tag}`") == F.col("tag_l"), "left").drop("tag_l")


def range_aggregates(cols: Columns) -> list[Column]:
    """Samples, and those strictly below and above; a null value or limit counts as in range."""
    v = F.col(cols.value)
    return [F.count("*").alias("n_muestras"), F.count_if(v < F.col("lim_inf")).alias("low_"), F.count_if(v > F.col("lim_sup")).alias("high_")]


def add_shares(df: DataFrame, interval: Column) -> DataFrame:
    """Per cent and minutes in, below and above range from the counts."""
    n, low, high = F.col("n_muestras"), F.col("low_"), F.col("high_")
    inside = n - low - high
    counts = {"en_rango": inside, "bajo": low, "alto": high}
    out = df.withColumns({f"pct_{k}": c / n * 100 for k, c in counts.items()})
    return out.withColumns({f"tiempo_{k}_min": c * interval for k, c in counts.items()}).drop("low_", "high_")


def range_shares(long: DataFrame, limits: DataFrame, cols: Columns = Columns(), interval_min: float | None = None) -> DataFrame:
    """Time in range per tag, date and shift; the sampling interval is estimated if not given."""
    interval = F.lit(float(interval_min)) if interval_min is not None else sampling_interval(long, cols).scalar()
    counted = join_limits(keyed(long, cols), limits, cols).groupBy(*key_columns(cols)).agg(*range_aggregates(cols))
    return add_shares(counted, interval).select(*[f"`{c}`" for c in key_columns(cols)], *RANGE_COLS)


def attach(features: DataFrame, more: DataFrame, cols: Columns = Columns(), suffix: str = "_rango") -> DataFrame:
    """Left join on tag, date and shift; a column that both have gets ``suffix`` on the right side."""
    keys = key_columns(cols)
    taken = set(features.columns)
    renamed = more.withColumnsRenamed({c: f"{c}{suffix}" for c in more.columns if c in taken and c not in keys})
    return features.join(renamed, keys, "left")
