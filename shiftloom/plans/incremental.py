"""The feature pipeline kept up to date: only days that a change reaches are worked on again."""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dynamics, labels, quality, ranges, shifts
from ..operators.blocks import add_slots
from ..schema import DATE_COL, DYNAMIC_COLS, LABEL_COLS, RANGE_COLS, SHIFT_COL, STAT_COLS, Columns
from ..sources.tables import kept

#: Tables below the path of a feature store, each partitioned by date.
DAYS, SHIFTS_, SUMS = "days", "shifts", "sums"


def stored_table(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table of the store with its date as a date, or nothing before the first update."""
    try:
        found = spark.read.parquet(f"{path}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.withColumn(DATE_COL, F.col(DATE_COL).cast("date"))


def overwrite_dates(df: DataFrame, path: str) -> None:
    """Writes ``df`` over the dates that it holds and no others."""
    df.repartition(DATE_COL).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE_COL).parquet(path)


def update_features(
    long: DataFrame, path: str, limits: DataFrame, interval_min: float, dates: list[date] | None = None,
    cols: Columns = Columns(), interpolate: bool = True, busy: int | None = None, small: int | None = None,
) -> list[date]:
    """Brings the store at ``path`` up to date with ``long`` after the rows of ``dates`` changed (None: all). Returns the dates
    whose features were written.

    The store keeps, by date: for each tag the day's first and last value with their places (``days``), the features
    that need no other day (``shifts``), and sums of filled values (``sums``), from which baselines of any
    period are merged when features are read. A changed day can change what a gap on another day is filled with:
    such days are found by comparing what the table of days says about their neighbours before
    and after, and are worked on too. Samples of other days aren't read. ``limits`` and the
    sampling interval are given, as they come from a history of their own. Rows without a time or tag have
    no date and are left out. Dates may gain and lose rows; one that has lost all of them keeps its last features.
    """
    spark = long.sparkSession
    dated = long.where(F.col(f"`{cols.tag}`").isNotNull() & F.col(cols.ts).isNotNull())
    of = lambda d: d.isin(*dates) if dates is not None else F.lit(True)
    old = stored_table(spark, path, DAYS)
    touched = None
    around = None
    if interpolate:
        changed = add_slots(dated.where(of(F.to_date(cols.ts))), cols, busy)
        new = kept(quality.day_blocks(changed, cols))
        every = new
        if old is not None and dates is not None:
            was = old.withColumnRenamed(DATE_COL, "d_")
            every = was.where(~F.col("d_").isin(*dates)).unionByName(new) if dates else was
        around = kept(quality.around_days(every))
        if old is not None and dates is not None:
            before = quality.around_days(old.withColumnRenamed(DATE_COL, "d_")).select("tag_", "d_", F.col("before_").alias("b_"), F.col("after_").alias("a_"))
            same = F.col("before_").eqNullSafe(F.col("b_")) & F.col("after_").eqNullSafe(F.col("a_"))
            moved = around.where("has_nulls_").join(before, ["tag_", "d_"]).where(~same).select("d_").distinct()
            touched = sorted({*dates, *[r["d_"] for r in moved.collect()]})  # dates
        overwrite_dates(new.withColumnRenamed("d_", DATE_COL), f"{path}/{DAYS}")
    elif dates is not None:
        touched = sorted(dates)
    rows = dated if touched is None else dated.where(F.to_date(cols.ts).isin(*touched))
    slotted = add_slots(shifts.ensure_shift(rows, cols), cols, busy)
    if interpolate:
        slotted = quality.fill_blocks(slotted, cols, "value_interp", around).withColumn(cols.value, F.col("value_interp"))
    told = dynamics.with_sign_changes(slotted, cols)
    clean = kept(told.select(*[f"`{c}`" for c in (cols.tag, cols.ts, cols.value, cols.tiebreak, DATE_COL, SHIFT_COL) if c], "edge_"))
    limited = ranges.join_limits(clean, limits, cols)
    grouped = shifts.aggregate_shifts(limited, cols, [*ranges.range_aggregates(cols), *dynamics.dynamic_aggregates(cols)], small=small)
    whole = dynamics.add_dynamics(ranges.add_shares(shifts.spread_percentiles(grouped), F.lit(float(interval_min))))
    overwrite_dates(whole.select(f"`{cols.tag}`", DATE_COL, SHIFT_COL, *STAT_COLS, *RANGE_COLS, *DYNAMIC_COLS), f"{path}/{SHIFTS_}")
    sums = clean.groupBy(f"`{cols.tag}`", DATE_COL).agg(F.sum(cols.value).alias("sum_"), F.count(cols.value).alias("n_"))
    overwrite_dates(sums, f"{path}/{SUMS}")
    return [r[0] for r in clean.select(DATE_COL).distinct().orderBy(DATE_COL).collect()]  # dates


def read_store(spark: SparkSession, path: str, cols: Columns = Columns(), period: str = "all") -> DataFrame:
    """The labelled features of a store; baselines of ``period`` are merged from the sums by day."""
    sums = stored_table(spark, path, SUMS).where(F.col("n_") > 0)
    mean = (F.sum("sum_") / F.sum("n_")).alias("mean_mes")
    month = F.trunc(DATE_COL, "month")
    if period == "all":
        base = sums.groupBy(f"`{cols.tag}`").agg(mean)
    else:
        base = sums.groupBy(f"`{cols.tag}`", {"calendar_month": month, "previous_month": F.add_months(month, 1)}[period].alias("month_")).agg(mean)
    gapped = shifts.add_gaps(stored_table(spark, path, SHIFTS_), base, cols)
    keys = shifts.key_columns(cols)
    return labels.label_ranges(labels.label_dynamics(gapped)).select(*[f"`{c}`" for c in keys], *STAT_COLS, "mean_mes", "gap_mean", "gap_pct", *RANGE_COLS, *DYNAMIC_COLS, *LABEL_COLS)
