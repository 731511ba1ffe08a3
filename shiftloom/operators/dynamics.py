"""Dynamics within a shift: slope, variation, rate and oscillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import minutes, ratio
from ..schema import DATE_COL, DYNAMIC_COLS, SHIFT_COL, Columns
from .blocks import add_slots, fold_turns
from .shifts import key_columns, keyed


def with_sign_changes(rows: DataFrame, cols: Columns) -> DataFrame:
    """Adds edge_, on one row of each block of a shift: the block's first and last value, the first and last
    sign of a step between its values, how many signs it has and how often they change.

    Blocks are the slots of :func:`~.blocks.add_slots`, the whole shift where there is only one, so no shift is sorted
    in one task for being long; :func:`~.blocks.fold_turns` joins them. Rows are exchanged and sorted
    once, by tag, day and slot. Null values are stepped over.
    """
    order = [F.col(cols.ts), F.col(cols.tiebreak) if cols.tiebreak else F.col(cols.value)]
    block = Window.partitionBy(f"`{cols.tag}`", "day_", "slot_", DATE_COL, SHIFT_COL).orderBy(*order)
    earlier, so_far = block.rowsBetween(Window.unboundedPreceding, -1), block.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(cols.value)
    step = F.signum(v - F.last(v, ignorenulls=True).over(earlier))
    signed = rows.withColumn("step_", step).withColumn("sign_", F.when(F.col("step_") != 0, F.col("step_")))
    turned = signed.withColumns({"turn_": F.col("sign_") != F.last("sign_", ignorenulls=True).over(earlier), "final_": F.lead(F.lit(1)).over(block).isNull()})
    told = {
        "first": F.first(v, ignorenulls=True), "last": F.last(v, ignorenulls=True), "head": F.first("sign_", ignorenulls=True), "tail": F.last("sign_", ignorenulls=True),
        "signs": F.count("sign_"), "turns": F.count_if("turn_"),
    }
    whole = turned.withColumns({f"{k}_": e.over(so_far) for k, e in told.items()})
    edge = F.struct(F.col("day_").alias("day"), F.col("slot_").alias("slot"), *[F.col(f"{k}_").alias(k) for k in told])
    return whole.withColumn("edge_", F.when(F.col("final_"), edge)).drop("step_", "sign_", "turn_", "final_", *[f"{k}_" for k in told])


def dynamic_aggregates(cols: Columns) -> list[Column]:
    """Aggregates from which the dynamics follow; rows come from :func:`with_sign_changes`. A shift has at
    most as many edges as a day has slots."""
    v, ts = F.col(cols.value), F.col(cols.ts)
    since = minutes(ts, F.col(DATE_COL).cast("timestamp_ntz"))
    at = F.struct(ts, F.col(cols.tiebreak) if cols.tiebreak else v)
    return [
        F.count("*").alias("n_muestras_turno"), F.count(v).alias("valid_"), minutes(F.max(ts), F.min(ts)).alias("duracion_turno_min"),
        F.stddev_samp(v).alias("sd_"), F.avg(v).alias("mean_"), F.regr_slope(v, since).alias("fit_"), F.min(ts).alias("from_"), F.max(ts).alias("to_"),
        F.max_by(v, at).alias("last_"), F.min_by(v, at).alias("first_"), F.collect_list("edge_").alias("edges_"),
    ]


def add_dynamics(df: DataFrame) -> DataFrame:
    """The seven dynamics from their aggregates. A null sample makes variation and slope null; a shift
    without any value has null oscillation; equal times have no slope and no rate."""
    whole = (F.col("valid_") == F.col("n_muestras_turno")) & (F.col("n_muestras_turno") > 1)
    some = F.col("valid_") > 0
    folded = df.withColumn("fold_", fold_turns(F.col("edges_"))).withColumns({"signs_": F.col("fold_.signs"), "turns_": F.col("fold_.turns")})
    out = folded.withColumns(
        {
            "cv_turno": F.when(whole, ratio(F.col("sd_"), F.col("mean_"))),
            "slope_turno": F.when(whole & (F.col("from_") != F.col("to_")), F.col("fit_")),
            "rate_mean_turno": F.when(F.col("n_muestras_turno") > 1, ratio(F.col("last_") - F.col("first_"), F.col("duracion_turno_min"))),
            "osc_sign_changes_turno": F.when(some, F.col("turns_")),
            "osc_sign_changes_norm_turno": F.when(some, F.when(F.col("signs_") < 2, F.lit(0.0)).otherwise(F.col("turns_") / F.greatest(F.col("signs_") - 1, F.lit(1)))),
        }
    )
    return out.drop("valid_", "sd_", "mean_", "fit_", "from_", "to_", "last_", "first_", "edges_", "fold_", "signs_", "turns_")


def shift_dynamics(long: DataFrame, cols: Columns = Columns(), busy: int | None = None) -> DataFrame:
    """Dynamics per tag, date and shift; rows are exchanged once. A day with more than ``busy`` samples of a tag
    is spread over tasks."""
    keys = key_columns(cols)
    out = add_dynamics(with_sign_changes(add_slots(keyed(long, cols), cols, busy), cols).groupBy(*keys).agg(*dynamic_aggregates(cols)))
    return out.select(*[f"`{c}`" for c in keys], *DYNAMIC_COLS)
