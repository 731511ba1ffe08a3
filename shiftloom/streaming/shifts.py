"""Shift statistics over a stream of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import no_nan
from ..operators.shifts import shift_label
from ..schema import DATE_COL, SHIFT_COL, Columns, require


def streaming_shift_stats(stream: DataFrame, cols: Columns = Columns(), late: str = "1 hour", limits: DataFrame | None = None) -> DataFrame:
    """Mean, deviation, least and greatest per tag and 8-hour window, and range counts against stored
    limits; a shift is final once the watermark has passed it. The time must have a zone (streaming
    windows need it); windows coincide with the three shifts if the session's zone is UTC.

    Percentiles and sign changes need all rows of a shift in order and stay with the batch pipeline.
    """
    require(stream, cols.tag, cols.ts, cols.value)
    v = no_nan(F.col(cols.value))
    rows = stream.where(F.col(f"`{cols.tag}`").isNotNull()).withWatermark(cols.ts, late)
    more = []
    if limits is not None:
        own = limits.select(F.col(f"`{cols.tag}`").alias("tag_l"), "lim_inf", "lim_sup")
        rows = rows.join(own, F.col(f"`{cols.tag}`") == F.col("tag_l"), "left")
        more = [F.count_if(v < F.col("lim_inf")).alias("n_bajo"), F.count_if(v > F.col("lim_sup")).alias("n_alto")]
    out = rows.groupBy(cols.tag, F.window(cols.ts, "8 hours").alias("w")).agg(
        F.count("*").alias("n_muestras"), F.avg(v).alias("mean_turno"), F.stddev_samp(v).alias("std_turno"), F.min(v).alias("min_turno"), F.max(v).alias("max_turno"), *more
    )
    made = out.withColumns({DATE_COL: F.to_date("w.start"), SHIFT_COL: shift_label(F.col("w.start"))})
    return made.drop("w")
