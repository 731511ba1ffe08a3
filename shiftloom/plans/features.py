"""The shift feature pipeline, fused into one pass over the shifts, and in its composed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dynamics, labels, quality, ranges, shifts
from ..operators.blocks import add_slots
from ..schema import DATE_COL, DYNAMIC_COLS, LABEL_COLS, RANGE_COLS, SHIFT_COL, STAT_COLS, Columns
from ..sources.tables import kept


def shift_features(
    long: DataFrame, cols: Columns = Columns(), history: DataFrame | None = None, interval_min: float | None = None,
    interpolate: bool = True, period: str = "all", approx: bool = False, raw: bool = True, busy: int | None = None, small: int | None = None,
) -> DataFrame:
    """One labelled row per tag, date and shift.

    ``long`` is cleaned first unless not ``raw``. Limits come from ``history`` (the same table if not
    given). Samples are exchanged once, by tag and day (or a slot of a busy day): gaps are filled and
    the steps of each shift told in that one pass, whose result is stored. What follows moves only groups:
    an aggregation by tag for limits, one for the baseline, and one by shift; tag-level tables are
    joined on the tag.
    """
    slotted = add_slots(shifts.ensure_shift(long, cols), cols, busy)
    filled = slotted
    if raw and interpolate:
        filled = quality.fill_blocks(slotted, cols, "value_interp").withColumn(cols.value, F.col("value_interp"))
    told = dynamics.with_sign_changes(filled, cols)
    needed = [c for c in (cols.tag, cols.ts, cols.value, cols.tiebreak, DATE_COL, SHIFT_COL) if c]
    clean = kept(told.select(*[f"`{c}`" for c in needed], "edge_"))
    limits = ranges.tag_limits(clean if history is None else history, cols, approx=approx)
    interval = F.lit(float(interval_min)) if interval_min is not None else ranges.sampling_interval(clean, cols).scalar()
    rows = ranges.join_limits(shifts.keyed(clean, cols), limits, cols)
    grouped = shifts.aggregate_shifts(rows, cols, [*ranges.range_aggregates(cols), *dynamics.dynamic_aggregates(cols)], approx, small)
    whole = dynamics.add_dynamics(ranges.add_shares(shifts.spread_percentiles(grouped), interval))
    gapped = shifts.add_gaps(whole, shifts.baseline(clean, cols, period), cols)
    keys = shifts.key_columns(cols)
    return labels.label_ranges(labels.label_dynamics(gapped)).select(*[f"`{c}`" for c in keys], *STAT_COLS, "mean_mes", "gap_mean", "gap_pct", *RANGE_COLS, *DYNAMIC_COLS, *LABEL_COLS)


def shift_features_composed(clean: DataFrame, cols: Columns = Columns(), interval_min: float | None = None) -> DataFrame:
    """The same features by the separate operators and their joins on the key.

    Each operator reads ``clean`` several times, so what they need of it is stored once: gaps aren't filled again for each.
    """
    needed = [c for c in (cols.tag, cols.ts, cols.value, cols.tiebreak, DATE_COL, SHIFT_COL) if c and c in clean.columns]
    clean = kept(clean.select(*[f"`{c}`" for c in needed]))
    stats = shifts.shift_gaps(clean, cols)
    with_ranges = ranges.attach(stats, ranges.range_shares(clean, ranges.tag_limits(clean, cols), cols, interval_min), cols, "_rango")
    with_dynamics = ranges.attach(with_ranges, dynamics.shift_dynamics(clean, cols), cols, "_din")
    return labels.label_ranges(labels.label_dynamics(with_dynamics))
