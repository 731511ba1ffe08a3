"""Features and labels of shifts over a stream: keyed state holds a shift's samples until the watermark has passed it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.expressions import no_nan, signed_percent
from ..operators import labels
from ..operators.shifts import shift_label
from ..schema import DATE_COL, DYNAMIC_COLS, RANGE_COLS, SHIFT_COL, STAT_COLS, Columns, require

HOURS = 8


def shift_figures(ts: np.ndarray, value: np.ndarray, low: float, high: float, interval_min: float) -> dict[str, float | int | None]:
    """Statistics, range shares and dynamics of one shift from its samples in order: times in microseconds, values with NaN
    for null. Same rules as the batch operators; None where those give null."""
    have = value[~np.isnan(value)]
    n, whole = len(value), len(have) == len(value) and len(value) > 1
    out: dict[str, float | int | None] = dict.fromkeys((*STAT_COLS, *RANGE_COLS, *DYNAMIC_COLS))
    out |= {"n_muestras": n, "n_muestras_turno": n, "duracion_turno_min": (ts[-1] - ts[0]) / 6e7}
    if len(have):
        deviation = float(np.std(have, ddof=1)) if len(have) > 1 else None
        p10, p50, p90 = np.percentile(have, (10, 50, 90)).tolist()
        out |= {"mean_turno": float(have.mean()), "std_turno": deviation, "min_turno": float(have.min()), "max_turno": float(have.max()), "p10_turno": p10, "p50_turno": p50, "p90_turno": p90}
        if whole and out["mean_turno"] != 0:
            out["cv_turno"] = deviation / out["mean_turno"]
        signs = np.sign(np.diff(have))
        signs = signs[signs != 0]
        turns = int((signs[1:] != signs[:-1]).sum())
        out |= {"osc_sign_changes_turno": turns, "osc_sign_changes_norm_turno": turns / (len(signs) - 1) if len(signs) > 1 else 0.0}
    if whole and ts[-1] != ts[0]:
        m = (ts - ts[0]) / 6e7
        m = m - m.mean()
        out["slope_turno"] = float((m * (value - value.mean())).sum() / (m * m).sum())
    if n > 1 and ts[-1] != ts[0] and not np.isnan(value[[0, -1]]).any():
        out["rate_mean_turno"] = float((value[-1] - value[0]) / out["duracion_turno_min"])
    below, above = int((have < low).sum()), int((have > high).sum())  # no limit is NaN: all in range
    for name, k in (("en_rango", n - below - above), ("bajo", below), ("alto", above)):
        out |= {f"pct_{name}": k / n * 100, f"tiempo_{name}_min": k * interval_min}
    return out


def streaming_shift_features(stream: DataFrame, limits: DataFrame, interval_min: float, base: DataFrame | None = None, cols: Columns = Columns(), late: str = "1 hour") -> DataFrame:
    """The labelled features of every shift of a stream, each once, when the watermark (``late`` behind the newest time)
    has passed the shift's end: rows may come in any order until then; rows behind the watermark are dropped by Spark.

    ``stream`` has tag, time with a zone, value, and the tie-break if ``cols`` names one (equal times are then in its
    order, else in that of values). State is keyed by tag, date and shift and holds the shift's samples;
    a timer at its end emits one row and clears it. Limits, the sampling interval and the baseline
    ``base`` (tag, mean_mes; without it gaps are null) are tables of earlier data, as no stream has
    its whole history at hand. Gaps aren't filled. Append mode. Shifts end at hours of the session's zone, which
    should be UTC. Rows without tag or time are left out; shifts of tags without limits count as in range.
    """
    require(stream, cols.tag, cols.ts, cols.value)
    keys = [DATE_COL, SHIFT_COL]
    at = F.col(cols.ts)
    tie = F.col(cols.tiebreak).cast("double") if cols.tiebreak else no_nan(F.col(cols.value).cast("double"))
    # Hours from the epoch number the shifts; in UTC they begin with the days.
    end = (F.floor(F.unix_micros(at) / (HOURS * 3_600_000_000)) + 1).cast("long") * HOURS * 3_600_000
    own = limits.select(F.col(f"`{cols.tag}`").alias("tag_l"), "lim_inf", "lim_sup")
    rows = stream.where(F.col(f"`{cols.tag}`").isNotNull() & at.isNotNull()).withWatermark(cols.ts, late)
    rows = rows.select(at.alias("at_"), F.col(f"`{cols.tag}`").cast("string").alias("tag_"), F.to_date(at).cast("string").alias(DATE_COL), shift_label(at).alias(SHIFT_COL), F.unix_micros(at).alias("ts_"), tie.alias("tie_"), no_nan(F.col(cols.value).cast("double")).alias("value_"), end.alias("end_"))
    rows = rows.join(own, F.col("tag_") == F.col("tag_l"), "left").drop("tag_l")
    # Joined before the state, which keeps one of each: Spark can't join what leaves it.
    if base is not None:
        rows = rows.join(base.select(F.col(f"`{cols.tag}`").alias("tag_b"), "mean_mes"), F.col("tag_") == F.col("tag_b"), "left").drop("tag_b")
    else:
        rows = rows.withColumn("mean_mes", F.lit(None).cast("double"))
    numbers = ["mean_mes", *STAT_COLS, *RANGE_COLS, *DYNAMIC_COLS]
    longs = {"n_muestras", "n_muestras_turno", "osc_sign_changes_turno"}
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("tag_", *keys)] + [T.StructField(c, T.LongType() if c in longs else T.DoubleType()) for c in numbers])
    state = T.StructType([*[T.StructField(c, T.ArrayType(T.LongType() if c == "ts" else T.DoubleType())) for c in ("ts", "tie", "value")], *[T.StructField(c, T.DoubleType()) for c in ("low", "high", "mean")]])

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            ts, tie, value, low, high, mean = held.get
            held.remove()
            times, ties, values = (np.array(x, dtype=d) for x, d in ((ts, np.int64), (tie, float), (value, float)))
            order = np.lexsort((np.where(np.isnan(ties), -np.inf, ties), times))
            figures = shift_figures(times[order], values[order], np.nan if low is None else low, np.nan if high is None else high, interval_min)
            row = dict(zip(("tag_", *keys), key)) | figures | {"mean_mes": mean}
            yield pd.DataFrame([row]).astype({c: "Int64" if c in longs else "float64" for c in numbers})
            return
        ts, tie, value, low, high, mean = held.get if held.exists else ([], [], [], None, None, None)
        ts, tie, value = list(ts), list(tie), list(value)
        ends = 0
        for b in batches:
            ts += b["ts_"].tolist()
            tie += b["tie_"].astype(float).tolist()
            value += b["value_"].astype(float).tolist()
            ends = int(b["end_"].iloc[0])
            low, high, mean = (None if pd.isna(x) else float(x) for x in b[["lim_inf", "lim_sup", "mean_mes"]].iloc[0])
        held.update((ts, tie, value, low, high, mean))
        held.setTimeoutTimestamp(max(ends, held.getCurrentWatermarkMs() + 1))

    out = rows.groupBy("tag_", *keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    gap = F.col("mean_turno") - F.col("mean_mes")
    out = out.withColumn("gap_mean", gap).withColumn("gap_pct", signed_percent(F.col("gap_mean"), F.col("mean_mes")))
    return labels.label_ranges(labels.label_dynamics(out)).withColumn(DATE_COL, F.to_date(DATE_COL)).withColumnRenamed("tag_", cols.tag)
