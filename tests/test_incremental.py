"""The feature store after late days, against full runs; and which files an update writes."""

from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import ranges
from shiftloom.plans import features, incremental
from shiftloom.schema import Columns

COLS = Columns(tag="tag", ts="ts", value="value", tiebreak="id")
KEYS = ("tag", "fecha", "turno")


def history(spark):
    """Three tags over eight days; some days begin or end with gaps, one tag pauses for days."""
    rng = np.random.default_rng(11)
    rows = []
    for day in range(8):
        for tag in ("a", "b", "c"):
            if tag == "c" and day in (2, 3, 4):
                continue
            for i in range(24):
                null = rng.random() < 0.3 or (tag == "b" and day in (3, 5)) or (tag == "a" and day == 6 and i > 18)
                rows.append((tag, datetime(2024, 3, 28) + timedelta(days=day, hours=i, minutes=int(rng.integers(0, 60))), None if null else float(rng.normal(5, 2)), len(rows)))
    return spark.createDataFrame([*rows, (None, datetime(2024, 3, 28), 1.0, 9000), ("a", None, 1.0, 9001)], "tag string, ts timestamp_ntz, value double, id long")


def table(df):
    return {tuple(r[k] for k in KEYS): r for r in df.orderBy(*KEYS).collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, r in want.items():
        for x, y in zip(got[k], r):
            assert x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12)


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


@pytest.mark.parametrize("period", ["all", "calendar_month"])
@pytest.mark.parametrize("late", [4, 6])
def test_a_late_day(spark, tmp_path, late, period):
    long = history(spark)
    limits = ranges.tag_limits(long, COLS)
    day = date(2024, 3, 28) + timedelta(days=late)
    path = str(tmp_path / "store")
    early = long.where(F.to_date("ts") != day)
    incremental.update_features(early, path, limits, 60.0, None, COLS)
    full = lambda rows: table(features.shift_features(rows, COLS, history=long, interval_min=60.0, period=period))
    read = lambda: table(incremental.read_store(spark, path, COLS, period))
    same(read(), full(early.where("tag IS NOT NULL AND ts IS NOT NULL")))
    was, before = files(path), read()
    wrote = incremental.update_features(long, path, limits, 60.0, [day], COLS)
    same(read(), full(long.where("tag IS NOT NULL AND ts IS NOT NULL")))
    assert day in wrote and len(wrote) < 8
    kept = {f for f, t in files(path).items() if was.get(f) == t}
    assert {f for f in was if not any(f"fecha={d}" in f for d in wrote)} <= kept
    # Apart from the baseline and what follows from it, rows of other days are as they were.
    for k, r in read().items():
        if k[1] not in wrote:
            assert [r[c] for c in ("mean_turno", "p50_turno", "n_muestras", "slope_turno")] == [before[k][c] for c in ("mean_turno", "p50_turno", "n_muestras", "slope_turno")]


def test_without_filling_only_the_day_is_written(spark, tmp_path):
    long = history(spark)
    limits, path, day = ranges.tag_limits(long, COLS), str(tmp_path / "store"), date(2024, 3, 31)
    incremental.update_features(long.where(F.to_date("ts") != day), path, limits, 60.0, None, COLS, interpolate=False)
    assert incremental.update_features(long, path, limits, 60.0, [day], COLS, interpolate=False) == [day]
    want = features.shift_features(long.where("tag IS NOT NULL AND ts IS NOT NULL"), COLS, history=long, interval_min=60.0, interpolate=False)
    same(table(incremental.read_store(spark, path, COLS)), table(want))


def test_busy_days(spark, tmp_path):
    long = history(spark)
    limits, path, day = ranges.tag_limits(long, COLS), str(tmp_path / "store"), date(2024, 4, 1)
    incremental.update_features(long.where(F.to_date("ts") != day), path, limits, 60.0, None, COLS, busy=5, small=3)
    incremental.update_features(long, path, limits, 60.0, [day], COLS, busy=5, small=3)
    same(table(incremental.read_store(spark, path, COLS)), table(features.shift_features(long.where("tag IS NOT NULL AND ts IS NOT NULL"), COLS, history=long, interval_min=60.0)))
