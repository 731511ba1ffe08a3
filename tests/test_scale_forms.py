"""Selection of percentiles, time blocks of busy days, and the plan of the fused pipeline."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import blocks, dynamics, percentiles, quality, shifts
from shiftloom.plans import features
from shiftloom.schema import Columns

AT = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
COLS = Columns(tag="tag", ts="ts", value="value", tiebreak="id")


def test_selection_equals_percentile(spark):
    kinds = F.when(F.col("k") == "ties", F.floor(F.rand(1) * 3)).when(F.col("k") == "wide", F.exp(200 * F.randn(2))).when(F.col("k") == "one", F.lit(7.0)).when(F.col("k") == "odd", F.when(F.rand(5) < 0.4, float("inf")).when(F.rand(6) < 0.2, float("nan")).otherwise(F.randn(4))).otherwise(F.randn(3))
    names = F.array(*[F.lit(x) for x in ("ties", "wide", "one", "odd", "plain")])
    df = spark.range(60_000).select(F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("k"), "id").withColumn("v", kinds.cast("double")).withColumn("p_", F.lit("clash"))
    few = spark.createDataFrame([("few", 1, 3.0, ""), ("few", 2, 1.0, ""), ("null", 3, None, ""), ("pair", 4, 1.0, "")], df.schema)
    df = df.unionByName(few)
    got = {r[0]: r[1] for r in percentiles.group_percentiles(df, ["k"], "v", AT, small=50).collect()}
    clean = F.when(~F.isnan("v"), F.col("v"))
    want = {r[0]: r[1] for r in df.groupBy("k").agg(F.percentile(clean, F.array(*map(F.lit, AT)))).collect()}
    assert set(got) == set(want) == {"ties", "wide", "one", "odd", "plain", "few", "null", "pair"}
    for k, w in want.items():
        if w is None or k == "odd":
            continue
        assert got[k] == pytest.approx(w, rel=1e-12)
    # Infinite values: the built-in function gives NaN between equal ones.
    held = np.sort([r[0] for r in df.where("k = 'odd'").select(clean).where(clean.isNotNull()).collect()])
    for q, x in zip(AT, got["odd"]):
        low, high = held[int(np.floor(q * (len(held) - 1)))], held[int(np.ceil(q * (len(held) - 1)))]
        assert x == pytest.approx(low + (high - low) * (q * (len(held) - 1) % 1) if low != high else low)
    assert got["null"] is None and got["few"] == pytest.approx([1.0, 1.1, 1.5, 2.0, 2.5, 2.9, 3.0])


def test_selection_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert percentiles.group_percentiles(df, ["k"], "v", [0.5], small=1).count() == 0


def test_selection_sketches_a_cell_once(spark, monkeypatch):
    """However many percentiles are asked, a round has one sketch of a cell and one count of its rows."""
    made = []
    for name in ("kll_sketch_agg_double", "count_if"):
        plain = getattr(F, name)
        monkeypatch.setattr(F, name, lambda *a, plain=plain, name=name: made.append(name) or plain(*a))
    rounds, narrow = [], percentiles.narrow
    monkeypatch.setattr(percentiles, "narrow", lambda *a: rounds.append(1) or narrow(*a))
    df = spark.range(30_000).select((F.col("id") % 2).alias("k"), F.randn(3).alias("v"))
    got = {r.k: r.p_ for r in percentiles.group_percentiles(df, ["k"], "v", AT, small=40).collect()}
    want = {r.k: r.p_ for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, AT))).alias("p_")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    assert rounds and len(made) == len(rounds)


def burst(spark):
    """A tag with a busy day (most of it in one minute, with equal times), a quiet one, and gaps."""
    rng = np.random.default_rng(4)
    start = datetime(2024, 10, 1)
    rows = []
    for i in range(6000):
        minute = float(rng.choice([rng.uniform(0, 1440), 480 + rng.uniform(0, 1), 300.0], p=[0.4, 0.55, 0.05]))
        rows.append(("hot", start + timedelta(minutes=minute), None if rng.random() < 0.3 else float(rng.integers(0, 5)), i))
    for i in range(300):
        rows.append((["hot", "calm", "void"][i % 3], start + timedelta(days=int(rng.integers(-2, 4)), minutes=float(rng.uniform(0, 1440))), None if i % 3 == 2 or rng.random() < 0.5 else float(rng.normal()), 10_000 + i))
    rows += [("hot", None, 1.0, 20_000), (None, start, 1.0, 20_001), ("calm", None, None, 20_002)]
    return spark.createDataFrame(rows, "tag string, ts timestamp_ntz, value double, id long")


def test_slots_compare_times_as_they_are(spark):
    """Slots cost a comparison for each cut: no time is converted for each of them; equal times share a slot, in order of time."""
    slotted = blocks.add_slots(burst(spark), COLS, busy=100)
    assert "timestampdiff" not in slotted._jdf.queryExecution().optimizedPlan().toString().lower()
    rows = sorted((r.ts, r.slot_) for r in slotted.where("tag = 'hot' AND day_ = DATE'2024-10-01'").select("ts", "slot_").collect())
    assert [s for _, s in rows] == sorted(s for _, s in rows) and len({s for _, s in rows}) > 20
    assert len(set(rows)) == len({t for t, _ in rows})


def test_composed_form_fills_gaps_once(spark):
    """The separate operators read stored samples: the plan has neither the windows of the gaps nor the given rows."""
    plan = features.shift_features_composed(quality.interpolate_gaps(burst(spark), COLS).withColumn("value", F.col("value_interp")), COLS)._jdf.queryExecution().optimizedPlan().toString()
    assert "here_" not in plan and "LogicalRDD" not in plan and "parquet" in plan


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or p == pytest.approx(q, rel=1e-9) for p, q in zip(x, y)), (x, y)


def table(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_blocks_give_the_same(spark):
    long = burst(spark)
    slots = blocks.add_slots(long, COLS, 100).where("day_ = '2024-10-01' AND tag = 'hot'").groupBy("slot_").count()
    assert slots.count() > 20
    near(table(quality.interpolate_gaps(long, COLS, busy=100), "id"), table(quality.interpolate_gaps(long, COLS), "id"))
    for rows in (long, quality.clean_long(long, COLS)):
        near(table(dynamics.shift_dynamics(rows, COLS, busy=100), "tag", "fecha", "turno"), table(dynamics.shift_dynamics(rows, COLS), "tag", "fecha", "turno"))
    keys = ("tag", "fecha", "turno")
    near(table(features.shift_features(long, COLS, busy=100, small=50), *keys), table(features.shift_features(long, COLS), *keys))
    near(table(shifts.shift_stats(long, COLS, small=50), *keys), table(shifts.shift_stats(long, COLS), *keys))


def test_signs_by_hand(spark):
    """Signs and turns counted row by row, over blocks of one or two samples too."""
    long = burst(spark).where("value IS NOT NULL AND tag = 'hot' AND ts IS NOT NULL")
    got = {(str(r.fecha), r.turno): (r.osc_sign_changes_turno, r.osc_sign_changes_norm_turno) for r in dynamics.shift_dynamics(long, COLS, busy=1).collect()}
    by = {}
    for r in long.orderBy("ts", "id").collect():
        by.setdefault((str(r.ts.date()), ("T1_00_08", "T2_08_16", "T3_16_00")[r.ts.hour // 8]), []).append(r.value)
    for k, vs in by.items():
        signs = [s for s in np.sign(np.diff(vs)) if s]
        turns = int((np.diff(signs) != 0).sum()) if len(signs) > 1 else 0
        assert got[k] == (turns, turns / max(len(signs) - 1, 1) if len(signs) > 1 else 0.0)


def test_a_busy_day_is_many_tasks(spark):
    """No window is partitioned by less than tag, day and slot, and the slots of a busy day are even."""
    n = 400_000
    long = spark.range(n).select(F.lit("hot").alias("tag"), (F.lit("2024-10-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("id") * F.lit(86399.0) / n).cast("decimal(18,6)"))).alias("ts"), F.sin("id").alias("value"), "id")
    sizes = [r["count"] for r in blocks.add_slots(long, COLS, 100_000).groupBy("slot_").count().collect()]
    assert len(sizes) == blocks.SLOTS and max(sizes) < 2 * n / blocks.SLOTS
    plan = dynamics.shift_dynamics(long, COLS, busy=100_000)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("slot_" in w for w in windows)


def test_fused_plan_moves_samples_once(spark):
    """After the one exchange of samples by tag and day what is stored is only aggregated."""
    plan = features.shift_features(burst(spark), COLS)._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if "Exchange hashpartitioning(tag" in line and "fecha" in line and "turno" in line]
    assert len(by_key) == 1
    assert not any("Window" in line and "turno" in line for line in plan.splitlines())
    assert "SortMergeJoin" not in plan or "fecha" not in "".join(line for line in plan.splitlines() if "SortMergeJoin" in line)
