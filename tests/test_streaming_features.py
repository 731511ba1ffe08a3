"""Features over a stream equal those of the batch, with rows out of order and behind the watermark."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import ranges, shifts
from shiftloom.plans import features
from shiftloom.schema import Columns
from shiftloom.streaming.features import streaming_shift_features

COLS = Columns(tag="tag", ts="ts", value="value", tiebreak="id")
KEYS = ("tag", "fecha", "turno")
SCHEMA = "tag string, ts timestamp, value double, id long"


def samples():
    rng = np.random.default_rng(21)
    rows = []
    for i in range(900):
        tag = ["a", "b", "new"][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]
        at = datetime(2024, 10, 1) + timedelta(minutes=int(rng.integers(0, 3 * 1440)))
        rows.append((tag, at, None if rng.random() < 0.02 else float(rng.integers(0, 9)), i))
    rows += [("void", datetime(2024, 10, 1, 1), None, 5000), ("void", datetime(2024, 10, 1, 2), None, 5001), ("one", datetime(2024, 10, 2, 9), 4.0, 5002), ("flat", datetime(2024, 10, 2, 9), 0.0, 5003), ("flat", datetime(2024, 10, 2, 9), 0.0, 5004)]
    return rows


def run(spark, tmp_path, batches):
    """Each list of rows is one micro-batch, written to a file of its own."""
    source, here = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    limits = ranges.tag_limits(spark.createDataFrame([("a", 1.0), ("a", 7.0), ("b", 2.0), ("void", 1.0)], "tag string, value double"), COLS)
    base = spark.createDataFrame([("a", 4.0), ("b", 0.0)], "tag string, mean_mes double")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for f in (tmp_path / f"b{i}").glob("*.parquet"):
            f.rename(source / f"{i:03d}.parquet")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        out = streaming_shift_features(stream, limits, 60.0, base, COLS, late="2 hours")
        q = out.writeStream.format("parquet").option("path", here).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    return spark.read.parquet(here), limits, base


def want(spark, rows, limits, base):
    long = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    full = features.shift_features(long, COLS, interval_min=60.0, interpolate=False)
    # The batch's own limits and baseline give way to the given ones.
    given = ranges.range_shares(long, limits, COLS, 60.0)
    from shiftloom.operators import dynamics, labels

    stats = shifts.add_gaps(shifts.shift_stats(long, COLS), base, COLS)
    joined = ranges.attach(ranges.attach(stats, given, COLS), dynamics.shift_dynamics(long, COLS), COLS, "_din")
    made = labels.label_ranges(labels.label_dynamics(joined))
    assert set(made.columns) == set(full.columns)
    return made


def compare(got, expected):
    cols = [c for c in expected.columns if c not in KEYS]
    assert sorted(got.columns) == sorted(expected.columns)
    index = lambda df: {(r.tag, r.fecha, r.turno): r for r in df.collect()}
    g, w = index(got), index(expected)
    assert set(g) == set(w) and got.count() == len(g)
    for k, r in w.items():
        for c in cols:
            assert g[k][c] == r[c] or g[k][c] == pytest.approx(r[c], rel=1e-9, abs=1e-12), (k, c, g[k][c], r[c])


def test_stream_equals_batch(spark, tmp_path):
    rows = sorted(samples(), key=lambda r: r[1])
    rng = np.random.default_rng(3)
    # Shuffled within the two hours that the watermark waits.
    jittered = [rows[i] for i in np.argsort([r[1].timestamp() + rng.uniform(0, 6000) for r in rows], kind="stable")]
    batches = [jittered[i : i + 240] for i in range(0, len(jittered), 240)]
    late = ("a", datetime(2024, 10, 1, 3), 1000.0, 9000)
    closing = ("close", datetime(2024, 10, 9), 1.0, 9001)
    got, limits, base = run(spark, tmp_path, [*batches, [closing], [late, (None, datetime(2024, 10, 9), 1.0, 9002)], [("close", datetime(2024, 10, 9, 1), 1.0, 9003)]])
    compare(got, want(spark, rows, limits, base))  # the late row is not in, the open shift of "close" not out
