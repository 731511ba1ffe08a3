"""Limits from stored sketches, and generation that goes on where it stopped."""

from datetime import date, datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.operators import sketches, textgen
from shiftloom.schema import Columns

COLS = Columns(tag="tag", ts="ts", value="value")


def test_limits_of_a_year_from_sketches(spark, tmp_path):
    """300,000 values of a tag, in 365 sketches: ranks are off by less than stated, and no sample is read."""
    long = spark.range(300_000).select(
        F.when(F.col("id") % 2 == 0, "even").otherwise("skewed").alias("tag"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("id") % 365).cast("int"))).alias("ts"),
        F.when(F.col("id") % 2 == 0, F.randn(3)).otherwise(F.exp(9 * F.randn(4))).alias("value"),
    )
    odd = spark.createDataFrame([("even", None, 1.0), (None, datetime(2024, 1, 1), 1.0), ("even", datetime(2024, 1, 1), float("nan")), ("void", datetime(2024, 1, 1), None)], "tag string, ts timestamp_ntz, value double")
    path = str(tmp_path / "sketches")
    sketches.day_sketches(long.unionByName(odd), COLS).write.partitionBy("fecha").parquet(path)
    own = spark.read.parquet(path)
    assert own.agg(F.sum("n_values")).first()[0] == 300_000
    plan = sketches.merged_limits(own, COLS)._jdf.queryExecution().executedPlan().toString()
    assert "sketch" in plan and "Range" not in plan
    for start, end in ((None, None), (date(2024, 3, 1), date(2024, 6, 30))):
        held = long.where(F.lit(True) if start is None else F.to_date("ts").between(start, end))
        limits = {r.tag: (r.lim_inf, r.lim_sup) for r in sketches.merged_limits(own, COLS, start, end).collect()}
        assert set(limits) == {"even", "skewed"}
        for tag, (low, high) in limits.items():
            values = np.array([r[0] for r in held.where(F.col("tag") == tag).select("value").collect()])
            assert abs((values <= low).mean() - 0.05) < sketches.RANK_ERROR and abs((values <= high).mean() - 0.95) < sketches.RANK_ERROR


def test_few_values_are_exact(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(hours=7 * i), float(i)) for i in range(100)] + [("flat", start, 2.0), ("flat", start, 2.0)], "tag string, ts timestamp_ntz, value double")
    r = {x.tag: x for x in sketches.merged_bounds(sketches.day_sketches(df, COLS), COLS).collect()}
    assert (r["a"].q1, r["a"].q3, r["a"].low, r["a"].high) == (24.0, 74.0, -51.0, 149.0)
    assert (r["flat"].q1, r["flat"].low) == (2.0, None)


def test_exact_limits_beyond_a_sketch(spark):
    """Groups of more values than a sketch holds, one of repeated values, and one whose ranks are whole: limits as sorting gives them."""
    start, rng = datetime(2024, 1, 1), np.random.default_rng(5)
    values = {"normal": rng.normal(size=20_000), "ties": rng.integers(0, 3, 9_000).astype(float), "whole": np.arange(60, dtype=float)}
    rows = [(tag, start + timedelta(hours=7 * (i % 200)), float(v)) for tag, vs in values.items() for i, v in enumerate(vs)]
    rows += [("normal", None, 9.0), (None, start, 1.0), ("ties", start, float("nan")), ("void", start, None)]
    long = spark.createDataFrame(rows, "tag string, ts timestamp_ntz, value double")
    own = sketches.day_sketches(long, COLS)
    for first, last in ((None, None), (date(2024, 1, 5), date(2024, 2, 10))):
        got = {r.tag: r for r in sketches.exact_limits(own, long, COLS, first, last).collect()}
        held = {tag: np.sort([v for t, ts, v in rows if t == tag and ts and v == v and (first is None or first <= ts.date() <= last)]) for tag in values}
        assert set(got) == set(values)
        for tag, vs in held.items():
            at = lambda per_cent: vs[max(0, -(-per_cent * len(vs) // 100) - 1)]
            r = got[tag]
            assert (r.lim_inf, r.lim_sup, r.q1, r.q3) == (at(5), at(95), at(25), at(75))
            assert r.low == (at(25) - 1.5 * (at(75) - at(25)) if at(75) != at(25) else None)


def model_that_logs(log: str, most: int | None = None):
    def factory():
        def run(prompts, **options):
            for p in prompts:
                if most and Path(log).exists() and len(Path(log).read_text().splitlines()) >= most:
                    raise ValueError("no answer")
                with Path(log).open("a") as f:
                    f.write(p + "\n")
            return [f"{p} is {len(p)}, {options['temperature']}" for p in prompts]

        return run

    return factory


def sent(log):
    return Path(log).read_text().splitlines() if Path(log).exists() else []


def test_no_prompt_is_sent_twice(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    df = spark.createDataFrame([(i, f"prompt {i % 40}" if i % 10 else None, "x", "old") for i in range(100)], "id long, prompt string, key_ string, reporte_llm string")
    first = textgen.resumable(df, model_that_logs(log), store, piece=7)
    assert sorted(first.columns) == sorted(df.columns)
    want = {i: f"is {len(f'prompt {i % 40}')}, 0.4" if i % 10 else None for i in range(100)}
    assert {r.id: r.reporte_llm for r in first.collect()} == want and first.count() == 100
    assert len(sent(log)) == len(set(sent(log))) == 36
    again = textgen.resumable(df, model_that_logs(log), store, piece=7)
    assert {r.id: r.reporte_llm for r in again.collect()} == want and len(sent(log)) == 36
    more = spark.createDataFrame([(1, "prompt 1"), (2, "new one")], "id long, prompt string")
    assert {r.reporte_llm for r in textgen.resumable(more, model_that_logs(log), store).collect()} == {"is 8, 0.4", "is 7, 0.4"}
    assert sent(log)[36:] == ["new one"]
    warmer = textgen.resumable(more, model_that_logs(log), store, temperature=0.9)
    assert {r.reporte_llm for r in warmer.collect()} == {"is 8, 0.9", "is 7, 0.9"} and len(sent(log)) == 39
    textgen.resumable(more, model_that_logs(log), store, formatter=lambda p: f"<{p}>").collect()
    assert len(sent(log)) == 41


def test_a_stopped_run_goes_on(spark, tmp_path):
    log, store = str(tmp_path / "log"), str(tmp_path / "store")
    df = spark.createDataFrame([(f"p{i}",) for i in range(60)], "prompt string").coalesce(2)
    with pytest.raises(Exception, match="no answer"):
        textgen.resumable(df, model_that_logs(log, 30), store, piece=6)
    before, texts = len(sent(log)), spark.read.parquet(store).count()
    out = textgen.resumable(df, model_that_logs(log), store, piece=6)
    assert out.where("reporte_llm IS NULL").count() == 0 and out.count() == 60
    assert len(sent(log)) - before == 60 - texts and texts > 10


def test_nothing_to_send(spark, tmp_path):
    df = spark.createDataFrame([(None,)], "prompt string")
    assert [r.reporte_llm for r in textgen.resumable(df, model_that_logs(str(tmp_path / "log")), str(tmp_path / "none")).collect()] == [None]
