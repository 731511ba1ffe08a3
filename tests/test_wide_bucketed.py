"""Text read cell by cell, and tables that joins and windows read without an exchange."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shiftloom.operators import dynamics, ranges, shifts
from shiftloom.schema import Columns
from shiftloom.sources import bucketed, cells, tables


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted(tuple(r) for r in df.select("`Tag de PI`", F.col("timestamp").cast("string"), F.coalesce("value", F.lit(-1e9))).collect())


def test_a_line_is_many_tasks(spark, tmp_path, small_splits):
    n = 40_000
    times = [(datetime(2024, 1, 1) + timedelta(minutes=i)).isoformat(sep=" ") for i in range(n)]
    lines = [",".join(["Tag de PI", *times]), *[",".join([f"tag{k}", *[str(k + i / 8) if i % 7 else "" for i in range(n)]]) for k in range(3)]]
    (tmp_path / "wide.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "wide.csv")
    got = cells.read_very_wide_text(spark, path)
    tasks = cells.read_cells(spark, path).where("line = 1").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 2 and spark.read.option("lineSep", ",").text(path).rdd.getNumPartitions() > 20
    want = tables.read_wide_text(spark, path)
    assert got.count() == 3 * n
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_cells_of_odd_lines(spark, tmp_path, small_splits):
    text = '2024-01-01,"Tag de PI",2024-01-02 00:10:00\r\n1.5,a,\r\n\r\nNaN,"b",3\n2,c\n,,\n9,d,4'
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "one.csv").write_text(text)
    (tmp_path / "odd" / "two.csv").write_text("Tag de PI,2024-01-05\nz,7\n")
    got = rows(cells.read_very_wide_text(spark, str(tmp_path / "odd")))
    one, two = "2024-01-01 00:00:00", "2024-01-02 00:10:00"
    assert got == sorted([("a", one, 1.5), ("a", two, -1e9), ("b", one, -1e9), ("b", two, 3.0), ("c", one, 2.0), ("d", one, 9.0), ("d", two, 4.0), ("z", "2024-01-05 00:00:00", 7.0)])


def test_headers_of_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Tag de PI,2024-01-01,zz\nx,1,2\n")
    with pytest.raises(ValueError, match="zz"):
        cells.read_very_wide_text(spark, str(tmp_path / "a.csv"))
    assert rows(cells.read_very_wide_text(spark, str(tmp_path / "a.csv"), strict=False)) == [("x", "2024-01-01 00:00:00", 1.0)]
    (tmp_path / "b.csv").write_text("other,2024-01-01\nx,1\n")
    with pytest.raises(ValueError, match="Tag de PI"):
        cells.read_very_wide_text(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("Tag de PI,2024-01-01\n")
    assert cells.read_very_wide_text(spark, str(tmp_path / "c.csv")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_without_exchange(spark, long):
    """The join on the key and the shift windows read their buckets as they are."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = long(a=[(m, (m * 7) % 5) for m in range(0, 4000, 13)], b=[(m, m % 3) for m in range(0, 3000, 17)], c=[(5, None), (6, 1)])
        limits = ranges.tag_limits(df)
        names = [bucketed.new_table(spark, k) for k in ("stats", "shares", "samples")]
        stats = bucketed.write_bucketed(shifts.shift_stats(df), names[0], 4)
        shares = bucketed.write_bucketed(ranges.range_shares(df, limits, interval_min=10.0), names[1], 4)
        joined = ranges.attach(stats, shares)
        assert "Exchange" not in plan_of(joined) and "Join" in plan_of(joined)
        want = ranges.attach(shifts.shift_stats(df), ranges.range_shares(df, limits, interval_min=10.0))
        order = ("Tag de PI", "fecha", "turno")
        assert joined.orderBy(*order).collect() == want.select(joined.columns).orderBy(*order).collect()
        samples = bucketed.write_samples(df, names[2], 4)
        moving = dynamics.shift_dynamics(samples)
        assert "Exchange" not in plan_of(moving) and "Window" in plan_of(moving)
        assert moving.orderBy(*order).collect() == dynamics.shift_dynamics(df).select(moving.columns).orderBy(*order).collect()
        assert "Exchange" not in plan_of(shifts.shift_stats(samples))
        assert Columns() == Columns("Tag de PI")
        for n in names:
            spark.sql(f"DROP TABLE {n}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
