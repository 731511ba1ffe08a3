from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shiftloom.operators import shifts as s


def test_shift_edges_and_date(spark):
    times = ["00:00:00", "07:59:59.999999", "08:00:00", "15:59:59.999999", "16:00:00", "23:59:59.999999"]
    df = spark.createDataFrame([(datetime.fromisoformat(f"2024-10-01 {t}"),) for t in times], "timestamp timestamp_ntz")
    rows = s.add_shift(df).orderBy("timestamp").collect()
    assert [r.turno[:2] for r in rows] == ["T1", "T1", "T2", "T2", "T3", "T3"]
    assert {str(r.fecha) for r in rows} == {"2024-10-01"}


def test_given_shift_is_kept(long):
    df = long(a=[(0, 1)]).withColumn("turno", F.lit("X"))
    r = s.ensure_shift(df).first()
    assert r.turno == "X" and str(r.fecha) == "2024-10-01"


def test_stats(long):
    r = s.shift_stats(long(a=list(enumerate([1, 3, 2, 2, 5])))).first()
    assert (r.mean_turno, r.std_turno, r.min_turno, r.max_turno, r.p10_turno, r.p50_turno, r.p90_turno) == pytest.approx((2.6, 1.516575, 1, 5, 1.4, 2.0, 4.2), abs=1e-6)
    one = s.shift_stats(long(a=[(0, 7)])).first()
    assert one.std_turno is None and (one.p10_turno, one.p90_turno) == (7, 7)


def test_null_keys_leave(spark, long):
    df = long(a=[(0, 1)]).unionByName(spark.sql("SELECT CAST(NULL AS STRING) `Tag de PI`, TIMESTAMP_NTZ'2024-10-01' timestamp, 1D value UNION ALL SELECT 'b', CAST(NULL AS TIMESTAMP_NTZ), 1D"))
    assert [r[0] for r in s.shift_stats(df).collect()] == ["a"]


def test_missing_column():
    with pytest.raises(ValueError, match="value"):
        from pyspark.sql import SparkSession

        s.shift_stats(SparkSession.getActiveSession().sql("SELECT 'a' `Tag de PI`, TIMESTAMP_NTZ'2024-10-01' timestamp"))


@pytest.mark.parametrize("mean, base, gap", [(11.0, 10.0, 10.0), (1.0, 0.0, float("inf")), (-1.0, 0.0, float("-inf")), (0.0, 0.0, None)])
def test_gap(spark, mean, base, gap):
    stats = spark.createDataFrame([("a", mean)], "`Tag de PI` string, mean_turno double")
    own = spark.createDataFrame([("a", base)], "`Tag de PI` string, mean_mes double")
    r = s.add_gaps(stats, own).first()
    assert r.gap_pct == gap and r.gap_mean == mean - base


def test_baseline_periods(spark, long):
    df = long(a=[(0, 1), (60 * 24 * 31, 3)])  # 1 October and 1 November
    assert s.baseline(df).first().mean_mes == 2
    own = {str(r.fecha): r.mean_mes for r in s.shift_gaps(df, period="calendar_month").collect()}
    assert own == {"2024-10-01": 1, "2024-11-01": 3}
    before = {str(r.fecha): r.mean_mes for r in s.shift_gaps(df, period="previous_month").collect()}
    assert before == {"2024-10-01": None, "2024-11-01": 1}
