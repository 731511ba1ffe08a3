import pytest
from pyspark.sql import functions as F

from shiftloom.operators import quality as q


def values(df, col="value_interp"):
    return [r[col] for r in df.orderBy("Tag de PI", "timestamp").collect()]


def test_null_counts(long):
    r = q.null_summary(long(a=[(0, 1), (1, None), (2, None), (3, 4)])).first()
    assert (r.n_rows, r.n_nulls, r.pct_nulls) == (4, 2, 50.0)
    assert q.null_summary(long(a=[(0, 1)]).limit(0)).first().pct_nulls is None


def test_null_share_orders_and_drops_null_keys(spark, long):
    df = long(a=[(0, None), (1, 1)], b=[(0, None)]).unionByName(spark.sql("SELECT CAST(NULL AS STRING) `Tag de PI`, TIMESTAMP_NTZ'2024-10-01' timestamp, CAST(NULL AS DOUBLE) value"))
    assert [tuple(r) for r in q.null_share(df, "Tag de PI").collect()] == [("b", 100.0), ("a", 50.0)]


def test_frozen_is_strict(spark):
    df = spark.createDataFrame([("a", 1e-3), ("b", 9e-4), ("c", None)], "`Tag de PI` string, std double")
    assert [r[0] for r in q.frozen_tags(df).collect()] == ["b"]
    assert [r[0] for r in q.extreme_tags(df, n=2).collect()] == ["b", "a"]
    assert [r[0] for r in q.extreme_tags(df, n=1, highest=True).collect()] == ["a"]


def test_iqr(long):
    df = long(a=[(i, v) for i, v in enumerate([1, 2, 3, 4, 100])], b=[(i, v) for i, v in enumerate([5, 5, 5, 5, 9])], c=[(0, None)])
    bounds = {r[0]: r for r in q.iqr_bounds(df).collect()}
    assert tuple(bounds["a"])[1:] == (2.0, 4.0, -1.0, 7.0) and bounds["b"].low is None
    flagged = q.flag_outliers(df, q.iqr_bounds(df))
    assert [r.value for r in flagged.where("is_outlier_iqr").collect()] == [100.0]
    assert flagged.where("is_outlier_iqr IS NULL").count() == 0
    s = q.outlier_summary(flagged).first()
    assert (s.n_rows, s.n_outliers) == (11, 1) and s.pct_outliers == pytest.approx(100 / 11)
    assert q.outlier_sample(flagged).count() == 1


@pytest.mark.parametrize(
    "given, filled",
    [
        ([(0, None), (1, 1), (2, None), (3, None), (4, 4), (5, None)], [1, 1, 2, 3, 4, 4]),
        ([(0, 0), (1, None), (100, 10)], [0, 5, 10]),
        ([(0, None), (1, None)], [None, None]),
        ([(0, 3)], [3]),
        # over three days, with a day without any value
        ([(0, 0), (1430, None), (1500, None), (2900, None), (4000, 4)], [0, 1, 2, 3, 4]),
    ],
)
def test_interpolation_by_position(long, given, filled):
    assert values(q.interpolate_gaps(long(a=given))) == pytest.approx(filled) if None not in filled else values(q.interpolate_gaps(long(a=given))) == filled


def test_interpolation_keeps_observed_values_and_counts_rest(long):
    df = long(a=[(i, None if i % 3 else i) for i in range(40)], b=[(0, None)])
    out = q.interpolate_gaps(df)
    assert out.where("value IS NOT NULL AND value <> value_interp").count() == 0
    assert q.remaining_nulls(out).first().n_nulls == 1
    assert out.count() == 41


def test_interpolation_against_pandas(spark, long):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(m), None if rng.random() < 0.4 else float(rng.normal())) for m in np.cumsum(rng.integers(1, 200, 300))]
    df = long(a=rows)
    pdf = df.toPandas().sort_values("timestamp")
    expected = pdf["value"].interpolate(limit_direction="both")
    got = q.interpolate_gaps(df).orderBy("timestamp").toPandas()["value_interp"]
    assert np.allclose(expected.to_numpy(), got.to_numpy())


def test_clean_long_flags_raw_and_fills(long):
    df = long(a=[(0, 1), (1, 2), (2, None), (3, 4), (4, 100)])
    out = q.clean_long(df)
    assert values(out, "value") == pytest.approx([1, 2, 3, 4, 100])
    assert "value_interp" not in q.clean_long(df, interpolate=False).columns
    nan = df.withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    assert values(q.interpolate_gaps(nan)) == pytest.approx([1, 2, 3, 4, 100])
