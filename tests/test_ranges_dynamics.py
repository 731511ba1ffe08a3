import pytest
from pyspark.sql import functions as F

from shiftloom.operators import dynamics as d
from shiftloom.operators import ranges as g
from shiftloom.operators import shifts as s
from shiftloom.plans.features import shift_features, shift_features_composed


def test_limits(long):
    r = g.tag_limits(long(a=[(i, i) for i in range(101)])).first()
    assert (r.lim_inf, r.lim_sup) == (5, 95)


def test_sampling_interval(long):
    assert g.sampling_interval(long(a=[(0, 1), (10, 1), (20, 1), (50, 1)], b=[(0, 1), (1, 1)])).first()[0] == 10
    assert g.sampling_interval(long(a=[(0, 1)])).first()[0] == 10
    assert g.sampling_interval(long(a=[(1430, 1), (1450, 1), (1480, 1)])).first()[0] == 25  # over midnight
    assert g.sampling_interval(long(a=[(0, 1)]).limit(0)).first()[0] == 10


def test_shares(spark, long):
    df = long(a=list(enumerate([10, 20, 9.99, 20.01, None])))
    limits = spark.createDataFrame([("a", 10.0, 20.0)], "`Tag de PI` string, lim_inf double, lim_sup double")
    r = g.range_shares(df, limits, interval_min=10).first()
    assert r.n_muestras == 5
    assert (r.pct_en_rango, r.pct_bajo, r.pct_alto) == pytest.approx((60, 20, 20))
    assert (r.tiempo_en_rango_min, r.tiempo_bajo_min, r.tiempo_alto_min) == (30, 10, 10)
    no_limits = g.range_shares(df, limits.limit(0), interval_min=10).first()
    assert no_limits.pct_en_rango == 100


def test_attach_suffix(long):
    stats = s.shift_stats(long(a=[(0, 1)])).withColumn("x", F.lit(1))
    more = stats.select("Tag de PI", "fecha", "turno", F.lit(2).alias("x"))
    r = g.attach(stats, more, suffix="_din").first()
    assert (r.x, r.x_din) == (1, 2)


def test_dynamics(long):
    r = d.shift_dynamics(long(a=[(0, 1), (10, 3), (20, 2), (30, 2), (40, 5)])).first()
    assert (r.n_muestras_turno, r.duracion_turno_min, r.osc_sign_changes_turno, r.osc_sign_changes_norm_turno) == (5, 40, 2, 1.0)
    assert (r.cv_turno, r.slope_turno, r.rate_mean_turno) == pytest.approx((0.583298, 0.07, 0.1), abs=1e-6)


@pytest.mark.parametrize(
    "given, expected",
    [
        ([(0, 7)], (1, 0.0, None, None, None, 0, 0.0)),
        ([(0, 1), (0, 2)], (2, 0.0, pytest.approx(0.471405, abs=1e-6), None, None, 0, 0.0)),
        ([(0, 4), (1, 4), (2, 4)], (3, 2.0, 0.0, 0.0, 0.0, 0, 0.0)),
        ([(0, -1), (1, 1)], (2, 1.0, None, 2.0, 2.0, 0, 0.0)),
        ([(0, None), (1, None)], (2, 1.0, None, None, None, None, None)),
        ([(0, 1), (1, None), (2, 3), (3, 2)], (4, 3.0, None, None, pytest.approx(1 / 3), 1, 1.0)),
    ],
)
def test_dynamics_edges(long, given, expected):
    r = d.shift_dynamics(long(a=given)).first()
    assert (r.n_muestras_turno, r.duracion_turno_min, r.cv_turno, r.slope_turno, r.rate_mean_turno, r.osc_sign_changes_turno, r.osc_sign_changes_norm_turno) == expected


def test_fused_equals_composed(long):
    df = long(a=[(7 * i, (i * 37) % 11) for i in range(400)], b=[(9 * i, None if i % 5 == 0 else (i * 13) % 7) for i in range(300)])
    from shiftloom.operators.quality import clean_long

    one = shift_features(df)
    two = shift_features_composed(clean_long(df)).select(*one.columns)
    a, b = (x.orderBy("Tag de PI", "fecha", "turno").toPandas() for x in (one, two))
    for c in one.columns:
        if one.schema[c].dataType.simpleString() == "double":
            assert a[c].fillna(-1e9).to_numpy() == pytest.approx(b[c].fillna(-1e9).to_numpy())
        else:
            assert a[c].tolist() == b[c].tolist(), c
    assert (a.pct_en_rango + a.pct_bajo + a.pct_alto).to_numpy() == pytest.approx(100)


def test_fused_plan_has_one_exchange_on_the_key(spark):
    from shiftloom.plans import registry

    df = registry.events(spark, "/root/testdata/sf0.001")
    plan = shift_features(df, registry.COLS, raw=False, interval_min=1.0)._jdf.queryExecution().executedPlan().toString()
    key = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "turno" in line]
    assert len(key) == 1
    assert "Python" not in plan
