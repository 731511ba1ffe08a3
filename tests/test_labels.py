import pytest
from pyspark.sql import functions as F

from shiftloom.operators import labels as c


def apply(spark, names, rows, column):
    schema = ", ".join(f"{n} {'string' if n.startswith('s_') else 'double'}" for n in names.split())
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_range_state(spark):
    rows = [(95.0,), (94.999,), (80.0,), (79.999,), (50.0,), (49.999,), (None,)]
    assert apply(spark, "p", rows, c.range_state(F.col("p"))) == ["OK", "Leve desviación", "Leve desviación", "Desviación moderada", "Desviación moderada", "Crítica", "desconocido"]


def test_deviation(spark):
    rows = [(0.0, 0.0), (7.0, 3.0), (3.0, 7.0), (6.9, 3.1), (5.0, 5.0), (None, 1.0)]
    assert apply(spark, "a b", rows, c.main_deviation(F.col("a"), F.col("b"))) == ["sin_desviacion", "por_debajo", "por_encima", "mixta", "mixta", "desconocida"]


PRIORITY = {
    "OK": ("Baja", "Media", "Media"), "Leve desviación": ("Media", "Alta", "Alta"), "Desviación moderada": ("Alta", "Alta", "Crítica"),
    "Crítica": ("Crítica",) * 3, "desconocido": ("Desconocida",) * 3,
}


def test_priority(spark):
    gaps = [(4.99, 0), (-4.99, 0), (None, 0), (5.0, 1), (-9.99, 1), (10.0, 2), (float("inf"), 2), (float("-inf"), 2)]
    rows = [(s, g) for s in PRIORITY for g, _ in gaps]
    assert apply(spark, "s_ g", rows, c.attention_priority(F.col("s_"), F.col("g"))) == [PRIORITY[s][k] for s in PRIORITY for _, k in gaps]


def test_trend(spark):
    rows = {
        (None, 1.0, 0.5, 0.0): "desconocida", (1.0, 1.0, 0.5, 0.7): "oscilando", (0.01, 1.0, 0.009, 0.0): "plana", (0.05, 1.0, 0.009, 0.0): "ligera_tendencia",
        (0.2, 1.0, 0.5, 0.0): "subiendo_fuerte", (0.05, 1.0, 0.5, 0.0): "subiendo", (-0.2, 1.0, 0.5, 0.0): "bajando_fuerte", (-0.05, 1.0, 0.5, 0.0): "bajando",
        (0.049, 1.0, 0.5, 0.0): "estable", (0.2, 0.0, None, 0.0): "subiendo_fuerte", (0.2, None, 0.5, None): "subiendo_fuerte",
    }
    assert apply(spark, "a b c d", list(rows), c.trend(*map(F.col, "abcd"))) == list(rows.values())


def test_oscillation(spark):
    rows = [(0.099,), (0.1,), (0.4,), (0.7,), (None,)]
    assert apply(spark, "o", rows, c.oscillation(F.col("o"))) == ["sin_oscilacion", "oscilacion_baja", "oscilacion_media", "oscilacion_alta", "osc_desconocida"]


@pytest.mark.parametrize("label, names", [("oscilacion_baja", ("muy_estable", "estable", "variable")), ("osc_desconocida", ("muy_estable", "estable", "variable")), ("oscilacion_media", ("estable_oscilante", "variable_oscilante", "inestable"))])
def test_stability(spark, label, names):
    rows = [(0.019, label), (-0.5, label), (0.02, label), (0.10, label), (None, label)]
    assert apply(spark, "v s_", rows, c.stability(F.col("v"), F.col("s_"))) == [names[0], names[0], names[1], names[2], "estabilidad_desconocida"]


def test_missing_deviation_column(spark):
    df = spark.sql("SELECT 0.5D cv_turno, 0.2D slope_turno, 0D osc_sign_changes_norm_turno")
    assert c.label_dynamics(df).first().tendencia_turno_cat == "subiendo_fuerte"
