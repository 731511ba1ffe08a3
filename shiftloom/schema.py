"""Column and label contracts, thresholds and schema checks of the shift analytics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Names of the three columns of a long table, and of an optional column that orders equal times."""

    tag: str = "Tag de PI"
    ts: str = "timestamp"
    value: str = "value"
    tiebreak: str | None = None


# Names of shifts, columns and labels that users of the tables rely on.
SHIFTS = (("T1_00_08", 8), ("T2_08_16", 16), ("T3_16_00", 24))
SHIFT_COL, DATE_COL = "turno", "fecha"
STAT_COLS = ("mean_turno", "std_turno", "min_turno", "max_turno", "p10_turno", "p50_turno", "p90_turno")
RANGE_COLS = ("n_muestras", "pct_en_rango", "pct_bajo", "pct_alto", "tiempo_en_rango_min", "tiempo_bajo_min", "tiempo_alto_min")
DYNAMIC_COLS = ("n_muestras_turno", "duracion_turno_min", "cv_turno", "slope_turno", "rate_mean_turno", "osc_sign_changes_turno", "osc_sign_changes_norm_turno")
LABEL_COLS = ("estado_global_rango", "desviacion_predominante", "prioridad_atencion", "tendencia_turno_cat", "osc_turno_cat", "estabilidad_turno_cat")
RANGE_STATES = ("OK", "Leve desviación", "Desviación moderada", "Crítica", "desconocido")
PRIORITIES = ("Baja", "Media", "Alta", "Crítica", "Desconocida")


def feature_schema(tag: str = "Tag de PI") -> T.StructType:
    """Schema of a stored feature table; the date is text, as readers of delimited files expect."""
    counts = {"n_muestras", "n_muestras_turno", "osc_sign_changes_turno"}
    kinds = lambda c: T.LongType() if c in counts else T.DoubleType()
    numbers = [*STAT_COLS, "mean_mes", "gap_mean", "gap_pct", *RANGE_COLS, *DYNAMIC_COLS]
    fields = [T.StructField(c, T.StringType()) for c in (tag, DATE_COL, SHIFT_COL)]
    return T.StructType(fields + [T.StructField(c, kinds(c)) for c in numbers] + [T.StructField(c, T.StringType()) for c in LABEL_COLS])


def require(df: DataFrame, *names: str) -> None:
    """Fail before any plan is built if columns are missing."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; the table has {', '.join(df.columns)}")
