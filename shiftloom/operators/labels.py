"""Categories of range state, deviation, priority, trend, oscillation and stability.

Labels and thresholds are fixed values that readers of the tables rely on; thresholds are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_state(pct: Column, ok: float = 95.0, mild: float = 80.0, moderate: float = 50.0) -> Column:
    return (
        F.when(pct.isNull(), "desconocido").when(pct >= F.lit(ok), "OK").when(pct >= F.lit(mild), "Leve desviación")
        .when(pct >= F.lit(moderate), "Desviación moderada").otherwise("Crítica")
    )


def main_deviation(low: Column, high: Column, dominance: float = 0.7) -> Column:
    """Which side out-of-range time is on: one side needs the share ``dominance``."""
    total = low + high
    share_low, share_high = low / F.nullif(total, F.lit(0.0)), high / F.nullif(total, F.lit(0.0))
    most, rest = F.lit(dominance), F.lit(1 - dominance)
    return (
        F.when(low.isNull() | high.isNull(), "desconocida").when(total < F.lit(1e-6), "sin_desviacion")
        .when((share_low >= most) & (share_high < rest), "por_debajo").when((share_high >= most) & (share_low < rest), "por_encima").otherwise("mixta")
    )


def attention_priority(state: Column, gap_pct: Column, medium: float = 5.0, high: float = 10.0) -> Column:
    """Base level by state; a large gap raises it by one, a medium gap only the two lowest levels."""
    gap = F.abs(gap_pct)
    far, some = F.coalesce(gap >= F.lit(high), F.lit(False)), F.coalesce(gap >= F.lit(medium), F.lit(False))
    level = F.when(state == "OK", 1).when(state == "Leve desviación", 2).when(state == "Desviación moderada", 3).when(state == "Crítica", 4)
    raised = F.when(far & level.isNotNull(), F.least(level + 1, F.lit(4))).when(some & (level <= 2), level + 1).otherwise(level)
    names = F.array(*[F.lit(x) for x in ("Baja", "Media", "Alta", "Crítica")])
    return F.coalesce(F.get(names, raised - 1), F.lit("Desconocida"))


def label_ranges(
    df: DataFrame, pct_in: str = "pct_en_rango", pct_low: str = "pct_bajo", pct_high: str = "pct_alto", gap_pct: str = "gap_pct",
    ok: float = 95.0, mild: float = 80.0, moderate: float = 50.0, dominance: float = 0.7, gap_medium: float = 5.0, gap_high: float = 10.0,
) -> DataFrame:
    """Adds the three range labels."""
    out = df.withColumn("estado_global_rango", range_state(F.col(pct_in), ok, mild, moderate))
    out = out.withColumn("desviacion_predominante", main_deviation(F.col(pct_low), F.col(pct_high), dominance))
    return out.withColumn("prioridad_atencion", attention_priority(F.col("estado_global_rango"), F.col(gap_pct), gap_medium, gap_high))


def trend(slope: Column, std: Column, cv: Column, osc: Column, low: float = 0.05, high: float = 0.20, flat_cv: float = 0.01, oscillates: float = 0.7) -> Column:
    """Slope in deviations per minute (the slope itself where the deviation can't be used)."""
    s = F.when(std > 0, slope / F.when(std > 0, std)).otherwise(slope)
    calm = cv.isNotNull() & (cv < F.lit(flat_cv))
    return (
        F.when(slope.isNull(), "desconocida").when(osc >= F.lit(oscillates), "oscilando")
        .when(calm & (F.abs(s) < F.lit(low)), "plana").when(calm, "ligera_tendencia")
        .when(s >= F.lit(high), "subiendo_fuerte").when(s >= F.lit(low), "subiendo")
        .when(s <= F.lit(-high), "bajando_fuerte").when(s <= F.lit(-low), "bajando").otherwise("estable")
    )


def oscillation(osc: Column, low: float = 0.1, medium: float = 0.4, high: float = 0.7) -> Column:
    return (
        F.when(osc.isNull(), "osc_desconocida").when(osc < F.lit(low), "sin_oscilacion").when(osc < F.lit(medium), "oscilacion_baja")
        .when(osc < F.lit(high), "oscilacion_media").otherwise("oscilacion_alta")
    )


def stability(cv: Column, osc_label: Column, low: float = 0.02, medium: float = 0.10) -> Column:
    moving = osc_label.isin("oscilacion_media", "oscilacion_alta")
    calm = F.when(cv < F.lit(low), "muy_estable").when(cv < F.lit(medium), "estable").otherwise("variable")
    rough = F.when(cv < F.lit(low), "estable_oscilante").when(cv < F.lit(medium), "variable_oscilante").otherwise("inestable")
    return F.when(cv.isNull(), "estabilidad_desconocida").when(moving, rough).otherwise(calm)


def label_dynamics(
    df: DataFrame, cv: str = "cv_turno", slope: str = "slope_turno", std: str = "std_turno", osc: str = "osc_sign_changes_norm_turno",
    slope_low: float = 0.05, slope_high: float = 0.20, flat_cv: float = 0.01, oscillates: float = 0.7,
    osc_low: float = 0.1, osc_medium: float = 0.4, osc_high: float = 0.7, cv_low: float = 0.02, cv_medium: float = 0.10, abs_cv: bool = False,
) -> DataFrame:
    """Adds the oscillation, trend and stability labels; the deviation column may be missing.

    The coefficient of variation keeps its sign unless ``abs_cv``.
    """
    spread = F.col(std) if std in df.columns else F.lit(None).cast("double")
    ratio = F.abs(cv) if abs_cv else F.col(cv)
    out = df.withColumn("osc_turno_cat", oscillation(F.col(osc), osc_low, osc_medium, osc_high))
    out = out.withColumn("tendencia_turno_cat", trend(F.col(slope), spread, ratio, F.col(osc), slope_low, slope_high, flat_cv, oscillates))
    return out.withColumn("estabilidad_turno_cat", stability(ratio, F.col("osc_turno_cat"), cv_low, cv_medium))
