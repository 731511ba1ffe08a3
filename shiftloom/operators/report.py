"""Filters and aggregates of shift reports over a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import DATE_COL, SHIFT_COL, Columns
from . import quality
from .shifts import keyed

KEYS = (DATE_COL, SHIFT_COL)
LEVELS = {"Baja": 1, "Media": 2, "Alta": 3, "Crítica": 4}


def filter_shift(df: DataFrame, date: str | None = None, shift: str | None = None, tags: list[str] | None = None, tag: str = "Tag de PI") -> DataFrame:
    """Rows of a date, shift and tags; an argument that is None or whose column is missing is skipped."""
    if date is not None and DATE_COL in df.columns:
        df = df.where(F.col(DATE_COL) == F.lit(date))
    if shift is not None and SHIFT_COL in df.columns:
        df = df.where(F.col(SHIFT_COL) == F.lit(shift))
    if tags is not None and tag in df.columns:
        df = df.where(F.col(f"`{tag}`").isin(*tags)) if tags else df.limit(0)
    return df


def label_preview(df: DataFrame, cols: Columns = Columns(), n: int = 5) -> DataFrame:
    """The first ``n`` rows by tag, date and shift with their main figures and labels."""
    shown = [
        DATE_COL, SHIFT_COL, "pct_en_rango", "pct_bajo", "pct_alto", "estado_global_rango", "desviacion_predominante", "prioridad_atencion",
        "cv_turno", "tendencia_turno_cat", "osc_turno_cat", "estabilidad_turno_cat",
    ]
    return df.select(f"`{cols.tag}`", *shown).orderBy(cols.tag, DATE_COL, SHIFT_COL).limit(n)


def headline(features: DataFrame) -> DataFrame:
    """Per shift: per cent in range over all samples, and variables in all, well, deviating, critical."""
    state = F.col("estado_global_rango")
    inside = F.sum(F.col("pct_en_rango") * F.col("n_muestras")) / F.sum("n_muestras")
    return features.groupBy(*KEYS).agg(
        inside.alias("pct_en_rango_global"), F.count("*").alias("n_variables"), F.count_if(state == "OK").alias("n_ok"),
        F.count_if(~state.isin("OK", "desconocido")).alias("n_con_desvio"), F.count_if(state == "Crítica").alias("n_criticas"),
    )


def period_covered(long: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Per shift the first and last time."""
    return keyed(long, cols).groupBy(*KEYS).agg(F.min(cols.ts).alias("desde"), F.max(cols.ts).alias("hasta"))


def well_behaved(features: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Per shift the sorted names of the variables in range."""
    good = features.where(F.col("estado_global_rango") == "OK")
    return good.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list(f"`{cols.tag}`")), ", ").alias("variables"))


def level():
    return F.coalesce(*[F.when(F.col("prioridad_atencion") == k, v) for k, v in LEVELS.items()], F.lit(0))


def deviating(features: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Variables that deviate, ranked in their shift: most urgent, then least in range."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc(level()), F.col("pct_en_rango"), F.col(f"`{cols.tag}`"))
    rows = features.where(~F.col("estado_global_rango").isin("OK", "desconocido"))
    return rows.select(f"`{cols.tag}`", *KEYS, F.row_number().over(order).alias("orden"), "estado_global_rango", "desviacion_predominante", "prioridad_atencion", "pct_en_rango")


def watch_list(features: DataFrame, cols: Columns = Columns(), k: int = 3) -> DataFrame:
    """The ``k`` variables of each shift to watch: most urgent, then largest gap."""
    order = Window.partitionBy(*KEYS).orderBy(F.desc(level()), F.abs("gap_pct").desc_nulls_last(), F.col(f"`{cols.tag}`"))
    ranked = features.withColumn("orden", F.row_number().over(order)).where(F.col("orden") <= k)
    return ranked.select(f"`{cols.tag}`", *KEYS, "orden", "prioridad_atencion", "gap_pct")


def inventory(long: DataFrame, cols: Columns = Columns(), threshold: float = 1e-3) -> DataFrame:
    """Per tag: rows, first and last time, per cent of nulls, near-constant or not. One aggregation."""
    rows = long.where(F.col(f"`{cols.tag}`").isNotNull())
    out = rows.groupBy(cols.tag).agg(
        F.count("*").alias("n_filas"), F.min(cols.ts).alias("desde"), F.max(cols.ts).alias("hasta"),
        F.avg(F.col(cols.value).isNull().cast("double") * 100).alias("pct_nulls"), F.stddev_samp(cols.value).alias("std"),
    )
    return out.withColumn("congelada", F.coalesce(F.col("std") < F.lit(threshold), F.lit(False))).drop("std")


__all__ = ["deviating", "filter_shift", "headline", "inventory", "label_preview", "period_covered", "quality", "watch_list", "well_behaved"]
