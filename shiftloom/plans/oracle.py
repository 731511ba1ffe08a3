"""The registered queries as SQL, built from named pieces."""

from __future__ import annotations

import re

SHIFT = "CASE WHEN hour(ts) < 8 THEN 'T1_00_08' WHEN hour(ts) < 16 THEN 'T2_08_16' ELSE 'T3_16_00' END"
FECHA = "CAST(CAST(ts AS DATE) AS VARCHAR)"
STATS = ("mean_turno", "std_turno", "min_turno", "max_turno", "p10_turno", "p50_turno", "p90_turno")
GAPS = ("mean_mes", "gap_mean", "gap_pct")
RANGES = ("pct_en_rango", "pct_bajo", "pct_alto", "tiempo_en_rango_min", "tiempo_bajo_min", "tiempo_alto_min")
DYN = ("duracion_turno_min", "cv_turno", "slope_turno", "rate_mean_turno")
LABELS = ("estado_global_rango", "desviacion_predominante", "prioridad_atencion", "tendencia_turno_cat", "osc_turno_cat", "estabilidad_turno_cat")

RAW = "raw AS (SELECT event_type AS tag, ts, value, event_id FROM events)"
GAPPY = "raw AS (SELECT event_type AS tag, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, event_id FROM events)"
BY_USER = "raw AS (SELECT CAST(user_id AS VARCHAR) AS tag, ts, value, event_id FROM events)"
TIES = "raw AS (SELECT o_orderpriority AS tag, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS value, o_orderkey AS event_id FROM orders)"
PASS = "clean AS (SELECT * FROM raw)"
FILL = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY ts, event_id) AS n FROM raw),
near AS (
  SELECT *, max(CASE WHEN value IS NOT NULL THEN n END) OVER (PARTITION BY tag ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ln,
    min(CASE WHEN value IS NOT NULL THEN n END) OVER (PARTITION BY tag ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rn
  FROM numbered),
filled AS (
  SELECT a.tag, a.ts, a.event_id, a.value, CASE WHEN a.value IS NOT NULL THEN a.value WHEN a.ln IS NULL THEN r.value WHEN a.rn IS NULL THEN l.value
    ELSE l.value + (r.value - l.value) * (a.n - a.ln) / (a.rn - a.ln) END AS value_interp
  FROM near a LEFT JOIN numbered l ON a.tag = l.tag AND a.ln = l.n LEFT JOIN numbered r ON a.tag = r.tag AND a.rn = r.n),
clean AS (SELECT tag, ts, value_interp AS value, event_id FROM filled)"""
KEYED = f"keyed AS (SELECT *, {FECHA} AS fecha, {SHIFT} AS turno, epoch_us(ts) / 6e7 AS m FROM clean)"
STAT_SQL = """
stats AS (
  SELECT tag, fecha, turno, avg(value) AS mean_turno, stddev_samp(value) AS std_turno, min(value) AS min_turno, max(value) AS max_turno,
    quantile_cont(value, 0.1) AS p10_turno, quantile_cont(value, 0.5) AS p50_turno, quantile_cont(value, 0.9) AS p90_turno
  FROM keyed GROUP BY tag, fecha, turno)"""
GAP_CASE = "CASE WHEN mean_mes <> 0 THEN (mean_turno - mean_mes) / mean_mes * 100 WHEN mean_turno > mean_mes THEN CAST('Infinity' AS DOUBLE) WHEN mean_turno < mean_mes THEN CAST('-Infinity' AS DOUBLE) END"
GAP_SQL = f"""
base AS (SELECT tag AS t, avg(value) AS mean_mes FROM clean GROUP BY tag),
gaps AS (SELECT stats.*, mean_mes, mean_turno - mean_mes AS gap_mean, {GAP_CASE} AS gap_pct FROM stats LEFT JOIN base ON tag = t)"""
MONTH_SQL = f"""
base AS (SELECT tag AS t, substr({FECHA}, 1, 7) AS month, avg(value) AS mean_mes FROM clean GROUP BY 1, 2),
gaps AS (SELECT stats.*, mean_mes, mean_turno - mean_mes AS gap_mean, {GAP_CASE} AS gap_pct FROM stats LEFT JOIN base ON tag = t AND substr(fecha, 1, 7) = month)"""
LIMITS = "limits AS (SELECT tag AS t, quantile_cont(value, 0.05) AS lim_inf, quantile_cont(value, 0.95) AS lim_sup FROM clean GROUP BY tag)"
INTERVAL = """
steps AS (SELECT (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts))) / 6e7 AS m FROM clean WHERE tag = (SELECT min(tag) FROM clean)),
span AS (SELECT coalesce(quantile_cont(m, 0.5), 10.0) AS interval_min FROM steps)"""
SHARES = """
counted AS (
  SELECT tag, fecha, turno, count(*) AS n_muestras, count(*) FILTER (WHERE value < lim_inf) AS lo, count(*) FILTER (WHERE value > lim_sup) AS hi
  FROM keyed LEFT JOIN limits ON tag = t GROUP BY tag, fecha, turno),
shares AS (
  SELECT tag, fecha, turno, n_muestras, (n_muestras - lo - hi) / n_muestras * 100 AS pct_en_rango, lo / n_muestras * 100 AS pct_bajo, hi / n_muestras * 100 AS pct_alto,
    (n_muestras - lo - hi) * interval_min AS tiempo_en_rango_min, lo * interval_min AS tiempo_bajo_min, hi * interval_min AS tiempo_alto_min
  FROM counted CROSS JOIN span)"""
DYNAMICS = """
stepped AS (SELECT *, sign(value - lag(value) OVER (PARTITION BY tag, fecha, turno ORDER BY ts, event_id)) AS step FROM keyed),
signed AS (SELECT *, CASE WHEN step <> 0 THEN step END AS sg FROM stepped),
turned AS (SELECT *, last_value(sg IGNORE NULLS) OVER (PARTITION BY tag, fecha, turno ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    row_number() OVER (PARTITION BY tag, fecha, turno ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY tag, fecha, turno ORDER BY ts DESC, event_id DESC) AS z FROM signed),
grouped AS (
  SELECT tag, fecha, turno, count(*) AS n, max(m) - min(m) AS d, stddev_samp(value) AS sd, avg(value) AS mn, min(ts) AS t0, max(ts) AS t1,
    CASE WHEN min(ts) <> max(ts) THEN regr_slope(value, m - m0) END AS fit, max(CASE WHEN z = 1 THEN value END) - max(CASE WHEN a = 1 THEN value END) AS rise, count(sg) AS signs, count(*) FILTER (WHERE sg <> before) AS turns
  FROM (SELECT *, min(m) OVER (PARTITION BY tag, fecha, turno) AS m0 FROM turned) GROUP BY tag, fecha, turno),
dyn AS (
  SELECT tag, fecha, turno, n AS n_muestras_turno, (epoch_us(t1) - epoch_us(t0)) / 6e7 AS duracion_turno_min, CASE WHEN n > 1 AND mn <> 0 THEN sd / mn END AS cv_turno, CASE WHEN n > 1 THEN fit END AS slope_turno,
    CASE WHEN t1 <> t0 THEN rise / ((epoch_us(t1) - epoch_us(t0)) / 6e7) END AS rate_mean_turno, turns AS osc_sign_changes_turno,
    CASE WHEN signs < 2 THEN 0.0 ELSE turns / greatest(signs - 1, 1) END AS osc_sign_changes_norm_turno
  FROM grouped)"""
JOINED = """
joined AS (
  SELECT gaps.*, n_muestras, pct_en_rango, pct_bajo, pct_alto, tiempo_en_rango_min, tiempo_bajo_min, tiempo_alto_min, n_muestras_turno, duracion_turno_min, cv_turno, slope_turno, rate_mean_turno,
    osc_sign_changes_turno, osc_sign_changes_norm_turno
  FROM gaps JOIN shares USING (tag, fecha, turno) JOIN dyn USING (tag, fecha, turno))"""
LABELLED = """
first_labels AS (
  SELECT *, CASE WHEN pct_en_rango IS NULL THEN 'desconocido' WHEN pct_en_rango >= 95 THEN 'OK' WHEN pct_en_rango >= 80 THEN 'Leve desviación' WHEN pct_en_rango >= 50 THEN 'Desviación moderada' ELSE 'Crítica' END AS estado_global_rango,
    CASE WHEN pct_bajo IS NULL OR pct_alto IS NULL THEN 'desconocida' WHEN pct_bajo + pct_alto < 1e-6 THEN 'sin_desviacion'
      WHEN pct_bajo / (pct_bajo + pct_alto) >= 0.7::DOUBLE AND pct_alto / (pct_bajo + pct_alto) < 1 - 0.7::DOUBLE THEN 'por_debajo'
      WHEN pct_alto / (pct_bajo + pct_alto) >= 0.7::DOUBLE AND pct_bajo / (pct_bajo + pct_alto) < 1 - 0.7::DOUBLE THEN 'por_encima' ELSE 'mixta' END AS desviacion_predominante,
    CASE WHEN osc_sign_changes_norm_turno IS NULL THEN 'osc_desconocida' WHEN osc_sign_changes_norm_turno < 0.1::DOUBLE THEN 'sin_oscilacion' WHEN osc_sign_changes_norm_turno < 0.4::DOUBLE THEN 'oscilacion_baja'
      WHEN osc_sign_changes_norm_turno < 0.7::DOUBLE THEN 'oscilacion_media' ELSE 'oscilacion_alta' END AS osc_turno_cat,
    CASE WHEN std_turno > 0 THEN slope_turno / std_turno ELSE slope_turno END AS s
  FROM joined),
levels AS (
  SELECT *, CASE estado_global_rango WHEN 'OK' THEN 1 WHEN 'Leve desviación' THEN 2 WHEN 'Desviación moderada' THEN 3 WHEN 'Crítica' THEN 4 END AS lv,
    CASE WHEN abs(gap_pct) >= 10 THEN 2 WHEN abs(gap_pct) >= 5 THEN 1 ELSE 0 END AS far
  FROM first_labels),
features AS (
  SELECT *, CASE WHEN lv IS NULL THEN 'Desconocida' ELSE list_extract(['Baja', 'Media', 'Alta', 'Crítica'], CASE WHEN far = 2 THEN least(lv + 1, 4) WHEN far = 1 AND lv <= 2 THEN lv + 1 ELSE lv END) END AS prioridad_atencion,
    CASE WHEN slope_turno IS NULL THEN 'desconocida' WHEN osc_sign_changes_norm_turno >= 0.7::DOUBLE THEN 'oscilando' WHEN cv_turno < 0.01::DOUBLE THEN CASE WHEN abs(s) < 0.05::DOUBLE THEN 'plana' ELSE 'ligera_tendencia' END
      WHEN s >= 0.2::DOUBLE THEN 'subiendo_fuerte' WHEN s >= 0.05::DOUBLE THEN 'subiendo' WHEN s <= -0.2::DOUBLE THEN 'bajando_fuerte' WHEN s <= -0.05::DOUBLE THEN 'bajando' ELSE 'estable' END AS tendencia_turno_cat,
    CASE WHEN cv_turno IS NULL THEN 'estabilidad_desconocida' WHEN osc_turno_cat IN ('oscilacion_media', 'oscilacion_alta') THEN CASE WHEN cv_turno < 0.02::DOUBLE THEN 'estable_oscilante' WHEN cv_turno < 0.1::DOUBLE THEN 'variable_oscilante' ELSE 'inestable' END
      WHEN cv_turno < 0.02::DOUBLE THEN 'muy_estable' WHEN cv_turno < 0.1::DOUBLE THEN 'estable' ELSE 'variable' END AS estabilidad_turno_cat,
    CASE estado_global_rango WHEN 'desconocido' THEN 0 ELSE 1 END AS known
  FROM levels)"""


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def select(parts: list[str], tail: str) -> str:
    return "WITH " + ",".join(parts) + " " + re.sub(r"\s+", " ", tail)


P1 = [GAPPY, FILL, KEYED, STAT_SQL, GAP_SQL, LIMITS, INTERVAL, SHARES, DYNAMICS, JOINED, LABELLED]
PLAIN = [RAW, PASS, KEYED]
KEY = "tag, fecha, turno"
ALL = f"{KEY}, {rounded(*STATS, *GAPS)}, n_muestras, {rounded(*RANGES)}, n_muestras_turno, {rounded(*DYN)}, osc_sign_changes_turno, {rounded('osc_sign_changes_norm_turno')}, {', '.join(LABELS)}"
DYN_COLS = f"n_muestras_turno, {rounded(*DYN)}, osc_sign_changes_turno, {rounded('osc_sign_changes_norm_turno')}"
BOUNDS = """
q AS (SELECT tag, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM raw GROUP BY tag),
bounds AS (SELECT tag AS t, q1, q3, CASE WHEN q3 <> q1 THEN q1 - 1.5::DOUBLE * (q3 - q1) END AS low, CASE WHEN q3 <> q1 THEN q3 + 1.5::DOUBLE * (q3 - q1) END AS high FROM q),
flagged AS (SELECT raw.*, coalesce(value < low OR value > high, FALSE) AS is_outlier_iqr FROM raw LEFT JOIN bounds ON tag = t)"""
LEVEL = "CASE prioridad_atencion WHEN 'Baja' THEN 1 WHEN 'Media' THEN 2 WHEN 'Alta' THEN 3 WHEN 'Crítica' THEN 4 ELSE 0 END"
TS = "epoch_us(ts) AS ts"


def text(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


def said(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def item(name: str, value: str) -> str:
    return f"'* {name}: ' || {value}"


WHO = (item("variable", "tag"), item("fecha", "fecha"), item("turno", "turno"))


def percent(c: str) -> str:
    """Quarters of a per cent with two decimals."""
    q = f"CAST(floor({c} * 4 + 1e-9) AS BIGINT)"
    return f"(CAST({q} // 4 AS VARCHAR) || list_extract(['.00', '.25', '.50', '.75'], {q} % 4 + 1) || '%')"


PROMPTS = {
    "report": text(
        said("Actúa como especialista en operación de ductos y redacta un informe técnico breve, en español, sobre la medición siguiente."), item("fecha", "fecha"), item("turno", "turno"), item("variable", "tag"), item("valor", "'N/A'"),
        said("Explica qué significa el valor, qué pudo causarlo si es anormal y qué conviene hacer. Usa uno o dos párrafos corridos, sin listas."),
    ),
    "range": text(
        said("Resume cómo se mantuvo esta variable frente a su rango normal durante un turno de ocho horas."), *WHO, item("en rango", percent("pct_en_rango")), item("bajo rango", percent("pct_bajo")), item("sobre rango", percent("pct_alto")),
        item("estado", "estado_global_rango"), item("desviación", "desviacion_predominante"), said("Una sola oración en español, de dos líneas como máximo y sin cifras que no estén aquí."),
    ),
    "trend": text(said("Di hacia dónde se movió esta variable durante el turno."), *WHO, item("tendencia", "tendencia_turno_cat"), said("Una sola oración en español, solo con lo dado.")),
    "oscillation": text(said("Di si la señal de esta variable osciló durante el turno."), *WHO, item("oscilación", "osc_turno_cat"), said("Una sola oración en español, solo con lo que indica la categoría.")),
    "stability": text(
        said("Di qué tan estable fue esta variable durante el turno."), *WHO, item("estabilidad", "estabilidad_turno_cat"), item("coeficiente de variación", "'N/A'"), item("cambios de signo normalizados", "'N/A'"), said("Una oración breve en español, sin cifras nuevas."),
    ),
    "summary": text(
        said("Prepara para el informe del turno un resumen del comportamiento de esta variable."), *WHO, item("estado", "estado_global_rango"), item("desviación", "desviacion_predominante"), item("tendencia", "tendencia_turno_cat"),
        item("oscilación", "osc_turno_cat"), item("estabilidad", "estabilidad_turno_cat"), item("prioridad", "prioridad_atencion"), said("De dos a tres líneas en español, sin valores ni estados que no figuren aquí."),
    ),
}

#: The prompts of the reports of one date; the stub answers with their length.
TOLD = f"""
valued AS (SELECT fecha, turno, tag, CAST(CAST(round(mean_turno, 3) * 1000 AS BIGINT) AS DOUBLE) AS valor FROM features WHERE fecha = '2024-01-10'),
told AS (SELECT fecha, turno, tag AS variable, valor, {PROMPTS["report"].replace("'N/A'", "CAST(valor AS VARCHAR)")} AS prompt FROM valued)"""
#: Limits from a history of its own and a given interval.
GIVEN = """
limits AS (SELECT event_type AS t, quantile_cont(value, 0.05) AS lim_inf, quantile_cont(value, 0.95) AS lim_sup FROM events GROUP BY event_type),
span AS (SELECT 15.0::DOUBLE AS interval_min)"""

SQL = {
    "shift_features": select(P1, f"SELECT {ALL} FROM features"),
    "shift_features_composed": select(P1, f"SELECT {ALL} FROM features"),
    "shift_stats": select([*PLAIN, STAT_SQL], f"SELECT {KEY}, {rounded(*STATS)} FROM stats"),
    "shift_gap": select([*PLAIN, STAT_SQL, GAP_SQL], f"SELECT {KEY}, {rounded(*STATS, *GAPS)} FROM gaps"),
    "shift_gap_month": select([*PLAIN, STAT_SQL, MONTH_SQL], f"SELECT {KEY}, {rounded(*STATS, *GAPS)} FROM gaps"),
    "shift_stats_by_user": select([BY_USER, PASS, KEYED, STAT_SQL], f"SELECT {KEY}, {rounded(*STATS)} FROM stats"),
    "shift_labels": select(PLAIN, "SELECT turno, fecha, count(*) AS n FROM keyed GROUP BY turno, fecha"),
    "baseline": select([RAW], "SELECT tag, round(avg(value), 6) AS mean_mes FROM raw GROUP BY tag"),
    "null_summary": select([GAPPY], "SELECT count(*) AS n_rows, count(*) - count(value) AS n_nulls, round((count(*) - count(value)) / count(*) * 100, 6) AS pct_nulls FROM raw"),
    "null_by_tag": select([GAPPY], "SELECT tag, round(avg(CASE WHEN value IS NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_nulls FROM raw GROUP BY tag ORDER BY avg(CASE WHEN value IS NULL THEN 100.0::DOUBLE ELSE 0 END) DESC, tag LIMIT 10"),
    "null_by_time": select([GAPPY], "SELECT epoch_us(t) AS ts, p AS pct_nulls FROM (SELECT ts AS t, round(avg(CASE WHEN value IS NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS p FROM raw GROUP BY ts ORDER BY p DESC, t LIMIT 10)"),
    "tag_variability": select([BY_USER], "SELECT tag, round(stddev_samp(value), 6) AS std FROM raw GROUP BY tag"),
    "least_variable_tags": select([BY_USER], "SELECT tag, round(s, 6) AS std FROM (SELECT tag, stddev_samp(value) AS s FROM raw GROUP BY tag ORDER BY s ASC NULLS LAST, tag LIMIT 10)"),
    "most_variable_tags": select([BY_USER], "SELECT tag, round(s, 6) AS std FROM (SELECT tag, stddev_samp(value) AS s FROM raw GROUP BY tag ORDER BY s DESC NULLS LAST, tag LIMIT 10)"),
    "frozen_tags": select([BY_USER], "SELECT tag, round(s, 6) AS std FROM (SELECT tag, stddev_samp(value) AS s FROM raw GROUP BY tag) WHERE s < 35.0::DOUBLE"),
    "iqr_bounds": select(["raw AS (SELECT l_returnflag AS tag, l_extendedprice AS value FROM lineitem)", BOUNDS], "SELECT t AS tag, round(q1, 6) AS q1, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high FROM bounds"),
    "iqr_outliers": select([GAPPY, BOUNDS], f"SELECT tag, {TS}, round(value, 6) AS value, event_id, is_outlier_iqr FROM flagged WHERE is_outlier_iqr"),
    "iqr_summary": select([GAPPY, BOUNDS], "SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_outlier_iqr) AS n_outliers, round(avg(CASE WHEN is_outlier_iqr THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_outliers FROM flagged"),
    "iqr_sample": select([GAPPY, BOUNDS], "SELECT tag, epoch_us(ts) AS ts, round(value, 6) AS value, event_id, is_outlier_iqr FROM (SELECT * FROM flagged WHERE is_outlier_iqr ORDER BY tag, ts, event_id LIMIT 20)"),
    "interpolate_gaps": select([GAPPY, FILL], f"SELECT tag, {TS}, round(value, 6) AS value, event_id, round(value_interp, 6) AS value_interp FROM filled"),
    "remaining_nulls": select([GAPPY, FILL], "SELECT count(*) FILTER (WHERE value_interp IS NULL) AS n_nulls FROM filled"),
    "clean_long": select([GAPPY, FILL, BOUNDS], "SELECT f.tag, epoch_us(f.ts) AS ts, round(value_interp, 6) AS value, f.event_id, is_outlier_iqr, round(value_interp, 6) AS value_interp FROM flagged f JOIN filled g ON f.event_id = g.event_id"),
    "tag_limits": select([*PLAIN, LIMITS], "SELECT t AS tag, round(lim_inf, 6) AS lim_inf, round(lim_sup, 6) AS lim_sup FROM limits"),
    "sampling_interval": select([*PLAIN, INTERVAL], "SELECT round(interval_min, 6) AS interval_min FROM span"),
    "range_shares": select([*PLAIN, LIMITS, INTERVAL, SHARES], f"SELECT {KEY}, n_muestras, {rounded(*RANGES)} FROM shares"),
    "attach_ranges": select([*PLAIN, STAT_SQL, LIMITS, INTERVAL, SHARES], f"SELECT {KEY}, {rounded(*STATS)}, n_muestras, {rounded(*RANGES)} FROM stats JOIN shares USING (tag, fecha, turno)"),
    "shift_dynamics": select([*PLAIN, DYNAMICS], f"SELECT {KEY}, {DYN_COLS} FROM dyn"),
    "attach_dynamics": select([*PLAIN, STAT_SQL, DYNAMICS], f"SELECT {KEY}, {rounded(*STATS)}, {DYN_COLS} FROM stats JOIN dyn USING (tag, fecha, turno)"),
    "daily_dynamics_ties": select([TIES, PASS, KEYED, DYNAMICS], f"SELECT {KEY}, {DYN_COLS} FROM dyn"),
    "classify_ranges": select(P1, f"SELECT {KEY}, estado_global_rango, desviacion_predominante, prioridad_atencion FROM features"),
    "classify_dynamics": select(P1, f"SELECT {KEY}, osc_turno_cat, tendencia_turno_cat, estabilidad_turno_cat FROM features"),
    "filter_shift": select(P1, f"SELECT {KEY}, {rounded(*STATS)} FROM features WHERE fecha = '2024-01-10' AND turno = 'T2_08_16' AND tag IN ('click', 'view', 'error')"),
    "label_preview": select(P1, f"SELECT {KEY}, {rounded('pct_en_rango', 'pct_bajo', 'pct_alto')}, estado_global_rango, desviacion_predominante, prioridad_atencion, {rounded('cv_turno')}, tendencia_turno_cat, osc_turno_cat, estabilidad_turno_cat FROM features ORDER BY tag, fecha, turno LIMIT 5"),
    "report_kpis": select(P1, "SELECT fecha, turno, round(sum(pct_en_rango * n_muestras) / sum(n_muestras), 6) AS pct_en_rango_global, count(*) AS n_variables, count(*) FILTER (WHERE estado_global_rango = 'OK') AS n_ok, count(*) FILTER (WHERE estado_global_rango NOT IN ('OK', 'desconocido')) AS n_con_desvio, count(*) FILTER (WHERE estado_global_rango = 'Crítica') AS n_criticas FROM features GROUP BY fecha, turno"),
    "report_period": select(PLAIN, "SELECT fecha, turno, min(epoch_us(ts)) AS desde, max(epoch_us(ts)) AS hasta FROM keyed GROUP BY fecha, turno"),
    "report_ok": select(P1, "SELECT fecha, turno, string_agg(tag, ', ' ORDER BY tag) AS variables FROM features WHERE estado_global_rango = 'OK' GROUP BY fecha, turno"),
    "report_deviations": select(P1, f"SELECT {KEY}, CAST(row_number() OVER (PARTITION BY fecha, turno ORDER BY {LEVEL} DESC, pct_en_rango, tag) AS INTEGER) AS orden, estado_global_rango, desviacion_predominante, prioridad_atencion, {rounded('pct_en_rango')} FROM features WHERE estado_global_rango NOT IN ('OK', 'desconocido')"),
    "watch_list": select(P1, f"SELECT * FROM (SELECT {KEY}, CAST(row_number() OVER (PARTITION BY fecha, turno ORDER BY {LEVEL} DESC, abs(gap_pct) DESC NULLS LAST, tag) AS INTEGER) AS orden, prioridad_atencion, {rounded('gap_pct')} FROM features) WHERE orden <= 3"),
    "tag_inventory": select([GAPPY], "SELECT tag, count(*) AS n_filas, min(epoch_us(ts)) AS desde, max(epoch_us(ts)) AS hasta, round(avg(CASE WHEN value IS NULL THEN 100.0::DOUBLE ELSE 0 END), 6) AS pct_nulls, coalesce(stddev_samp(value) < 1e-3, FALSE) AS congelada FROM raw GROUP BY tag"),
    "shift_reports": select([*P1, TOLD], "SELECT fecha, turno, variable, valor, CAST(length(prompt) AS VARCHAR) AS reporte_llm FROM told"),
    "shift_reports_chat": select([*P1, TOLD], "SELECT fecha, turno, variable, valor, CAST(length(prompt) + 13 AS VARCHAR) AS reporte_llm FROM told"),
    "reports_roundtrip": select([*P1, TOLD], """SELECT fecha, turno, variable, valor, '"a", ' || turno || chr(10) || CAST(length(prompt) AS VARCHAR) AS reporte_llm FROM told"""),
    "shift_features_given": select([GAPPY, FILL, KEYED, STAT_SQL, MONTH_SQL, GIVEN, SHARES, DYNAMICS, JOINED, LABELLED], f"SELECT {ALL} FROM features"),
    "shift_gap_unfilled": select([GAPPY, PASS, KEYED, STAT_SQL, GAP_SQL], f"SELECT {KEY}, {rounded(*STATS, *GAPS)} FROM gaps"),
    "features_csv": select(P1, f"SELECT {KEY}, {rounded(*STATS)}, {', '.join(LABELS)} FROM features"),
    "wide_to_long": "WITH c AS (SELECT event_type AS tag, date_trunc('hour', ts) AS h, round(avg(value), 4) AS v FROM events GROUP BY 1, 2), g AS (SELECT t.tag, hs.h FROM (SELECT DISTINCT tag FROM c) t CROSS JOIN (SELECT DISTINCT h FROM c) hs) SELECT g.tag, epoch_us(g.h) AS timestamp, c.v AS value FROM g LEFT JOIN c ON g.tag = c.tag AND g.h = c.h",
    "wide_unpivot": "WITH c AS (SELECT event_type AS tag, date_trunc('day', ts) AS h, round(max(value), 6) AS v FROM events GROUP BY 1, 2), g AS (SELECT t.tag, hs.h FROM (SELECT DISTINCT tag FROM c) t CROSS JOIN (SELECT DISTINCT h FROM c) hs) SELECT g.tag, epoch_us(CAST(g.h AS TIMESTAMP)) AS ts, c.v AS value FROM g LEFT JOIN c ON g.tag = c.tag AND g.h = c.h",
    "features_roundtrip": select(P1, f"SELECT {KEY}, {rounded(*STATS)}, {', '.join(LABELS)} FROM features"),
    "selected_percentiles": "SELECT l_returnflag AS tag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in (("p0", 0.0), ("p1", 0.01), ("p25", 0.25), ("p50", 0.5), ("p95", 0.95), ("p100", 1.0))) + " FROM lineitem GROUP BY l_returnflag",
} | {f"prompt_{k}": select(P1, f"SELECT {KEY}, ") + f"{p} AS prompt FROM features" for k, p in PROMPTS.items()}

# The same results by other ways: selection of ranks, blocks of busy days, and a feature store with a late day.
SQL |= {"shift_stats_selected": SQL["shift_stats"], "shift_dynamics_blocks": SQL["shift_dynamics"], "interpolate_blocks": SQL["interpolate_gaps"], "shift_features_blocks": SQL["shift_features"], "features_incremental": SQL["shift_features_given"]}
SQL |= {
    "reports_resumed": SQL["shift_reports"], "wide_cells": SQL["wide_to_long"], "attach_bucketed": SQL["attach_ranges"], "dynamics_bucketed": SQL["shift_dynamics"],
    "shift_reports_options": select([*P1, TOLD], "SELECT fecha, turno, variable, valor, '200 0.7 0.9 true END' AS reporte_llm FROM told"),
    "shift_reports_quiet": select([*P1, TOLD], "SELECT fecha, turno, variable, valor, ' ' || CAST(length(prompt) AS VARCHAR) || ' 0.9 ' AS reporte_llm FROM told"),
    "report_prompt_fallbacks": "SELECT event_id, " + text(
        said("Actúa como especialista en operación de ductos y redacta un informe técnico breve, en español, sobre la medición siguiente."), item("fecha", "'N/A'"), item("turno", "'N/A'"), item("variable", "event_type"),
        item("valor", "CASE WHEN event_id % 3 <> 0 THEN CAST(CAST(event_id % 1000 AS DOUBLE) AS VARCHAR) ELSE 'N/A' END || CASE WHEN event_id % 2 = 0 THEN ' kPa' ELSE ' N/A' END"),
        said("Explica qué significa el valor, qué pudo causarlo si es anormal y qué conviene hacer. Usa uno o dos párrafos corridos, sin listas."),
    ) + " AS prompt FROM events",
    "checked_columns": "SELECT event_type AS tag, count(*) AS n, 'missing columns: value; the table has tag, ts, event_id' AS said FROM events GROUP BY event_type",
    "wide_permissive": SQL["wide_unpivot"],
    # The least value of at least that rank.
    "approximate_limits": "WITH q AS (SELECT CAST(user_id AS VARCHAR) AS tag, quantile_disc(value, [0.05, 0.95, 0.25, 0.75]) AS q FROM events GROUP BY 1) "
    "SELECT tag, round(q[1], 6) AS lim_inf, round(q[2], 6) AS lim_sup, round(q[3], 6) AS q1, round(q[4], 6) AS q3, CASE WHEN q[3] <> q[4] THEN round(q[3] - 1.5::DOUBLE * (q[4] - q[3]), 6) END AS low, CASE WHEN q[3] <> q[4] THEN round(q[4] + 1.5::DOUBLE * (q[4] - q[3]), 6) END AS high FROM q",
    # As long as a sketch holds all values, its quantile is the least value of at least that rank.
    "sketched_limits": "WITH q AS (SELECT event_type || '/' || CAST(event_id % 16 AS VARCHAR) AS tag, quantile_disc(value, [0.05, 0.95, 0.25, 0.75]) AS q FROM events WHERE CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-14' GROUP BY 1) "
    "SELECT tag, round(q[1], 6) AS lim_inf, round(q[2], 6) AS lim_sup, round(q[3], 6) AS q1, round(q[4], 6) AS q3, CASE WHEN q[3] <> q[4] THEN round(q[3] - 1.5::DOUBLE * (q[4] - q[3]), 6) END AS low, CASE WHEN q[3] <> q[4] THEN round(q[4] + 1.5::DOUBLE * (q[4] - q[3]), 6) END AS high FROM q",
    "streamed_features": select(
        [RAW, PASS, KEYED, STAT_SQL, GAP_SQL, GIVEN, SHARES, DYNAMICS, JOINED, LABELLED],
        f"SELECT {ALL} FROM features WHERE CAST(fecha AS TIMESTAMP) + to_hours(CASE turno WHEN 'T1_00_08' THEN 8 WHEN 'T2_08_16' THEN 16 ELSE 24 END) < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    ),
}
