"""Prompt columns, batch generation by a user's model, and clean-up of its output."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import MappingProxyType

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import tidy
from ..schema import DATE_COL, SHIFT_COL, Columns
from ..sources.tables import kept
from .report import filter_shift

# Defaults of a generation call.
GENERATION = MappingProxyType({"max_new_tokens": 200, "temperature": 0.4, "top_p": 0.9, "do_sample": True})

Generator = Callable[..., list[str]]


def shown(c: Column) -> Column:
    """A value as text; null reads N/A."""
    return F.coalesce(c.cast("string"), F.lit("N/A"))


def first_column(df: DataFrame, names: tuple[str, ...], fallback: str) -> Column:
    """The first of ``names`` that the table has, or the text ``fallback``."""
    return next((shown(F.col(f"`{n}`")) for n in names if n in df.columns), F.lit(fallback))


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def item(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"* {name}: "), value)


def report_prompt(df: DataFrame) -> Column:
    """Prompt for a report of one variable; slots fall back to other column names, then to texts."""
    value = F.concat_ws(" ", first_column(df, ("valor", "value"), "N/A"), first_column(df, ("unidad", "unit"), ""))
    return lines(
        "Actúa como especialista en operación de ductos y redacta un informe técnico breve, en español, sobre la medición siguiente.",
        item("fecha", first_column(df, (DATE_COL,), "N/A")), item("turno", first_column(df, (SHIFT_COL,), "N/A")),
        item("variable", first_column(df, ("variable", "tag"), "variable")), item("valor", tidy(value)),
        "Explica qué significa el valor, qué pudo causarlo si es anormal y qué conviene hacer. Usa uno o dos párrafos corridos, sin listas.",
    )


def subject(cols: Columns) -> list[Column]:
    return [item("variable", shown(F.col(f"`{cols.tag}`"))), item("fecha", shown(F.col(DATE_COL))), item("turno", shown(F.col(SHIFT_COL)))]


def percent(name: str) -> Column:
    return F.coalesce(F.format_string("%.2f%%", F.col(name)), F.lit("N/A"))


def range_prompt(cols: Columns = Columns()) -> Column:
    return lines(
        "Resume cómo se mantuvo esta variable frente a su rango normal durante un turno de ocho horas.", *subject(cols),
        item("en rango", percent("pct_en_rango")), item("bajo rango", percent("pct_bajo")), item("sobre rango", percent("pct_alto")),
        item("estado", shown(F.col("estado_global_rango"))), item("desviación", shown(F.col("desviacion_predominante"))),
        "Una sola oración en español, de dos líneas como máximo y sin cifras que no estén aquí.",
    )


def trend_prompt(cols: Columns = Columns()) -> Column:
    return lines("Di hacia dónde se movió esta variable durante el turno.", *subject(cols), item("tendencia", shown(F.col("tendencia_turno_cat"))), "Una sola oración en español, solo con lo dado.")


def oscillation_prompt(cols: Columns = Columns()) -> Column:
    return lines("Di si la señal de esta variable osciló durante el turno.", *subject(cols), item("oscilación", shown(F.col("osc_turno_cat"))), "Una sola oración en español, solo con lo que indica la categoría.")


def stability_prompt(df: DataFrame, cols: Columns = Columns()) -> Column:
    """The raw figures are optional columns."""
    return lines(
        "Di qué tan estable fue esta variable durante el turno.", *subject(cols), item("estabilidad", shown(F.col("estabilidad_turno_cat"))),
        item("coeficiente de variación", first_column(df, ("cv_turno",), "N/A")), item("cambios de signo normalizados", first_column(df, ("osc_sign_changes_norm_turno",), "N/A")),
        "Una oración breve en español, sin cifras nuevas.",
    )


def summary_prompt(cols: Columns = Columns()) -> Column:
    named = {
        "estado": "estado_global_rango", "desviación": "desviacion_predominante", "tendencia": "tendencia_turno_cat",
        "oscilación": "osc_turno_cat", "estabilidad": "estabilidad_turno_cat", "prioridad": "prioridad_atencion",
    }
    return lines(
        "Prepara para el informe del turno un resumen del comportamiento de esta variable.", *subject(cols),
        *[item(k, shown(F.col(c))) for k, c in named.items()], "De dos a tres líneas en español, sin valores ni estados que no figuren aquí.",
    )


def generate(df: DataFrame, factory: Callable[[], Generator], prompt: str = "prompt", out: str = "reporte_llm", workers: int | None = None, formatter: Callable[[str], str] | None = None, **options) -> DataFrame:
    """Adds ``out``: the model's text for each prompt.

    ``factory`` builds the model once per task; the model takes a list of prompts and the generation
    options. ``formatter`` wraps each prompt as a chat message. ``workers`` bounds the tasks that hold
    a model. An output that begins with its prompt, wrapped or not, loses it.
    """
    settings = {**GENERATION, **options}

    def run(batches: Iterator) -> Iterator:
        model = None
        for pdf in batches:
            model = model or factory()
            sent = [formatter(p) if formatter else p for p in pdf[prompt]]
            yield pdf.assign(**{out: model(sent, **settings) if sent else [], "sent_": sent})

    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, T.StringType()), T.StructField("sent_", T.StringType())])
    told = (df.repartition(workers) if workers else df).drop(out).mapInPandas(run, schema)
    echoes = F.startswith(F.col(out), F.col("sent_")) & (F.length("sent_") > 0)
    return told.withColumn(out, strip_echo(F.col(out), F.when(echoes, F.col("sent_")).otherwise(F.col(prompt)))).drop("sent_")


def resumable(df: DataFrame, factory: Callable[[], Generator], store: str, prompt: str = "prompt", out: str = "reporte_llm", model: str = "", piece: int = 1000, formatter: Callable[[str], str] | None = None, **options) -> DataFrame:
    """:func:`generate` with a table of results at ``store``, so that no prompt is ever sent twice.

    A result is keyed by a hash of the prompt as it is sent, the name ``model`` and the options. Prompts without
    a result, each once however many rows ask it, are sent in pieces of about ``piece``, and every piece
    is appended when it is done: a run that stops goes on where it was, and a lost task repeats its share
    of one piece. A null prompt isn't sent and has a null text. Runs that share a store should not overlap:
    they might both send a prompt, and the first result by text is taken.
    """
    spark = df.sparkSession
    settings = json.dumps({**GENERATION, **options}, sort_keys=True, default=str)
    shape = formatter("\x00") if formatter else ""
    name = next(f"key{'_' * i}" for i in range(1, 99) if f"key{'_' * i}" not in df.columns)
    keyed = df.withColumn(name, F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(settings), F.lit(shape), F.col(prompt)), 256)).drop(out)
    known = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])

    def results() -> DataFrame:
        where = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        return spark.read.schema(known).parquet(store) if there else spark.createDataFrame([], known)

    todo = kept(keyed.where(F.col(prompt).isNotNull()).select(F.col(name).alias("key"), F.col(prompt).alias("prompt")).distinct().join(results(), "key", "left_anti"))
    pieces = -(-todo.count() // piece)
    for i in range(pieces):
        part = todo.where(F.pmod(F.xxhash64("key"), F.lit(pieces)) == i)
        generate(part, factory, "prompt", "text", formatter=formatter, **options).select("key", "text").write.mode("append").parquet(store)
    told = results().groupBy("key").agg(F.min("text").alias(out)).withColumnRenamed("key", "told_")
    return keyed.join(told, F.when(F.col(prompt).isNotNull(), F.col(name)) == F.col("told_"), "left").drop(name, "told_")


def strip_echo(text: Column, prompt: Column) -> Column:
    """``text`` without a leading ``prompt``, trimmed in that case."""
    return F.when(F.startswith(text, prompt) & (F.length(prompt) > 0), tidy(F.substring(text, F.length(prompt) + 1, F.length(text)))).otherwise(text)


def shift_reports(features: DataFrame, factory: Callable[[], Generator], date: str | None = None, shift: str | None = None, tags: list[str] | None = None, cols: Columns = Columns(), value: str = "mean_turno", store: str | None = None, **options) -> DataFrame:
    """Report texts of the chosen rows: filter first, then one prompt and one text per row. With ``store``, results are
    kept there and no prompt is sent again (:func:`resumable`)."""
    chosen = filter_shift(features, date, shift, tags, cols.tag)
    named = chosen.select(F.col(DATE_COL).cast("string").alias("fecha"), F.col(SHIFT_COL).alias("turno"), F.col(f"`{cols.tag}`").alias("variable"), F.col(value).alias("valor"))
    asked = named.withColumn("prompt", report_prompt(named))
    told = resumable(asked, factory, store, **options) if store else generate(asked, factory, **options)
    return told.select("fecha", "turno", "variable", "valor", "reporte_llm")
