"""Wide and long sensor tables, feature tables and report tables."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import no_nan
from ..schema import DATE_COL, Columns, feature_schema, require


def header_time(name: Column, strict: bool = True) -> Column:
    """Time that a header names; a header that names none fails, or gives null if not ``strict``."""
    return name.cast("timestamp_ntz") if strict else name.try_cast("timestamp_ntz")


def unpivot_wide(wide: DataFrame, cols: Columns = Columns(), strict: bool = True) -> DataFrame:
    """Wide to long by ``unpivot``, for tables of up to a few hundred columns. Nulls are kept."""
    require(wide, cols.tag)
    times = [c for c in wide.columns if c != cols.tag]
    typed = wide.select(F.col(f"`{cols.tag}`").cast("string").alias(cols.tag), *[F.col(f"`{c}`").cast("double").alias(c) for c in times])
    long = typed.unpivot([F.col(f"`{cols.tag}`")], [F.col(f"`{c}`") for c in times], "header_", cols.value) if times else typed.select(cols.tag, F.lit(None).cast("string").alias("header_"), F.lit(None).cast("double").alias(cols.value)).limit(0)
    timed = long.select(cols.tag, header_time(F.col("header_"), strict).alias(cols.ts), no_nan(F.col(cols.value)).alias(cols.value))
    return timed if strict else timed.where(F.col(cols.ts).isNotNull())


def read_wide_text(spark: SparkSession, path: str, cols: Columns = Columns(), delimiter: str = ",", strict: bool = True, header: str | None = None) -> DataFrame:
    """Wide delimited text straight to long: a line is split once and exploded by position.

    Thousands of columns never become columns of a plan. The header line, the first of ``path`` or of a
    text of its own at ``header``, is read on the driver (one line); its times travel as one array. Values may be quoted; a field with the delimiter inside
    quotes is only allowed in the tag column. Lines with fewer fields than the header give nulls.
    Raises ``ValueError`` if the header lacks the tag column or, if ``strict``, names no time.
    """
    lines = spark.read.text(path)
    head = (spark.read.text(header) if header else lines).limit(1).collect()
    names = next(csv.reader([head[0][0]], delimiter=delimiter)) if head else []
    if cols.tag not in names:
        raise ValueError(f"no column {cols.tag!r} in the header of {path}")
    at = names.index(cols.tag)
    listed = lambda texts: F.split(F.lit("\x00".join(texts)), "\x00", -1)  # noqa: E731  one literal, however many columns
    times = spark.range(1).select(F.posexplode(listed(names)).alias("place", "name")).where(F.col("place") != at)
    times = times.select("place", "name", F.col("name").try_cast("timestamp_ntz").alias(cols.ts))
    known = times.collect()  # one row per header field
    bad = [r["name"] for r in known if r[cols.ts] is None]
    if strict and bad:
        raise ValueError(f"headers that name no time: {bad[:5]}")
    by_place = {r["place"]: r[cols.ts].isoformat(sep=" ") for r in known if r[cols.ts]}
    stamps = listed([by_place.get(i, "") for i in range(len(names))])
    quoted = "\\" + delimiter if delimiter in "|.*+?()[]{}^$\\" else delimiter
    fields = F.split("value", rf'{quoted}(?=(?:[^"]*"[^"]*")*[^"]*$)', -1) if at == 0 else F.split("value", quoted, -1)
    # The look-ahead is needed for a quoted tag only; plain lines take the cheap split.
    parts = F.when(F.col("value").contains('"'), fields).otherwise(F.split("value", quoted, -1))
    rows = lines.where(F.col("value") != F.lit(head[0][0])).select(parts.alias("fields"))
    unquote = lambda c: F.regexp_replace(F.regexp_replace(c, '^"|"$', ""), '""', '"')
    tagged = rows.select(unquote(F.get("fields", F.lit(at))).alias(cols.tag), F.posexplode(F.transform(stamps, lambda s, i: F.struct(s.alias("t"), F.get("fields", i).alias("v")))).alias("place", "cell"))
    cells = tagged.where(F.col("cell.t") != "")
    return cells.select(cols.tag, F.col("cell.t").cast("timestamp_ntz").alias(cols.ts), no_nan(F.nullif(unquote(F.trim("cell.v")), F.lit("")).cast("double")).alias(cols.value))


def long_table(df: DataFrame, tag: str, ts: str, value: str, cols: Columns = Columns(), tiebreak: str | None = None) -> DataFrame:
    """Any table as a long one: tag, time without zone, value without NaN, and the tie-break."""
    require(df, tag, ts, value, *([tiebreak] if tiebreak else []))
    more = [F.col(tiebreak).alias(cols.tiebreak or tiebreak)] if tiebreak else []
    return df.select(F.col(tag).cast("string").alias(cols.tag), F.col(ts).cast("timestamp_ntz").alias(cols.ts), no_nan(F.col(value).cast("double")).alias(cols.value), *more)


def read_features(spark: SparkSession, path: str, form: str = "parquet", tag: str = "Tag de PI") -> DataFrame:
    """A stored feature table (``parquet`` or ``csv`` with a header); the date is text."""
    if form == "csv":
        return spark.read.schema(feature_schema(tag)).csv(path, header=True)
    stored = spark.read.parquet(path)
    return stored.withColumn(DATE_COL, F.col(DATE_COL).cast("string")) if DATE_COL in stored.columns else stored


def write_features(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Feature table to Parquet by date, or to delimited text with a header."""
    if form == "csv":
        df.write.mode(mode).csv(path, header=True)
    else:
        df.repartition(DATE_COL).write.mode(mode).partitionBy(DATE_COL).parquet(path)


REPORT_SCHEMA = T.StructType(
    [T.StructField("fecha", T.StringType()), T.StructField("turno", T.StringType()), T.StructField("variable", T.StringType()), T.StructField("valor", T.DoubleType()), T.StructField("reporte_llm", T.StringType())]
)


def write_reports(df: DataFrame, path: str, form: str = "csv", mode: str = "errorifexists") -> None:
    """Report texts; delimited text quotes every field, since reports hold line ends."""
    if form == "csv":
        df.write.mode(mode).option("quoteAll", True).option("escape", '"').csv(path, header=True)
    else:
        df.write.mode(mode).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, for plans that read it several times."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_reports(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    """Report texts as :func:`write_reports` leaves them."""
    if form == "csv":
        return spark.read.schema(REPORT_SCHEMA).option("multiLine", True).option("escape", '"').csv(path, header=True)
    return spark.read.schema(REPORT_SCHEMA).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of the cluster, or in a temporary one if none is set."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{(named or tempfile.mkdtemp(prefix='shiftloom-')).rstrip('/')}/tables-{uuid.uuid4().hex}"
