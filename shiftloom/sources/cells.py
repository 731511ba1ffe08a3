"""Very wide delimited text, read cell by cell: one line is read in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import no_nan
from ..schema import Columns
from .tables import kept


def read_cells(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """file, line, place (both from 0) and text of every cell of delimited text.

    The delimiter is the record separator of Spark's text reader, so files are cut at byte ranges wherever lines
    end. Cells are numbered by their split: a row for each split says how many cells come before it and
    where lines end in it. Meant for lines of thousands of cells and more, as a split lists its line
    ends. Quoted delimiters and line ends aren't told from others.
    """
    raw = spark.read.option("lineSep", delimiter).text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    parts = F.split("value", "\r?\n", -1)
    ends = (F.size(parts) - 1).cast("long")
    told = F.when(ends > 0, F.struct(F.col("id").alias("id"), ends.alias("ends")))
    # A row for each split, with the line ends in it.
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("from"), F.count("*").alias("cells"), F.sum(ends).alias("ends"), F.array_sort(F.collect_list(told)).alias("breaks"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"base": F.coalesce(F.sum("cells").over(before), F.lit(0)), "lines": F.coalesce(F.sum("ends").over(before), F.lit(0))})
    here = F.when(F.size("breaks") > 0, F.col("base") + F.element_at("breaks", -1)["id"] - F.col("from"))
    splits = kept(splits.withColumn("start", F.coalesce(F.last(here, ignorenulls=True).over(before), F.lit(0))).select(F.col("file").alias("f"), F.col("block").alias("b"), "from", "base", "lines", "start", "breaks"))
    placed = raw.join(splits, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    place = F.col("base") + F.col("id") - F.col("from")
    passed = F.filter("breaks", lambda x: x["id"] < F.col("id"))
    line = F.col("lines") + F.aggregate(passed, F.lit(0).cast("long"), lambda a, x: a + x["ends"])
    start = F.when(F.size(passed) > 0, F.col("base") + F.element_at(passed, -1)["id"] - F.col("from")).otherwise(F.col("start"))
    cells = placed.select("file", line.alias("line"), (place - start).alias("place"), F.posexplode(parts).alias("at", "text"))
    return cells.select("file", (F.col("line") + F.col("at")).alias("line"), F.when(F.col("at") == 0, F.col("place")).otherwise(0).alias("place"), "text")


def read_very_wide_text(spark: SparkSession, path: str, cols: Columns = Columns(), delimiter: str = ",", strict: bool = True) -> DataFrame:
    """Wide delimited text to long, with no line, header included, ever in one task or on the driver.

    Every file begins with its header. Cells meet their column's time and their line's tag in joins. Cells may be
    in quotes, but not hold the delimiter or a line end; empty cells are null; lines that are empty or have no tag column are left out, and
    a line shorter than the header has no rows for what is missing. Raises ``ValueError`` if a header lacks the tag column or, if ``strict``, names no time.
    """
    cells = read_cells(spark, path, delimiter)
    bare = F.regexp_replace(F.trim("text"), '^"|"$', "")
    header = kept(cells.where("line = 0").select(F.col("file").alias("f"), F.col("place").alias("p"), bare.alias("name")).withColumn("time", F.col("name").try_cast("timestamp_ntz")))
    is_tag = F.col("name") == F.lit(cols.tag)
    counts = header.groupBy("f").agg(F.count_if(is_tag).alias("tags"), F.count_if(~is_tag & F.col("time").isNull()).alias("bad")).agg(F.min("tags").alias("tags"), F.sum("bad").alias("bad")).first()
    if not counts["tags"]:
        raise ValueError(f"no column {cols.tag!r} in a header of {path}")
    if strict and counts["bad"]:
        bad = [r[0] for r in header.where(~is_tag & F.col("time").isNull()).select("name").limit(5).collect()]
        raise ValueError(f"headers that name no time: {bad}")
    body = cells.where("line > 0").withColumn("text", bare)
    tag_place = header.where(is_tag).groupBy(F.col("f").alias("tf")).agg(F.min("p").alias("tp"))
    tags = body.join(tag_place, (F.col("file") == F.col("tf")) & (F.col("place") == F.col("tp"))).select(F.col("file").alias("lf"), F.col("line").alias("ll"), F.col("text").alias("tag_")).where("tag_ <> ''")
    timed = body.join(header.where(F.col("time").isNotNull() & ~is_tag), (F.col("file") == F.col("f")) & (F.col("place") == F.col("p")))
    named = timed.join(tags, (F.col("file") == F.col("lf")) & (F.col("line") == F.col("ll")))
    return named.select(F.col("tag_").alias(cols.tag), F.col("time").alias(cols.ts), no_nan(F.nullif("text", F.lit("")).cast("double")).alias(cols.value))
