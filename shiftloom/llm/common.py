"""Helpers shared by the training-data operators: words, stored tables, session settings."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and the control characters from tab to carriage return.
BREAKS = " \t\n\x0b\x0c\r"
BREAK_RUN = r"[\x20\x09-\x0D]+"
#: Whether Spark deletes the shuffle files of a query when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only where none is set, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shiftloom-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Later readers see one fixed set of rows whatever executors come and go, read only the
    columns they need, and start a short lineage. With ``tidy`` the shuffle files of the write go as soon as
    it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/shiftloom-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(TIDY, "false")
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before)
    _own().append(path)
    back = spark.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


_made = threading.local()


def _own() -> list[str]:
    """Folders that :func:`stored` has written in this thread and nothing has deleted. Each thread has its own
    list, so that a run never deletes the tables of another one in the same session."""
    if not hasattr(_made, "paths"):
        _made.paths = []
    return _made.paths


def mark() -> int:
    """Where this thread's list of stored tables stands now, for :func:`release`."""
    return len(_own())


def release(spark: SparkSession, *tables: DataFrame, since: int | None = None, but: DataFrame | None = None) -> None:
    """Deletes stored tables that nothing reads any more: ``tables``, and all that this thread stored after ``since``."""
    own = _own()
    gone = {t.stored_at for t in tables} | set(own[since:] if since is not None else ())
    for path in gone - {but.stored_at if but is not None else None}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        if path in own:
            own.remove(path)


def stored_bytes(table: DataFrame) -> int:
    """Bytes that a stored table takes."""
    spark = table.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def word_count(text: Column) -> Column:
    """Number of words of a text (null or blank: 0)."""
    trimmed = F.btrim(text, F.lit(BREAKS))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BREAK_RUN))).otherwise(0).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Working column names that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        pick = name
        while pick.lower() in taken:
            pick = f"_{pick}"
        taken.add(pick.lower())
        out.append(pick)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
