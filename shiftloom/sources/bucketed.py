"""Tables bucketed and sorted by their key, which joins and shift windows read without an exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.shifts import key_columns, keyed
from ..schema import DATE_COL, Columns, require


def write_bucketed(df: DataFrame, table: str, buckets: int, cols: Columns = Columns(), mode: str = "errorifexists") -> DataFrame:
    """Feature tables as table ``table``, in ``buckets`` buckets of the key (tag, date, shift), sorted by it.

    Rows go to their bucket first, so each bucket is one file. Two tables of equal ``buckets`` are joined on the key
    bucket by bucket; Spark wants all of a join's keys in the buckets. Take buckets by the size of the table, not of the cluster.
    """
    keys = key_columns(cols)
    require(df, *keys)
    df.repartition(buckets, *[f"`{k}`" for k in keys]).write.bucketBy(buckets, *keys).sortBy(*keys).mode(mode).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def write_samples(long: DataFrame, table: str, buckets: int, cols: Columns = Columns(), mode: str = "errorifexists") -> DataFrame:
    """A long table with its shift and date, bucketed by tag and date and sorted by time: statistics, windows and
    aggregations by shift then start from the buckets. Rows without tag or time are left out."""
    rows = keyed(long, cols)
    order = [c for c in (cols.ts, cols.tiebreak) if c]
    rows.repartition(buckets, f"`{cols.tag}`", DATE_COL).write.bucketBy(buckets, cols.tag, DATE_COL).sortBy(cols.tag, DATE_COL, *order).mode(mode).format("parquet").saveAsTable(table)
    return long.sparkSession.table(table)


def new_table(spark: SparkSession, kind: str) -> str:
    """A table name that nothing uses yet."""
    return f"shiftloom_{kind}_{uuid.uuid4().hex}"
