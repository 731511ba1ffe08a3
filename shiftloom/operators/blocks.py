"""Time blocks: a tag with very many samples in a day is worked on in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Columns
from ..sources.tables import kept

#: Samples of a tag and day up to which they stay one block, and blocks of a busier day.
BUSY, SLOTS = 200_000, 64


def add_slots(long: DataFrame, cols: Columns = Columns(), busy: int | None = None) -> DataFrame:
    """Adds day_ and slot_; rows of a tag and day in order of (slot_, time) are in order of time.

    A day of more than ``busy`` samples is cut into SLOTS ranges of about as many samples each, at times
    that a bounded-memory quantile sketch gives; other days are slot 0. Equal times share a slot. The table of
    busy days has a row for each and is stored, so Spark knows its size; without any, no join is made.
    """
    most = BUSY if busy is None else busy
    tag, day = F.col(f"`{cols.tag}`"), F.to_date(cols.ts)
    counts = long.where(F.col(cols.ts).isNotNull()).groupBy(tag.alias("busy_tag"), day.alias("busy_day")).agg(F.count("*").alias("n"))
    days = kept(counts.where(F.col("n") > most).select("busy_tag", "busy_day"))
    dated = long.withColumn("day_", day)
    if not days.limit(1).count():
        return dated.withColumn("slot_", F.lit(0))
    # Cuts are times themselves: a time turned into a number would be so again for every cut.
    shares = [i / SLOTS for i in range(1, SLOTS)]
    same = tag.eqNullSafe(F.col("busy_tag")) & (day == F.col("busy_day"))
    cuts = kept(long.join(days, same).groupBy("busy_tag", "busy_day").agg(F.percentile_approx(cols.ts, shares, 1000).alias("cuts")))
    placed = dated.join(cuts, tag.eqNullSafe(F.col("busy_tag")) & (F.col("day_") == F.col("busy_day")), "left")
    slot = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(cols.ts))), F.lit(0))
    return placed.withColumn("slot_", F.when(F.col("cuts").isNotNull(), slot).otherwise(0)).drop("busy_tag", "busy_day", "cuts")


def fold_turns(edges: Column) -> Column:
    """signs and turns of a whole shift from its blocks: ``edges`` has for each block, in any order, a struct
    day, slot, first, last (values), head, tail (signs), signs, turns; day and slot order them."""
    empty = F.struct(F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("tail"), F.lit(0).cast("long").alias("signs"), F.lit(0).cast("long").alias("turns"))

    def add(acc: Column, b: Column) -> Column:
        step = F.signum(b["first"] - acc["last"])
        met = F.when(step != 0, step)  # the step from the block before into this one
        differs = lambda x, y: F.coalesce((x != y).cast("long"), F.lit(0))
        return F.struct(
            F.coalesce(b["last"], acc["last"]).alias("last"), F.coalesce(b["tail"], met, acc["tail"]).alias("tail"),
            (acc["signs"] + b["signs"] + met.isNotNull().cast("long")).alias("signs"),
            (acc["turns"] + b["turns"] + differs(met, acc["tail"]) + differs(b["head"], F.coalesce(met, acc["tail"]))).alias("turns"),
        )

    return F.aggregate(F.array_sort(edges), empty, add)
