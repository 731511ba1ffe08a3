"""Data quality: nulls, variability, outliers and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import no_nan
from ..schema import Columns, require
from .blocks import add_slots
from .percentiles import group_percentiles


def null_summary(long: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """One row: n_rows, n_nulls, pct_nulls (null for an empty table)."""
    n, have = F.count("*"), F.count(cols.value)
    return long.agg(n.alias("n_rows"), (n - have).alias("n_nulls"), F.when(n > 0, (n - have) / n * 100).alias("pct_nulls"))


def null_share(long: DataFrame, by: str, cols: Columns = Columns(), top: int | None = 10) -> DataFrame:
    """Per cent of nulls by ``by`` (a tag or time column), the highest first; null keys are left out."""
    shares = long.where(F.col(f"`{by}`").isNotNull()).groupBy(by).agg(F.avg(F.col(cols.value).isNull().cast("double") * 100).alias("pct_nulls"))
    ordered = shares.orderBy(F.desc("pct_nulls"), by)
    return ordered.limit(top) if top else ordered


def tag_variability(long: DataFrame, cols: Columns = Columns()) -> DataFrame:
    """Sample standard deviation by tag (null for fewer than two values)."""
    return long.where(F.col(f"`{cols.tag}`").isNotNull()).groupBy(cols.tag).agg(F.stddev_samp(cols.value).alias("std"))


def extreme_tags(variability: DataFrame, cols: Columns = Columns(), n: int = 10, highest: bool = False) -> DataFrame:
    """The ``n`` least (or most) variable tags; tags without a deviation come last."""
    order = F.desc_nulls_last("std") if highest else F.asc_nulls_last("std")
    return variability.orderBy(order, cols.tag).limit(n)


def frozen_tags(variability: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Near-constant tags: deviation strictly under the threshold."""
    return variability.where(F.col("std") < F.lit(threshold))


def iqr_bounds(long: DataFrame, cols: Columns = Columns(), factor: float = 1.5, approx: bool = False) -> DataFrame:
    """q1, q3 and the bounds by tag; no bounds where the quartiles are equal or no value exists.

    Exact quartiles of a large tag are selected in rounds, so no task holds all its values; ``approx``
    takes approximate ones in one pass.
    """
    rows = long.where(F.col(f"`{cols.tag}`").isNotNull())
    if approx:
        out = rows.groupBy(cols.tag).agg(F.percentile_approx(cols.value, [0.25, 0.75]).alias("q"))
    else:
        out = group_percentiles(rows, [cols.tag], cols.value, [0.25, 0.75], "q")
    out = out.select(cols.tag, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    reach = F.lit(factor) * (F.col("q3") - F.col("q1"))
    return out.withColumns({"low": F.when(reach != 0, F.col("q1") - reach), "high": F.when(reach != 0, F.col("q3") + reach)})


def flag_outliers(long: DataFrame, bounds: DataFrame, cols: Columns = Columns(), flag: str = "is_outlier_iqr") -> DataFrame:
    """Adds ``flag``: strictly outside the tag's bounds; null values and tags without bounds: false.

    ``bounds`` has a row per tag; Spark broadcasts it if it is small and shuffles both sides if not.
    """
    own = bounds.select(F.col(f"`{cols.tag}`").alias("tag_b"), "low", "high")
    v = F.col(cols.value)
    joined = long.join(own, F.col(f"`{cols.tag}`") == F.col("tag_b"), "left")
    return joined.withColumn(flag, F.coalesce((v < F.col("low")) | (v > F.col("high")), F.lit(False))).drop("tag_b", "low", "high")


def outlier_summary(flagged: DataFrame, flag: str = "is_outlier_iqr") -> DataFrame:
    """One row: n_rows, n_outliers, pct_outliers."""
    hit = F.col(flag).cast("long")
    return flagged.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_outliers"), F.avg(hit.cast("double") * 100).alias("pct_outliers"))


def outlier_sample(flagged: DataFrame, cols: Columns = Columns(), flag: str = "is_outlier_iqr", n: int = 20) -> DataFrame:
    """The first flagged rows by tag and time (a report of ``n`` rows)."""
    more = [cols.tiebreak] if cols.tiebreak else []
    return flagged.where(flag).orderBy(cols.tag, cols.ts, *more, cols.value).limit(n)


def interpolate_gaps(long: DataFrame, cols: Columns = Columns(), out: str = "value_interp", busy: int | None = None) -> DataFrame:
    """Fills null values of each tag linearly by position in time order, not by time.

    Leading nulls take the first value, trailing ones the last; a tag without values stays null.
    Two levels keep a long tag off one task: values are numbered and filled within a tag and day, or a slot of
    a day with more than ``busy`` samples, and only one summary row for each of those passes through a window over the tag.
    """
    require(long, cols.tag, cols.ts, cols.value)
    filled = fill_blocks(add_slots(long, cols, busy), cols, out)
    return filled.select(*[f"`{c}`" for c in long.columns if c != out], out)


def following(name: str, keys: list[str], order: list[str]) -> Column:
    """The next value of ``name`` that isn't null, in one pass over the window: a frame that ends with the window
    would be read again for every row."""
    return F.expr(f"lead({name}) IGNORE NULLS OVER (PARTITION BY {', '.join(keys)} ORDER BY {', '.join(order)})")


def number_blocks(slotted: DataFrame, cols: Columns) -> tuple[DataFrame, DataFrame, list[str]]:
    """(rows with their number n_ in the block and value v_, a row for each block with its first and last
    value and their numbers, the order of rows)."""
    order = [f"`{c}`" for c in (cols.ts, cols.tiebreak, cols.value) if c]
    within = Window.partitionBy(f"`{cols.tag}`", "day_", "slot_").orderBy(*order)
    numbered = slotted.withColumn("n_", F.row_number().over(within).cast("long")).withColumn("v_", no_nan(F.col(f"`{cols.value}`")))
    seen = F.when(F.col("v_").isNotNull(), F.struct(F.col("n_").alias("n"), F.col("v_").alias("v")))
    blocks = numbered.groupBy(F.col(f"`{cols.tag}`").alias("tag_"), F.col("day_").alias("d_"), F.col("slot_").alias("s_")).agg(
        F.count("*").alias("rows_"), F.count("v_").alias("values_"), F.min(seen).alias("first_"), F.max(seen).alias("last_")
    )
    return numbered, blocks, order


def moved(place: str, by: Column) -> Column:
    """A struct (n, v) further on by so many rows."""
    return F.when(F.col(place).isNotNull(), F.struct((F.col(place)["n"] + by).alias("n"), F.col(place)["v"].alias("v")))


def neighbours(blocks: DataFrame, keys: list[str], order: list[str], first: str = "first_", last: str = "last_") -> DataFrame:
    """``blocks`` with offset_, the rows before the block within ``keys``, and the last value before and the
    first after it, with numbers counted within ``keys``."""
    by = Window.partitionBy(*keys).orderBy(*[F.expr(o) if " " not in o else F.col(o.split(" ")[0]).asc_nulls_first() for o in order])
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("offset_", F.coalesce(F.sum("rows_").over(earlier), F.lit(0)))
    placed = placed.withColumns({"a_": moved(last, F.col("offset_")), "b_": moved(first, F.col("offset_"))})
    return placed.withColumns({"before_": F.last("a_", ignorenulls=True).over(earlier), "after_": following("b_", keys, order)}).drop("a_", "b_")


def fill_blocks(slotted: DataFrame, cols: Columns, out: str, around: DataFrame | None = None) -> DataFrame:
    """:func:`interpolate_gaps` of rows with day_ and slot_, which stay.

    ``around`` has for each tag_ and d_ the neighbouring values on other days, as before_ and after_ with
    numbers counted from the day's start: then only the days at hand are needed.
    """
    tag = f"`{cols.tag}`"
    numbered, blocks, by_n = number_blocks(slotted, cols)
    if around is None:
        days = neighbours(blocks, ["tag_"], ["d_ ASC NULLS FIRST", "s_"])
    else:
        days = neighbours(blocks, ["tag_", "d_"], ["s_"])
        own = around.select(F.col("tag_").alias("t2_"), F.col("d_").alias("d2_"), F.col("before_").alias("before2_"), F.col("after_").alias("after2_"))
        days = days.join(own, F.col("tag_").eqNullSafe(F.col("t2_")) & F.col("d_").eqNullSafe(F.col("d2_")), "left")
        days = days.withColumns({"before_": F.coalesce("before_", "before2_"), "after_": F.coalesce("after_", "after2_")})
    days = days.select("tag_", "d_", "s_", "offset_", "before_", "after_")
    joined = numbered.join(days, F.col(tag).eqNullSafe(F.col("tag_")) & F.col("day_").eqNullSafe(F.col("d_")) & (F.col("slot_") == F.col("s_")))
    have = F.col("v_").isNotNull()
    at = F.col("offset_") + F.col("n_")
    here = F.when(have, F.struct(at.alias("n"), F.col("v_").alias("v")))
    up = Window.partitionBy(tag, "day_", "slot_").orderBy(*by_n).rowsBetween(Window.unboundedPreceding, 0)
    near = joined.withColumn("here_", here).withColumn("l_", F.coalesce(F.last("here_", ignorenulls=True).over(up), F.col("before_")))
    near = near.withColumn("r_", F.coalesce("here_", following("here_", [tag, "day_", "slot_"], by_n), F.col("after_")))
    line = F.col("l_.v") + (F.col("r_.v") - F.col("l_.v")) * (at - F.col("l_.n")) / (F.col("r_.n") - F.col("l_.n"))
    filled = F.when(have, F.col("v_")).when(F.col("l_").isNull(), F.col("r_.v")).when(F.col("r_").isNull(), F.col("l_.v")).otherwise(line)
    return near.withColumn(out, filled).select(*[f"`{c}`" for c in slotted.columns if c != out], out)


def day_blocks(slotted: DataFrame, cols: Columns) -> DataFrame:
    """A row for each tag_ and d_: rows_, values_, and its first and last value with their numbers in the day."""
    _, blocks, _ = number_blocks(slotted, cols)
    placed = neighbours(blocks, ["tag_", "d_"], ["s_"])
    return placed.groupBy("tag_", "d_").agg(F.sum("rows_").alias("rows_"), F.sum("values_").alias("values_"), F.min(moved("first_", F.col("offset_"))).alias("first_"), F.max(moved("last_", F.col("offset_"))).alias("last_"))


def around_days(days: DataFrame) -> DataFrame:
    """What :func:`fill_blocks` needs of other days, from the table of all days: tag_, d_, before_, after_, and
    whether the day has_nulls_ to fill."""
    placed = neighbours(days, ["tag_"], ["d_ ASC NULLS FIRST"])
    return placed.select("tag_", "d_", moved("before_", -F.col("offset_")).alias("before_"), moved("after_", -F.col("offset_")).alias("after_"), (F.col("rows_") > F.col("values_")).alias("has_nulls_"))


def remaining_nulls(df: DataFrame, col: str = "value_interp") -> DataFrame:
    """One row: values still null."""
    return df.agg(F.count_if(F.col(col).isNull()).alias("n_nulls"))


def clean_long(long: DataFrame, cols: Columns = Columns(), interpolate: bool = True, bounds: DataFrame | None = None) -> DataFrame:
    """Outlier flags on raw values, then gaps filled; ``value`` is the filled one if ``interpolate``."""
    flagged = flag_outliers(long, bounds if bounds is not None else iqr_bounds(long, cols), cols)
    if not interpolate:
        return flagged
    return interpolate_gaps(flagged, cols).withColumn(cols.value, F.col("value_interp"))
