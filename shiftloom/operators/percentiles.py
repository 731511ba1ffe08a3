"""Exact percentiles of groups of any size, by distributed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import no_nan
from ..sources.tables import kept

#: Values of a group that one task may hold: larger groups are narrowed down first.
SMALL = 1_000_000
#: Size of a quantile sketch, equal steps of rank at which its quantiles are asked, and by how many of them the outer
#: pivots stand apart from their target (its ranks are off by 0.13 % at most, 99 % sure).
SKETCH, GRID, REACH = 4096, 4096, 7
#: Rounds of narrowing at most. One leaves a few thousandths of the values, or nothing where the sketch holds all of them.
ROUNDS = 200


def group_percentiles(rows: DataFrame, keys: list[str], value: str, at: list[float], out: str = "p_", small: int | None = None) -> DataFrame:
    """``keys`` and the array ``out``: the exact percentiles ``at`` (0 to 1) of ``value``, linear between neighbours.

    Null values and NaN are skipped; a group without values has a null array. Groups of up to ``small``
    values (and those with a null key) are aggregated as they are. The rest is selected by :func:`select_ranks`, so no
    task ever holds more than ``small`` values of a group, however many differ.
    """
    bound = SMALL if small is None else small
    names = {f"k{i}_": F.col(f"`{k}`") for i, k in enumerate(keys)}
    have = rows.select(*[c.alias(n) for n, c in names.items()], no_nan(F.col(f"`{value}`").cast("double")).alias("v_"))
    plain = F.percentile("v_", F.array(*[F.lit(float(q)) for q in at])).alias(out)
    back = lambda df: df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], out)
    counts = have.groupBy(*names).agg(F.count("v_").alias("n_"))
    if (counts.agg(F.max("n_")).first()[0] or 0) <= bound:
        return back(have.groupBy(*names).agg(plain))
    large = kept(counts.where(F.col("n_") > bound).dropna(subset=list(names)))
    few = have.join(large.select(*names), list(names), "left_anti").groupBy(*names).agg(plain)
    place = [F.lit(float(q)) * (F.col("n_") - 1) for q in at]
    wanted = large.withColumn("ranks_", F.array(*[r for x in place for r in (F.floor(x), F.ceil(x))]))
    found = select_ranks(have.where(F.col("v_").isNotNull()), list(names), wanted, bound).join(large, list(names))
    value = lambda i: F.get("at_", F.lit(i))
    between = [value(2 * i) + (value(2 * i + 1) - value(2 * i)) * (x - F.floor(x)) for i, x in enumerate(place)]
    # Equal neighbours, infinite ones too, need no arithmetic.
    exact = [F.when(value(2 * i) == value(2 * i + 1), value(2 * i)).otherwise(b) for i, b in enumerate(between)]
    return back(few.unionByName(found.select(*names, F.array(*exact).alias(out))))


def select_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, bound: int, sketches: DataFrame | None = None) -> DataFrame:
    """Keys and the array ``at_``: the values of ``rows`` (keys, ``v_`` without nulls) at the places ``ranks_``, from 0, of each
    group's ``n_`` values in order. ``wanted`` has the keys, n_ and ranks_.

    A mergeable sketch of each group proposes pivots around the ranks. One pass counts the values at and
    between the pivots, which tells what is at a pivot or else in which cell between two of them a rank is. Only the
    values of those cells go on to the next round, until a cell has ``bound`` values or fewer. A pivot that is the
    answer ends its rank at once, so repeated values don't hold a round up. Sketches only propose; counts
    decide. ``sketches`` (keys, ``s_``) are those of the first round where they are stored already.
    """
    by = [*keys, "c_"]
    want = F.transform("ranks_", lambda r, i: F.struct(i.alias("i"), r.cast("long").alias("r")))
    cells = wanted.select(*keys, F.lit(0).alias("c_"), "n_", F.lit(0).cast("long").alias("below_"), want.alias("want_"))
    rows, known, given = rows.withColumn("c_", F.lit(0)), [], sketches
    for _ in range(ROUNDS):
        most = cells.agg(F.max("n_")).first()[0]
        if most is None or (most <= bound and given is None):
            break
        if known:
            rows = kept(rows)
        cells, rows, settled = narrow(rows, keys, cells, given)
        known.append(settled)
        given = None
    if most is not None:
        held = rows.groupBy(*by).agg(F.sort_array(F.collect_list("v_")).alias("vs_"))  # up to ``bound`` values
        last = held.join(cells, by).select(*keys, "vs_", "below_", F.explode("want_").alias("w_"))
        known.append(last.select(*keys, F.col("w_.i").alias("i"), F.get("vs_", (F.col("w_.r") - F.col("below_")).cast("int")).alias("x")))
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    return every.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("at_"))


def narrow(rows: DataFrame, keys: list[str], cells: DataFrame, sketches: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: (the cells that hold a rank still, the values inside of them, the ranks settled as keys, i and x).

    A cell is what is between two pivots: n_ values, below_ how many of the group are less, and the ranks in it.
    """
    by = [*keys, "c_"]
    if sketches is None:
        sketches = rows.groupBy(*by).agg(F.kll_sketch_agg_double("v_", SKETCH).alias("s_"))
    else:
        sketches = sketches.withColumn("c_", F.lit(0))
    grid = F.expr(f"array({', '.join(f'{j / GRID}D' for j in range(GRID + 1))})")
    asked = sketches.select(*by, F.kll_sketch_get_quantile_double("s_", grid).alias("g_"))

    def pivots(w: Column) -> Column:
        at = F.floor((w["r"] - F.col("below_") + 0.5) / F.col("n_") * GRID)
        return F.array(*[F.get("g_", F.greatest(F.lit(0), F.least(F.lit(GRID), at + d)).cast("int")) for d in (-REACH, 0, 1, 1 + REACH)])

    proposed = kept(cells.join(asked, by).select(*cells.columns, F.array_sort(F.array_distinct(F.flatten(F.transform("want_", pivots)))).alias("pivots_")))
    # Even: between two pivots; odd: at one.
    place = (2 * F.size(F.filter("pivots_", lambda p: p < F.col("v_"))) + F.array_contains("pivots_", F.col("v_")).cast("int")).alias("e_")
    counted = rows.join(proposed.select(*by, "pivots_"), by).select(*by, place).groupBy(*by, "e_").agg(F.count("*").alias("m_"))
    before = F.coalesce(F.sum("m_").over(Window.partitionBy(*by).orderBy("e_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counted.withColumn("before_", before).join(proposed, by).withColumn("start_", F.col("below_") + F.col("before_"))
    parts = parts.withColumn("mine_", F.filter("want_", lambda w: (w["r"] >= F.col("start_")) & (w["r"] < F.col("start_") + F.col("m_")))).where(F.size("mine_") > 0)
    new = F.row_number().over(Window.partitionBy(*keys).orderBy("c_", "e_"))
    parts = kept(parts.select(*by, "e_", "m_", "start_", "mine_", F.get("pivots_", F.floor((F.col("e_") - 1) / 2).cast("int")).alias("x_"), new.alias("new_")))
    settled = parts.where("e_ % 2 = 1").select(*keys, F.explode("mine_").alias("w_"), F.col("x_").alias("x")).select(*keys, F.col("w_.i").alias("i"), "x")
    open_ = parts.where("e_ % 2 = 0")
    after = open_.select(*keys, F.col("new_").alias("c_"), F.col("m_").alias("n_"), F.col("start_").alias("below_"), F.col("mine_").alias("want_"))
    names = open_.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("e_", "new_"))).alias("names_"))
    inside = rows.join(proposed.select(*by, "pivots_").join(names, by), by).select(*keys, F.try_element_at("names_", place).alias("c_"), "v_").where(F.col("c_").isNotNull())
    return after, inside, settled
