"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, stored, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 20240502
#: Largest inclusion share in the sample: documents at it come first, but in an order of their own.
MOST = 1 - 2.0**-20
#: Largest logarithm of the odds that has a bucket of its own.
REACH = 52.0


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds target and weight.

    Sources in code point order, null last, weigh ``weights`` repeating. All targets add up to all
    sizes; a target stops at ``cap`` times its source's size and the excess is shared again by
    weight until none is above. That fixed point is the water level: sorted by cap over weight, a
    source is capped if the level of those from it on would lift it above its cap.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    sized = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights))).cast("int") + 1))
    sized = sized.withColumn("roof", F.col("source_size") * F.lit(cap))
    by_ratio = Window.orderBy(F.col("roof") / F.col("weight"), F.col("source").asc_nulls_last())
    from_here = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("roof").over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    lifted = sized.withColumn("level", level).withColumn("capped", F.col("level") * F.col("weight") >= F.col("roof"))
    # Of the uncapped, the first in order has the true level; later rows took too many for capped.
    final = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return lifted.withColumn("target", F.when(F.col("capped"), F.col("roof")).otherwise(final * F.col("weight"))).select("source", "source_size", "weight", "target")


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 from a 64-bit hash."""
    return (F.shiftrightunsigned(key, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def pareto_place(u: Column, share: Column) -> Column:
    """Rank key in (0, 1), increasing in the odds of ``u`` over the odds of the inclusion share."""
    odds = (u / (1 - u)) * ((1 - share) / share)
    return F.when(share > 0, odds / (1 + odds))


def bucket_of(place: Column, buckets: int) -> Column:
    """Bucket of a rank key, in the key's order: by the logarithm of its odds, over which keys spread alike
    whatever the inclusion shares (a logistic law of scale 1), so the fullest holds about a quarter of a bucket's width."""
    odds = F.ln(place / F.nullif(1 - place, F.lit(0.0)))
    at = F.floor((F.coalesce(odds, F.lit(REACH)) + REACH) * (buckets / (2 * REACH)))
    return F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("int")


def draw(seed: int) -> Column:
    """A number strictly between 0 and 1 from a digest of doc_id and text."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) * F.lit(2.0**-52)


def size_weight(size: Column) -> Column:
    """Binary digits of a size: what inclusion shares within a source go by."""
    return F.length(F.bin(size))


def inclusion_rates(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with the rate of each source: a document's inclusion share is rate times size weight, MOST at most.

    The shares come to the words that the source still wants. As some documents are certain, that is the
    water level again, over the size weights of a source, some forty at most.
    """
    sums = slim.where("size > 0").groupBy("source", size_weight(F.col("size")).alias("w")).agg(F.sum("size").alias("n"))
    own = sums.join(plan.select(F.col("source").alias("z"), "sampled"), F.col("source").eqNullSafe(F.col("z")))
    order = Window.partitionBy("z").orderBy(F.desc("w"))
    before, from_here = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.sum(F.col("w") * F.col("n")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levelled = own.withColumn("level", (F.col("sampled") - F.coalesce(before, F.lit(0))) / from_here)
    # The first weight that the level doesn't lift to 1 has the true one; later ones took too many for certain.
    rates = levelled.groupBy("z").agg(F.max(F.when(F.col("level") * F.col("w") < 1, F.col("level"))).alias("rate"))
    return plan.join(rates.withColumnRenamed("z", "y"), F.col("source").eqNullSafe(F.col("y")), "left").drop("y")


def share_of(size: Column, rate: Column) -> Column:
    return F.least(F.coalesce(rate, F.lit(0.0)) * size_weight(size), F.lit(MOST))


def mix_cuts(slim: DataFrame, plan: DataFrame, buckets: int, rounds: int) -> DataFrame:
    """Per source: how far down the Pareto order each round of the sample reaches.

    A round takes the longest run of the order that fits what is still missing; the next round
    fills the gap with the next documents that are no longer than the gap. Each round sums sizes
    over buckets of the rank key first, so only one bucket of a source, some thousandths of it, is ever
    sorted. The result has a row per source.
    """
    state = plan.withColumn("cuts", F.array().cast("array<struct<gap:double,reach:double>>")).withColumn("gap", F.col("sampled"))
    for k in range(rounds):
        state = stored(state)
        # Longer documents that an earlier round passed over never fit a smaller gap.
        last = F.element_at(F.col("cuts"), -1)["reach"] if k else F.lit(-1.0)
        own = state.select(F.col("source").alias("s"), "gap", last.alias("from"))
        fit = (
            slim.join(own, F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("size") <= F.col("gap")) & (F.col("place") > F.col("from")))
            .select("s", "place", "size", bucket_of(F.col("place"), buckets).alias("bucket"))
        )
        sums = fit.groupBy("s", "bucket").agg(F.sum("size").alias("n"), F.max("place").alias("top"))
        upto = F.sum("n").over(Window.partitionBy("s").orderBy("bucket"))
        edge = (
            sums.withColumn("upto", upto)
            .join(own.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")))
            .groupBy("s")
            .agg(
                F.min(F.when(F.col("upto") > F.col("gap"), F.col("bucket"))).alias("edge"),
                F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("full"),
                F.max(F.when(F.col("upto") <= F.col("gap"), F.col("top"))).alias("top"),
            )
        )
        edge = edge.select(F.col("s").alias("t"), "edge", F.coalesce("full", F.lit(0)).alias("full"), "top")
        inside = (
            fit.join(edge.drop("top"), F.col("s").eqNullSafe(F.col("t")) & (F.col("bucket") == F.col("edge")))
            .groupBy("s", "place", "full").agg(F.sum("size").alias("size"))  # repeated rows share a place
            .withColumn("upto", F.col("full") + F.sum("size").over(Window.partitionBy("s").orderBy("place")))
            .join(own.select(F.col("s").alias("o"), "gap"), F.col("s").eqNullSafe(F.col("o")))
            .groupBy("s")
            .agg(F.max(F.when(F.col("upto") <= F.col("gap"), F.struct("place", "upto"))).alias("stop"))
        )
        inside = inside.select(F.col("s").alias("i"), "stop")
        reach = edge.join(inside, F.col("t").eqNullSafe(F.col("i")), "left").select(
            "t",
            F.when(F.col("edge").isNull(), F.lit(1.0)).otherwise(F.coalesce(F.col("stop.place"), F.col("top"))).alias("reach"),
            F.coalesce(F.col("stop.upto"), F.col("full")).cast("double").alias("filled"),
        )
        state = state.join(reach, F.col("source").eqNullSafe(F.col("t")), "left")
        cut = F.struct(F.col("gap"), F.coalesce(F.col("reach"), last).alias("reach"))
        state = state.withColumn("cuts", F.concat("cuts", F.array(cut))).withColumn("gap", F.col("gap") - F.coalesce("filled", F.lit(0.0))).drop("t", "reach", "filled")
    return stored(state.drop("gap"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, buckets: int = 16384, rounds: int = 3) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted).

    A source whose target is r times its size gives every document floor(r) times for certain; for the
    words left a sample of fixed size is drawn in Pareto order: documents ranked by random odds over the
    odds of their inclusion share, taken until the source's words are met. Inclusion shares within a source
    are unequal: they go by the binary digits of the document's size.
    The random number is a digest of doc_id and text, so reruns agree. Rows that repeat in both share
    a rank and are taken or left together.

    Null text: size 0; null source: a source of its own, last; an empty table: an empty result.
    Columns named like the four added ones are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "taken")
    u, s, whole, rate, reach = fresh(docs, "u_", "s_", "whole_", "rate_", "cuts_")
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn(u, draw(seed))
    slim = stored(sized.select("source", "size", F.col(u).alias("u")))
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = source_targets(per_source, weights, cap).withColumn("whole", F.floor(copies))
    plan = stored(inclusion_rates(slim, plan.withColumn("sampled", F.col("target") - F.col("whole") * F.col("source_size"))))
    placed = slim.join(plan.select(F.col("source").alias("z"), "rate"), F.col("source").eqNullSafe(F.col("z"))).withColumn("place", pareto_place(F.col("u"), share_of(F.col("size"), F.col("rate")))).where("place IS NOT NULL AND size > 0").select("source", "size", "place")
    cuts = mix_cuts(placed, plan, buckets, rounds)
    own = cuts.select(F.col("source").alias(s), "source_size", "target", F.col("whole").alias(whole), F.col("rate").alias(rate), F.col("cuts").alias(reach))
    # In a round: within its reach, short enough for its gap, and not within an earlier round's reach.
    place = pareto_place(F.col(u), share_of(F.col("size"), F.col(rate)))
    hit = F.aggregate(
        F.col(reach), F.struct(F.lit(False).alias("got"), F.lit(-1.0).alias("from")),
        lambda a, c: F.struct((a["got"] | ((place > a["from"]) & (place <= c["reach"]) & (F.col("size") <= c["gap"]))).alias("got"), c["reach"].alias("from")),
    )["got"]
    out = sized.join(own, F.col("source").eqNullSafe(F.col(s))).withColumn("taken", F.col("size") * (F.col(whole) + F.coalesce(hit, F.lit(False)).cast("long")))
    return out.select(*docs.columns, "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, **rules) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as it is taken, its columns only."""
    slim = mix_documents(docs, **rules) if not {"size", "taken", "target", "source_size"} & set(docs.columns) else None
    if slim is None:
        renamed = {c: n for c, n in zip(docs.columns, fresh(docs, *[f"kept_{c}" for c in docs.columns])) if c in ("size", "taken", "target", "source_size")}
        back = {n: c for c, n in renamed.items()}
        return take_mix(docs.withColumnsRenamed(renamed), **rules).withColumnsRenamed(back)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    (copy,) = fresh(slim, "copy_")
    return slim.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def mixing_query(docs: DataFrame) -> DataFrame:
    """``op3_mixing``."""
    return mix_documents(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix, by sorting each source whole.
MIXING_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) * power(2.0::DOUBLE, -52) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size) AS DOUBLE) * {CAP}::DOUBLE AS roof FROM d GROUP BY source
), weighed AS (
  SELECT *, list_extract([{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS BIGINT)) AS weight FROM s
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(roof) OVER (ORDER BY roof / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY roof / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, CASE WHEN level * weight >= roof THEN roof ELSE max(CASE WHEN level * weight < roof THEN level END) OVER () * weight END AS target FROM levels
), plan AS (
  SELECT source AS z, source_size, target, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS whole FROM targets
), classes AS (
  SELECT source, length(bin(size)) AS w, sum(size) AS n FROM d WHERE size > 0 GROUP BY ALL
), rates AS (
  SELECT source AS y, max(CASE WHEN level * w < 1 THEN level END) AS rate FROM (
    SELECT source, w, (target - whole * source_size - coalesce(sum(n) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w * n) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM classes JOIN plan ON source IS NOT DISTINCT FROM z) GROUP BY source
), shares AS (
  SELECT *, least(coalesce(rate, 0) * length(bin(size)), {MOST!r}::DOUBLE) AS share
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM z LEFT JOIN rates ON d.source IS NOT DISTINCT FROM y
), met0 AS (
  SELECT *, CASE WHEN share > 0 AND size > 0 THEN (u / (1 - u)) * ((1 - share) / share) / (1 + (u / (1 - u)) * ((1 - share) / share)) END AS place,
    target - whole * source_size AS gap0, -1.0::DOUBLE AS reach0
  FROM shares
),
fit1 AS (
  SELECT *, CASE WHEN place > reach0 AND size <= gap0 THEN sum(CASE WHEN place > reach0 AND size <= gap0 THEN size END) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum1
  FROM met0), met1 AS (
  SELECT *, coalesce(cum1 <= gap0, FALSE) AS got1, gap0 - coalesce(max(CASE WHEN cum1 <= gap0 THEN cum1 END) OVER (PARTITION BY source), 0) AS gap1,
    coalesce(max(CASE WHEN cum1 <= gap0 THEN place END) OVER (PARTITION BY source), reach0) AS reach1
  FROM fit1),
fit2 AS (
  SELECT *, CASE WHEN place > reach1 AND size <= gap1 THEN sum(CASE WHEN place > reach1 AND size <= gap1 THEN size END) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum2
  FROM met1), met2 AS (
  SELECT *, coalesce(cum2 <= gap1, FALSE) AS got2, gap1 - coalesce(max(CASE WHEN cum2 <= gap1 THEN cum2 END) OVER (PARTITION BY source), 0) AS gap2,
    coalesce(max(CASE WHEN cum2 <= gap1 THEN place END) OVER (PARTITION BY source), reach1) AS reach2
  FROM fit2),
fit3 AS (
  SELECT *, CASE WHEN place > reach2 AND size <= gap2 THEN sum(CASE WHEN place > reach2 AND size <= gap2 THEN size END) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS cum3
  FROM met2), met3 AS (
  SELECT *, coalesce(cum3 <= gap2, FALSE) AS got3, gap2 - coalesce(max(CASE WHEN cum3 <= gap2 THEN cum3 END) OVER (PARTITION BY source), 0) AS gap3,
    coalesce(max(CASE WHEN cum3 <= gap2 THEN place END) OVER (PARTITION BY source), reach2) AS reach3
  FROM fit3)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN got1 OR got2 OR got3 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM met3
"""
