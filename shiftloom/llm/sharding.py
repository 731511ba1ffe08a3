"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every input partition is permuted locally, a matrix drawn from the multivariate hypergeometric law
says how many of its rows go to each shard, the rows are exchanged, and each shard is permuted again.
The result has the law of one uniform permutation of all rows cut into shards whose sizes differ by
one row at most.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, stored

SHARDS = 8


def draw_hypergeometric(rng: random.Random, good: int, bad: int, picks: int) -> int:
    """How many of ``picks`` rows drawn from ``good + bad`` without replacement are good.

    Inversion from the mode outwards: exact for any population size, in steps of the order of the
    standard deviation.
    """
    low, high = max(0, picks - bad), min(good, picks)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (picks + 1) * (good + 1) // (total + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, picks - mode) - choose(total, picks))
    left = rng.random() - at_mode
    if left < 0:
        return mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (picks - up) / ((up + 1) * (bad - picks + up + 1))
            up += 1
            left -= p_up
            if left < 0:
                return up
        if down > low:
            p_down *= down * (bad - picks + down) / ((good - down + 1) * (picks - down + 1))
            down -= 1
            left -= p_down
            if left < 0:
                return down
    return mode  # rounding only


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition (its number of rows given), rows for each shard; exact shard sizes."""
    total = sum(rows)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    rng = random.Random(seed)
    out = []
    for n in rows:
        line, open_room = [], sum(room)
        for s in range(shards):
            open_room -= room[s]
            k = draw_hypergeometric(rng, room[s], open_room, n)
            line.append(k)
            n -= k
        room = [a - b for a, b in zip(room, line)]
        out.append(line)
    return out


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 20240501, block_rows: int = 4096, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows of ``docs`` with ``shard`` and ``slot`` (gapless from 0 within a shard, as long).

    The rows are written once with their local permutation, so that the counts, the matrix and the
    exchange see the same partitions even if executors are lost. The driver holds one row of the
    matrix per input partition. Within a shard the second permutation is split into blocks of about
    ``block_rows`` rows, so no task gets a whole shard.

    Nulls in any column, repeated rows and empty or long texts are plain rows to it; an empty table
    gives an empty result; existing columns keep their names (a clash with ``shard`` or ``slot``
    replaces that column).
    """
    spark = docs.sparkSession
    docs = docs.drop(shard_col, slot_col)
    first, place, part, rank, mix, bounds, block, before, p = fresh(docs, "first_", "place_", "part_", "rank_", "mix_", "bounds_", "block_", "before_", "p_")
    local = (
        docs.withColumn(first, F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
        .sortWithinPartitions(first)
        .withColumn(place, F.monotonically_increasing_id())
    )
    kept = stored(local.drop(first))
    tagged = (
        kept.withColumn(part, F.shiftright(place, 33))
        .withColumn(rank, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn(mix, F.xxhash64(F.lit(seed + 1), place))
    )
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(part).count().collect())
    total = sum(n for _, n in counts)
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    lines = []
    for (k, _), line in zip(counts, matrix):
        edges, at = [], 0
        for n in line:
            at += n
            edges.append(at)
        lines.append({"p": k, "b": edges})
    # One row per input partition: a bounded table, made from a literal.
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(lines)), "array<struct<p:bigint,b:array<bigint>>>")))
    table = table.select(F.col("p").alias(p), F.col("b").alias(bounds))
    blocks = min(1 << 16, max(1, total // (shards * block_rows)))
    dealt = (
        tagged.join(F.broadcast(table), F.col(part) == F.col(p))
        .withColumn(shard_col, F.size(F.filter(bounds, lambda b: b <= F.col(rank))).cast("int"))
        .withColumn(block, F.pmod(F.col(mix), F.lit(blocks)).cast("int"))
    )
    sizes = dealt.groupBy(shard_col, block).agg(F.count("*").alias("n"))
    offsets = sizes.select(
        F.col(shard_col).alias(p), F.col(block).alias(bounds),
        (F.sum("n").over(Window.partitionBy(shard_col).orderBy(block)) - F.col("n")).alias(before),
    )  # at most shards * 65,536 rows
    again = Window.partitionBy(shard_col, block).orderBy(mix, place)
    return (
        dealt.drop(bounds, p)
        .withColumn(slot_col, F.row_number().over(again).cast("long") - 1)
        .join(F.broadcast(offsets), (F.col(shard_col) == F.col(p)) & (F.col(block) == F.col(bounds)))
        .withColumn(slot_col, F.col(slot_col) + F.col(before))
        .select(*docs.columns, shard_col, slot_col)
    )


def sharding_query(docs: DataFrame) -> DataFrame:
    """``op10_sharding``: the ``rows`` law. Null text: size 1, CRC of no bytes (0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(slim).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
