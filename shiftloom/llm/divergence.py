"""Source divergence audit: run-length columns of term counts, compared source by source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .terms import LETTERS, split_terms
from .words import numbered, slices

#: Documents of a language that hold a kept term, scale of shares, terms told of a source.
LEAST, SCALE, TOP = 10, 10**9, 10
#: Counts (a source with a term) of one block of a language's vocabulary.
BLOCK = 500_000


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> occurrences and documents of each term by lang and source, for each slice of a batch."""
    for batch in batches:
        for part in slices(batch, 2):
            if not len(part):
                continue
            words, lengths = split_terms(part.column(2), LETTERS)
            terms, number = numbered(words)
            pairs = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["l", "s"])
            groups: dict[tuple, int] = {}
            group = np.array([groups.setdefault((p["l"], p["s"]), len(groups)) for p in pairs.to_pylist()])
            wide = max(1, len(terms))
            in_doc, times = np.unique(np.repeat(np.arange(len(part)), lengths) * wide + number, return_counts=True)
            key, at = np.unique(group[in_doc // wide] * wide + in_doc % wide, return_inverse=True)
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            own = pa.array(key // wide)
            yield pa.RecordBatch.from_arrays(
                [langs.take(own), sources.take(own), terms.cast(pa.string()).take(pa.array(key % wide)), pa.array(np.bincount(at, times, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))],
                names=["lang", "source", "term", "n", "docs"],
            )


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * n / total) for 0 <= n <= total in 64-bit steps, exact for totals below 9 * 10^15."""
    whole, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        whole, rest = whole * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return whole + 1


def shares(n: np.ndarray, total: int) -> np.ndarray:
    """:func:`share` of an array."""
    whole, rest = np.zeros_like(n), n
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // total, rest * 1000 % total
    return whole + 1


def columns_of(vectors: list[list[tuple[int, int]]], repeats: list[int], n_sources: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Run-length columns, one for each source: (where runs start, the run's count).

    ``vectors``: for each kind of term its (source, count) pairs by source; ``repeats``: how many terms are
    of that kind. In order of the pairs, equal counts of a source stand together.
    """
    order = sorted(range(len(vectors)), key=vectors.__getitem__)
    ends = np.cumsum([repeats[i] for i in order])
    source = np.array([s for i in order for s, _ in vectors[i]], np.int64)
    count = np.array([n for i in order for _, n in vectors[i]], np.int64)
    place = np.repeat(np.arange(len(order)), [len(vectors[i]) for i in order])
    by = np.argsort(source, kind="stable")
    cuts = np.searchsorted(source[by], np.arange(n_sources + 1))
    starts_at = np.concatenate(([0], ends))
    out = []
    for s in range(n_sources):
        here = by[cuts[s] : cuts[s + 1]]
        p, n = place[here], count[here]
        gap = np.flatnonzero(np.concatenate((p[1:] != p[:-1] + 1, [True]))) if len(p) else np.empty(0, np.int64)
        at = np.concatenate(([-1], p, p[gap] + 1))  # a column begins with a run of zeros, and one follows each gap
        values = np.concatenate(([0], n, np.zeros(len(gap), np.int64)))
        by_place = np.argsort(at, kind="stable")
        at, values = np.maximum(at[by_place], 0), values[by_place]
        last = np.concatenate((at[1:] != at[:-1], [True])) & (at < len(order))
        at, values = at[last], values[last]
        new = np.concatenate(([True], values[1:] != values[:-1]))
        out.append((starts_at[at[new]], values[new]))
    return out


def compare_columns(columns: list[tuple[np.ndarray, np.ndarray]], totals: list[int], length: int) -> tuple[list[int], list[int], list[int]]:
    """The sum of f over the block's terms for every two sources: runs are cut where either column's run
    ends, f is worked out once for a piece and counts as often as the piece is long."""
    value = [shares(n + 2, t) for (_, n), t in zip(columns, totals)]
    left, right, sums = [], [], []
    for i, (a, _) in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j][0]
            at = np.union1d(a, b)
            p, q = value[i][np.searchsorted(a, at, "right") - 1], value[j][np.searchsorted(b, at, "right") - 1]
            f = (p - q) * (p - q) // (p + q)
            left.append(i)
            right.append(j)
            sums.append(int((f * np.diff(np.append(at, length))).sum()))
    return left, right, sums


def compare_block(vectors: pa.Table, sources: pa.Table) -> pa.Table:
    """A block of a language's vocabulary with all the language's sources -> a partial sum for every two."""
    schema = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])
    if sources.num_rows < 2:
        return schema.empty_table()
    known = sorted(zip(sources["place"].to_pylist(), sources["total"].to_pylist()))
    kinds = [[(x["s"], x["n"]) for x in v] for v in vectors["vec"].to_pylist()]
    repeats = vectors["repeats"].to_pylist()
    # Without any term of the block there is one empty run.
    columns = columns_of(kinds, repeats, len(known)) if kinds else [(np.zeros(1, np.int64), np.zeros(1, np.int64))] * len(known)
    left, right, sums = compare_columns(columns, [max(1, t) for _, t in known], sum(repeats))
    return pa.table([[sources["lang"][0].as_py()] * len(left), left, right, sums], schema=schema)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far apart the sources of each language are.

    ``pair``: every other source of the language with the sum of f over its kept terms; ``term``: the up to
    ``top`` terms in which the source is furthest above its language. A null text, lang or source is ''.
    A group without terms, or a language that keeps none, is compared all the same (then all sums are 0).
    Repeated rows count each time; equal values are ranked by item; an empty table gives no row; other
    columns are ignored. Counts are exact up to 9 * 10^15 occurrences in a language.

    Terms are counted by batch, then by Spark. Terms of equal counts in all sources of a language are one
    row with its number of terms, so no row grows with the vocabulary; these rows are dealt into blocks by
    a hash, put in order and run-length encoded by source, and only sums of two sources leave a block.
    """
    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    rows = docs.select(lang, source, text)
    schema = "lang string, source string, term string, n long, docs long"
    counted = stored(rows.mapInArrow(count_terms, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = stored(counted.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).select("lang", "term", "of_lang"))
    languages = stored(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("n_lang")))
    known = stored(counted.join(kept, ["lang", "term"]))
    totals = known.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(languages, "lang", "left")
    some = lambda c: F.coalesce(F.col(c), F.lit(0))
    # The fewest occurrences first: long runs of zeros lead the order of the vocabulary.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(some("n_source"), "source")) - 1
    groups = stored(groups.select("lang", "source", place.alias("place"), some("n_source").alias("n_source"), (some("n_source") + 2 * some("v")).alias("total"), some("v").alias("v"), (some("n_lang") + 2 * some("v")).alias("lang_total")))

    own = groups.select("lang", "source", "place")
    vectors = known.join(own, ["lang", "source"]).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("s"), F.col("n").alias("n")))).alias("vec"))
    kinds = stored(vectors.groupBy("lang", "vec").agg(F.count("*").alias("repeats")))
    blocks = kinds.groupBy("lang").agg(F.ceil(F.sum(F.size("vec")) / BLOCK).cast("int").alias("blocks"))
    dealt = kinds.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    told = groups.join(blocks, "lang", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)))
    sums = dealt.select("lang", "block", "vec", "repeats").groupBy("lang", "block").cogroup(told.select("lang", "block", "place", "total").groupBy("lang", "block")).applyInArrow(
        compare_block, "lang string, a int, b int, value long"
    )
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    named = both.join(own.select("lang", F.col("place").alias("a"), "source"), ["lang", "a"]).join(own.select("lang", F.col("place").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    measured = known.where("n > 0").join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    measured = measured.select("lang", "source", F.col("term").alias("item"), share(F.col("n") + 2, F.col("total")).alias("p"), share(F.col("of_lang") + 2, F.col("lang_total")).alias("q")).where("p > q")
    f = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    ranked = measured.withColumn("value", f).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def divergence_query(documents: DataFrame) -> DataFrame:
    """``op11_divergence``."""
    return divergence(documents)


#: The same in SQL.
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
occ AS (SELECT k, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS of_lang FROM occ GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(of_lang) AS n_lang FROM kept GROUP BY lang),
counted AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM occ SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (
  SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang, coalesce((SELECT sum(n) FROM counted c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * g.v) AS p, 1 + (1000000000 * (k.of_lang + 2)) // (g.n_lang + 2 * g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
above AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM above))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
