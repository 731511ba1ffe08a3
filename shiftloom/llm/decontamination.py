"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask keeps some positions of a run of tokens and ignores the others. Under each mask every run of
a document and of a benchmark item gets a hash; documents and items meet on equal hashes, and the
alignment around each meeting is verified, substitutions allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

#: Positions that a mask keeps. Any 8 to 15 aligned tokens of which 80 % are equal hold a run that one
#: of these masks sees as equal (tests/llm/test_text_operators.py tries all cases).
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 7), (0, 1, 3, 6, 7))
WINDOW = 15
SIMILARITY = 0.8
#: Rows that a broadcast side may have, and tokens in them; beyond, the same join runs shuffled.
BROADCAST_ROWS, BROADCAST_TOKENS = 400_000, 2_000_000
#: Longs of the bit filter that spares most seeds of documents the shuffle then: 8 MB.
FILTER_WORDS = 1 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits (null text: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+"), "")


def seeds(rows: DataFrame, words: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """The other columns of ``rows`` with seed and at (token), a row per position and mask. Each mask is
    hashed up to its own end; its hashes differ from those of every other mask. Written with generators
    and plain column functions, so that it runs as compiled code."""
    others = [c for c in rows.columns if c != words]
    placed = rows.where(F.size(words) > 0).select(*others, words, F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("at"))
    get = lambda o: F.get(words, F.col("at") + o)
    each = [F.when(F.col("at") + mask[-1] < F.size(words), F.xxhash64(F.lit(sum(1 << o for o in mask)), *[get(o) for o in mask])) for mask in masks]
    return placed.select(*others, "at", F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows are few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def seed_bits(item_seeds: DataFrame, words: int = FILTER_WORDS) -> Column:
    """A condition on ``seed`` that every seed of ``item_seeds`` meets and few others do: a bit for each
    seed in an array of at most ``words`` longs, which one aggregation fills and every task gets."""
    at, bit = F.pmod("seed", F.lit(words)).cast("int"), F.shiftrightunsigned("seed", 58).cast("int")
    lines = item_seeds.select(at.alias("k"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    places = item_seeds.sparkSession.range(words).join(lines, F.col("id") == F.col("k"), "left")
    in_order = F.array_sort(F.collect_list(F.struct(F.col("id").cast("int").alias("id"), F.coalesce("b", F.lit(0).cast("long")).alias("b"))))
    filled = places.agg(in_order.alias("m")).select(F.col("m.b"))
    return F.get(filled.scalar(), at).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit)) != 0


def same_text(text_hash: Column, text: Column | None = None) -> Column:
    """Whether the text has the hash, as a difference: so it is no join key, and is taken of texts of the id only."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit(""))).bitwiseXOR(text_hash) == 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, window: int = WINDOW, similarity: float = SIMILARITY, most: int = BROADCAST_ROWS) -> DataFrame:
    """Benchmark passages in documents: one row per document (doc_id, text) and item.

    Leak: on one alignment of the two token sequences some ``window`` consecutive tokens (the whole
    item, if it is shorter) of which at least the share ``similarity`` is equal, so replaced words
    are tolerated; items of fewer tokens than the longest mask spans are leaks only if all their tokens
    stand in the document as they are, and items without tokens match nothing.
    Seeds of up to ``most`` rows of items are broadcast; more are met in a shuffle, behind a bit filter.
    Returns doc_id, text_hash, item_id, doc_start (token where the item's first token would stand),
    n_item, n_matched (equal tokens on that alignment), best_window.

    Null or empty texts match nothing; null ids are ids like others; rows that repeat doc_id and text
    give one row per item; empty tables give no row; further columns are ignored.
    """
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    span = max(m[-1] for m in masks) + 1
    items = stored(benchmark.select("item_id", tokens(F.col("text")).alias("item")).where(F.size("item") > 0).distinct())
    short = sorted(r[0] for r in items.select(F.size("item")).where(F.size("item") < span).distinct().collect())  # span - 1 numbers at most
    item_seeds = seeds(items.where(F.size("item") >= span), "item", masks)
    for n in short:
        item_seeds = item_seeds.unionByName(seeds(items.where(F.size("item") == n), "item", (tuple(range(n)),)))
    item_seeds = stored(item_seeds.withColumnRenamed("at", "item_at"))
    words = docs.select(F.col("doc_id"), text_hash.alias("text_hash"), tokens(F.col("text")).alias("words"))
    doc_seeds = seeds(words, "words", (*masks, *[tuple(range(n)) for n in short]))
    few = item_seeds.limit(most + 1).count() <= most
    met = doc_seeds.join(F.broadcast(item_seeds), "seed") if few else doc_seeds.where(seed_bits(item_seeds)).join(item_seeds, "seed")
    hits = met.select("doc_id", "text_hash", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    found = stored(hits.distinct())

    size = items.agg(F.sum(F.size("item"))).first()[0] or 0
    texts = items.select(F.col("item_id").alias("i"), "item")
    around = (
        docs.select(F.col("doc_id").alias("d"), "text")
        .join(bounded(found), F.col("d").eqNullSafe(F.col("doc_id")) & same_text(F.col("text_hash")))
        .join(F.broadcast(texts) if size <= BROADCAST_TOKENS else texts, F.col("item_id").eqNullSafe(F.col("i")))
        .select("doc_id", "text_hash", "item_id", "shift", "item", tokens(F.col("text")).alias("words"))
    )
    skip = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("item") - skip, F.size("words") - skip - F.col("shift"))
    equal = F.zip_with(F.slice("words", F.col("shift") + skip + 1, length), F.slice("item", skip + 1, length), lambda a, b: (a == b).cast("int"))
    # Stored, or the filter below would be moved to the join, with the tokens taken again for each window.
    marked = stored(around.select("doc_id", "text_hash", "item_id", "shift", F.size("item").alias("n_item"), equal.alias("equal")))
    wide = F.least(F.lit(window), F.col("n_item"))
    add = lambda a, x: a + x
    in_windows = F.transform(F.sequence(F.lit(1), F.size("equal") - wide + 1), lambda i: F.aggregate(F.slice("equal", i, wide), F.lit(0), add))
    scored = marked.select(
        "doc_id", "text_hash", "item_id", "shift", "n_item", F.aggregate("equal", F.lit(0), add).alias("n_matched"),
        F.when(F.size("equal") >= wide, F.array_max(in_windows)).otherwise(0).alias("best_window"), wide.alias("wide"),
    )
    need = F.when(F.col("n_item") < span, F.col("n_item")).otherwise(F.ceil(F.col("wide") * F.lit(similarity) - 1e-9))
    leaks = scored.where(F.col("best_window") >= need)
    best = leaks.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("n_matched", "best_window", (-F.col("shift")).alias("back"), "n_item")).alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("doc_start"), "best.n_item", "best.n_matched", "best.best_window")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **rules) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage (see :func:`find_leaks`)."""
    key, d = fresh(docs, "key_", "d_")
    leaks = stored(find_leaks(docs, benchmark, **rules).select(F.col("doc_id").alias(d), F.col("text_hash").alias(key)).distinct())
    same = docs["doc_id"].eqNullSafe(leaks[d]) & same_text(leaks[key], docs["text"])
    return docs.join(bounded(leaks), same, "left_anti")


def decontamination_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``op1_decontamination``: every leak of whole documents."""
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "doc_start", "n_item", "n_matched", "best_window")


def _words_sql(text: str) -> str:
    return rf"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{M}}\p{{N}}]+'), lambda x: x <> '')"


_SPAN = max(m[-1] for m in MASKS) + 1

#: The same leaks from all pairs of equal tokens, without seeds.
LEAKS_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_words_sql('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
), items AS (
  SELECT row_number() OVER () AS q, item_id, w FROM (SELECT DISTINCT item_id, {_words_sql('text')} AS w FROM benchmark) WHERE len(w) > 0
), dw AS (SELECT r, unnest(w) AS t, unnest(range(0, len(w))) AS i FROM docs),
iw AS (SELECT q, unnest(w) AS t, unnest(range(0, len(w))) AS j FROM items),
near AS (
  SELECT r, q, i - j AS shift, list(j) AS js, count(*) AS n_matched FROM dw JOIN iw USING (t) GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT r, q, i - j, list(j), count(*) FROM dw JOIN iw USING (t) WHERE q IN (SELECT q FROM items WHERE len(w) = 1) GROUP BY ALL
), sized AS (
  SELECT near.*, doc_id, item_id, len(items.w) AS n_item, least({WINDOW}, len(items.w)) AS wide, greatest(0, -shift) AS lo, least(len(items.w), len(docs.w) - shift) AS hi,
    CASE WHEN len(items.w) < {_SPAN} THEN len(items.w) ELSE ceil(least({WINDOW}, len(items.w)) * {SIMILARITY}::DOUBLE - 1e-9) END AS need
  FROM near JOIN docs USING (r) JOIN items USING (q)
), windows AS (
  SELECT *, unnest(range(lo, hi - wide + 1)) AS s FROM sized WHERE n_matched >= need
), counted AS (
  SELECT r, doc_id, item_id, shift, n_item, n_matched, need, max(len(list_filter(js, lambda x: x >= s AND x < s + wide))) AS best_window FROM windows GROUP BY ALL
), best AS (
  SELECT r, doc_id, item_id, max(struct_pack(m := n_matched, b := best_window, back := -shift, n := n_item)) AS x FROM counted WHERE best_window >= need GROUP BY r, doc_id, item_id
)
SELECT doc_id, item_id, CAST(-x.back AS INTEGER) AS doc_start, CAST(x.n AS INTEGER) AS n_item, CAST(x.m AS INTEGER) AS n_matched, CAST(x.b AS INTEGER) AS best_window FROM best
"""
