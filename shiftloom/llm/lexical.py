"""Ranked lexical search: a block index of each shard, searched by Block-Max MaxScore, shard heaps merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .terms import LETTERS_AND_DIGITS, split_terms
from .words import slices

#: Bytes of text and documents of a shard at most (a longer text is a shard with its slice), postings of a block,
#: documents that are scored at once.
SHARD_BYTES, SHARD_DOCS, BLOCK, STRIP = 32_000_000, 1 << 16, 128, 4096
#: Bytes of items searched for in one pass over the documents.
ITEM_BYTES = 4_000_000

INDEX = "doc_ids binary, lengths binary, words long, filled long, lists binary, bounds binary, firsts binary, lasts binary, most binary, least binary, places binary, data binary, df array<struct<term: int, df: long>>"


def widths(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes, 1, 2 or 4, that hold every value of each block."""
    most = np.maximum.reduceat(x, starts)
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def build_shard(doc_ids: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> list:
    """One row of INDEX. Postings stand by term and document in blocks of up to BLOCK; a block is stored as
    steps between documents and as frequencies, in as few bytes each as hold the block's largest. Its header
    keeps the first and last document, the highest frequency and the shortest length, which bound its scores."""
    order = np.lexsort((doc, term))
    term, doc, tf = term[order], doc[order], tf[order]
    terms, first = np.unique(term, return_index=True)
    df = np.diff(np.append(first, len(term)))
    blocks = -(-df // BLOCK)
    bounds = np.concatenate(([0], np.cumsum(blocks)))
    within = np.arange(bounds[-1]) - np.repeat(bounds[:-1], blocks)
    starts = np.repeat(first, blocks) + within * BLOCK
    ends = np.append(starts[1:], len(term))
    if len(starts):
        steps = np.diff(doc, prepend=0)
        steps[starts] = 0
        wide = np.stack([widths(steps, starts), widths(tf, starts)], 1)
        most, least = np.maximum.reduceat(tf, starts), np.minimum.reduceat(lengths[doc], starts)
    else:
        steps, wide, most, least = doc, np.zeros((0, 2), int), tf, doc
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
    data, places, at = [], [], 0
    for a, b, (w, v) in zip(starts.tolist(), ends.tolist(), wide.tolist()):
        data += [steps[a:b].astype(kinds[w]).tobytes(), tf[a:b].astype(kinds[v]).tobytes()]
        places.append((at, b - a, w, v))
        at += (b - a) * (w + v)
    own = lambda x, kind=np.int64: np.asarray(x, kind).tobytes()
    return [
        own(doc_ids), own(lengths), int(lengths.sum()), int((lengths > 0).sum()), own(terms), own(bounds), own(doc[starts]), own(doc[ends - 1] if len(ends) else ends), own(most), own(least),
        own(places), b"".join(data), [{"term": int(t), "df": int(n)} for t, n in zip(terms, df)],
    ]


def index_shards(batches: Iterator[pa.RecordBatch], terms: pa.Array) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> shards; postings are kept for ``terms`` only, lengths count all terms."""
    kinds = [pa.int64() if k == "long" else pa.binary() for k in (c.split(" ")[1] for c in INDEX.split(", df ")[0].split(", "))]
    schema = pa.schema([*zip([c.split(" ")[0] for c in INDEX.split(", df ")[0].split(", ")], kinds), ("df", pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())])))])
    held: list[tuple] = []
    bytes_, docs = 0, 0

    def shard() -> pa.RecordBatch:
        ids, lengths, keys, times = (np.concatenate(x) for x in zip(*held))
        # Documents by id, so that of equal scores the first one met is the one to keep.
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        row = build_shard(ids[order], lengths[order], keys % len(terms), place[keys // len(terms)], times)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

    for batch in batches:
        for part in slices(batch, 1):
            size = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and (bytes_ + size > SHARD_BYTES or docs + len(part) > SHARD_DOCS):
                yield shard()
                held, bytes_, docs = [], 0, 0
            words, lengths = split_terms(part.column(1), LETTERS_AND_DIGITS)
            number = pc.index_in(words, value_set=terms)
            asked = np.flatnonzero(pc.is_valid(number).to_numpy(zero_copy_only=False))
            in_doc = np.repeat(np.arange(len(part)), lengths)[asked]
            key, times = np.unique((in_doc + docs) * len(terms) + number.fill_null(0).to_numpy(zero_copy_only=False)[asked], return_counts=True)
            held.append((part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths, key, times))
            bytes_, docs = bytes_ + size, docs + len(part)
    if held:
        yield shard()


@dataclass
class Shard:
    """A shard's index in memory; blocks are decompressed when first asked for and stay for the other items."""

    n_docs: int
    total_words: int
    columns: dict[str, np.ndarray]
    data: bytes
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def read(cls, row: dict, n_docs: int, total_words: int) -> Shard:
        names = ("doc_ids", "lengths", "lists", "bounds", "firsts", "lasts", "most", "least")
        columns = {c: np.frombuffer(row[c], np.int64) for c in names}
        columns["places"] = np.frombuffer(row["places"], np.int64).reshape(-1, 4)
        columns["most_impact"] = impact(columns["most"], columns["least"], n_docs, total_words)
        return cls(n_docs, total_words, columns, row["data"])

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block's postings."""
        if block not in self.opened:
            at, n, w, v = self.columns["places"][block].tolist()
            kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}
            docs = self.columns["firsts"][block] + np.cumsum(np.frombuffer(self.data, kinds[w], n, at).astype(np.int64))
            tf = np.frombuffer(self.data, kinds[v], n, at + n * w).astype(np.int64)
            self.opened[block] = docs, impact(tf, self.columns["lengths"][docs], self.n_docs, self.total_words)
        return self.opened[block]


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, total_words: int) -> np.ndarray:
    """A posting's score without its term's weight; it grows with ``tf`` and falls with ``length``."""
    m = 10 + 90 * length * n_docs // max(1, total_words)
    return 10**9 * tf // (1000 * tf + 8 * m)


def search(shard: Shard, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best of a shard for terms with their weights, best first.

    A list's bound is its weight times the best of its blocks' bounds. With the lists by falling bound,
    those at the end that together can't reach the k-th score so far aren't essential: only documents of
    the others are candidates. Documents are taken in strips, in order. Candidates then pass the
    other lists, largest bound first; one stays only if its score so far, the bound of its block in
    this list and the bounds of the lists to come can reach the k-th score. Blocks without such a
    candidate are never decompressed.
    """
    c = shard.columns
    lists = []
    for term, weight in asked:
        i = int(np.searchsorted(c["lists"], term))
        if weight > 0 and i < len(c["lists"]) and c["lists"][i] == term:
            a, b = int(c["bounds"][i]), int(c["bounds"][i + 1])
            block_bounds = weight * c["most_impact"][a:b]
            lists.append((int(block_bounds.max()), weight, a, c["firsts"][a:b], c["lasts"][a:b], block_bounds))
    lists.sort(key=lambda x: (-x[0], x[2]))
    to_come = np.append(np.cumsum([x[0] for x in lists][::-1])[::-1], 0)
    best_docs, best = np.empty(0, np.int64), np.empty(0, np.int64)
    for low in range(0, len(c["doc_ids"]), STRIP):
        high = low + STRIP
        worst = int(best[-1]) if len(best) == k else 0
        essential = next((i for i in range(len(lists)) if to_come[i] <= worst), len(lists))
        if not essential:
            break
        score = np.zeros(min(STRIP, len(c["doc_ids"]) - low), np.int64)
        for _, weight, a, firsts, lasts, _ in lists[:essential]:
            for block in range(a + int(np.searchsorted(lasts, low)), a + int(np.searchsorted(firsts, high))):
                docs, impacts = shard.open(block)
                x, y = np.searchsorted(docs, (low, high)) if firsts[block - a] < low or lasts[block - a] >= high else (0, len(docs))
                score[docs[x:y] - low] += weight * impacts[x:y]
        who = np.flatnonzero(score)
        own = score[who]
        for i in range(essential, len(lists)):
            _, weight, a, firsts, lasts, block_bounds = lists[i]
            at = np.searchsorted(lasts, who + low)
            inside = at < len(lasts)
            inside[inside] = firsts[at[inside]] <= who[inside] + low
            here = np.where(inside, block_bounds[np.minimum(at, len(lasts) - 1)], 0)
            # Of equal scores the earlier document wins, so a later one has to be better.
            stays = own + here + to_come[i + 1] > worst
            who, own, at, inside = who[stays], own[stays], at[stays], inside[stays]
            for block in np.unique(at[inside]).tolist():
                docs, impacts = shard.open(a + block)
                mine = np.flatnonzero(inside & (at == block))
                p = np.minimum(np.searchsorted(docs, who[mine] + low), len(docs) - 1)
                own[mine] += np.where(docs[p] == who[mine] + low, weight * impacts[p], 0)
        stays = own > worst
        best_docs, best = np.concatenate((best_docs, who[stays] + low)), np.concatenate((best, own[stays]))
        order = np.lexsort((best_docs, -best))[:k]
        best_docs, best = best_docs[order], best[order]
    return best_docs, best


def search_shards(batches: Iterator[pa.RecordBatch], items: list[list[int]], weights: dict[int, int], n_docs: int, total_words: int, k: int) -> Iterator[pa.RecordBatch]:
    """The heap of every item over each shard."""
    for batch in batches:
        for i in range(len(batch)):
            shard = Shard.read({name: batch.column(name)[i].as_py() for name in batch.schema.names}, n_docs, total_words)
            item, ids, scores = [], [], []
            for at, terms in enumerate(items):
                docs, best = search(shard, [(t, weights.get(t, 0)) for t in terms], k)
                item.append(np.full(len(docs), at))
                ids.append(shard.columns["doc_ids"][docs])
                scores.append(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)) for x in (item, ids, scores)], names=["item", "doc_id", "score"])


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0.

    Every row of ``docs`` is a document, also one that repeats an id or a text; equal scores go by
    ascending doc_id. Rows without doc_id count in the statistics and can't be found. Null and empty texts
    have no term; an item without a term of the documents, an empty table or no item give no row. An item is
    a row of ``items``: rows that repeat an item_id are ranked each, a null item_id is returned as it is.
    Other columns are ignored.

    A task turns its documents into shards of bounded size, each one row of the stored index, with postings
    for the items' terms. Their statistics are added up, then each shard is searched for every item and
    ``k`` rows an item leave it. Items are read in blocks of ITEM_BYTES, each with its own pass.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = stored(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id()))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, -(-(size or 0) // ITEM_BYTES))
    found = [spark.createDataFrame([], "row long, doc_id long, score long")]
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about ITEM_BYTES
        words, lengths = split_terms(pa.array([r["text"] for r in own], pa.string()), LETTERS_AND_DIGITS)
        terms = pc.unique(words)
        if not len(terms):
            continue
        number = pc.index_in(words, value_set=terms).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        of_item = [np.unique(number[e - n : e]).tolist() for e, n in zip(ends.tolist(), lengths.tolist())]
        # Ids may be null: such rows get an id above all others in their shard's order and are left out at the end.
        no_id = (1 << 63) - 1
        index = stored(rows.select(F.coalesce("doc_id", F.lit(no_id)).alias("doc_id"), "text").mapInArrow(lambda bs, terms=terms: index_shards(bs, terms), INDEX))
        totals = index.agg(F.sum("filled").alias("n"), F.sum("words").alias("l")).first()
        if not totals["n"]:
            continue
        n, length = totals["n"], totals["l"]
        df = index.select(F.explode("df").alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df")).collect()  # a row for each term of the block's items
        weights = {r["term"]: math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1))) for r in df}
        heaps = index.drop("df", "words", "filled").mapInArrow(
            lambda bs, of_item=of_item, weights=weights, n=n, length=length: search_shards(bs, of_item, weights, n, length, k), "item long, doc_id long, score long"
        )
        places = F.lit([r["row"] for r in own])
        found.append(heaps.where(F.col("doc_id") != no_id).select(F.element_at(places, F.col("item").cast("int") + 1).alias("row"), "doc_id", "score"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return best.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def lexical_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``op12_lexical``."""
    return ranked(documents, benchmark)


#: The same in SQL, by scoring every document that holds a term of an item.
LEXICAL_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
items AS (SELECT row_number() OVER () AS j, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms FROM benchmark),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_words FROM docs WHERE len(terms) > 0),
asked AS (SELECT j, unnest(terms) AS term FROM items),
occ AS (SELECT k, unnest(terms) AS term FROM docs),
tfs AS (SELECT k, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY k, term),
weights AS (SELECT term, CAST(floor(1000::DOUBLE * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tfs CROSS JOIN total GROUP BY term),
scores AS (
  SELECT j, k, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(d.terms) * n_docs) // n_words)))) AS BIGINT) AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN docs d USING (k) CROSS JOIN total GROUP BY j, k),
placed AS (SELECT j, doc_id, score, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id) AS rank FROM scores JOIN docs USING (k) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed JOIN items USING (j) WHERE rank <= 10
"""
