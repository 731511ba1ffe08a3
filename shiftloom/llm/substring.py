"""Removal of word windows that repeat anywhere in the corpus, with a count-min prefilter.

Equal windows share the least hash among their short runs (their minimizer), so the number of
places with that minimizer is no less than the number of places with the window. Every partition
sketches its minimizers; the merged count-min sketch overestimates their counts, hence the windows'.
A second pass groups exactly the windows whose estimate is two or more. No repeated window is lost,
and a wrong estimate only costs a window that is grouped for nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored
from .words import hash_words, mixed, numbered, runs, slices, split_words

DEPTH = 2
BLOCK_BITS = 20
#: Bytes of text in a block of documents that one task cuts; repeated windows that a task remembers to have sent.
BLOCK_BYTES, TOLD = 1 << 25, 500_000
#: Most cells of a sketch row (a power of two): the merged sketch sent to the tasks has DEPTH bits a
#: cell, 256 MB at most. Larger inputs get more windows estimated repeated; the result is the same.
MOST_CELLS = 1 << 30


def sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` neighbours."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:])
        have += step
    return x


@dataclass
class Windows:
    """Of the windows of a few texts, texts one after another: ``start`` (word number) of each, the
    minimizer of each, and the minimizers' places (one entry for each place)."""

    start: np.ndarray
    least: np.ndarray
    places: np.ndarray


def windows_of(first: np.ndarray, lengths: np.ndarray, width: int, run: int) -> Windows:
    grams = runs(first, 0, run)
    n = len(first)
    if n < width:
        return Windows(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    inside = owner[: n - width + 1] == owner[width - 1 :]
    span = width - run + 1
    least = sliding(grams, span, True)
    # A place holds a minimizer if the greatest minimizer of the windows over it is its own run.
    over = np.concatenate((np.zeros(span - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(span - 1, np.uint64)))
    places = grams[(sliding(over, span, False) == grams) & (grams > 0)]
    start = np.flatnonzero(inside)
    return Windows(start, least[start], places)


def cells_of(minimizers: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each minimizer in each row of the sketch."""
    return [(mixed(minimizers ^ np.uint64(0x5851F42D4C957F2D * (r + 1) % (1 << 64))) & np.uint64(cells - 1)).astype(np.int64) for r in range(DEPTH)]


def sketch_parts(batches: Iterator[pa.RecordBatch], cells: int, width: int, run: int) -> Iterator[pa.RecordBatch]:
    """The sketch of one partition, cell numbers and counts (2 for more), by block of the row."""
    held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]

    pending = 0
    sums: list[tuple[np.ndarray, np.ndarray] | None] = [None] * DEPTH

    def fold() -> None:
        for r in range(DEPTH):
            if not held[r]:
                continue
            cell, n = np.unique(np.concatenate(held[r]), return_counts=True)
            if sums[r] is not None:
                cell, back = np.unique(np.concatenate((sums[r][0], cell)), return_inverse=True)
                n = np.bincount(back, np.concatenate((sums[r][1], n))).astype(np.int64)
            sums[r] = (cell, np.minimum(n, 2))
            held[r] = []

    for batch in batches:
        for part in slices(batch, 0, 2_000_000):
            words, lengths = split_words(part.column(0))
            distinct, number = numbered(words)
            if len(number) < width:
                continue
            found = windows_of(hash_words(distinct)[number, 0], lengths, width, run).places
            for r, c in enumerate(cells_of(found, cells)):
                held[r].append(c)
            pending += len(found)
            if pending > 1_000_000:
                fold()
                pending = 0
    fold()
    for r, have in enumerate(sums):
        if have is None:
            continue
        cell, n = have
        cuts = np.flatnonzero(np.diff(cell >> BLOCK_BITS, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(cell)]):
            low = (cell[a:b] & ((1 << BLOCK_BITS) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([int(cell[a] >> BLOCK_BITS)], pa.int32()), pa.array([low[n[a:b] == 1].tobytes()], pa.binary()), pa.array([low[n[a:b] > 1].tobytes()], pa.binary())], names=["line", "block", "once", "more"])


def merge_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the partitions' sketches: for each block a bit per cell, set where the count is 2 or more."""
    blocks: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for line, block, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            have = blocks.setdefault((line, block), np.zeros(1 << BLOCK_BITS, np.uint8))
            have[np.frombuffer(more, "<u4")] = 2
            cell = np.frombuffer(once, "<u4")
            have[cell] = np.minimum(have[cell] + 1, 2)
    for (line, block), have in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([line], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(have > 1, bitorder="little").tobytes()], pa.binary())], names=["line", "block", "bits"])


def merged_sketch(texts: DataFrame, cells: int, width: int, run: int) -> np.ndarray:
    """(DEPTH, cells / 8) bytes; bounded by MOST_CELLS whatever the input."""
    spark = texts.sparkSession
    parts = texts.mapInArrow(lambda bs: sketch_parts(bs, cells, width, run), "line int, block int, once binary, more binary")
    blocks = DEPTH * max(1, cells >> BLOCK_BITS)
    merged = parts.repartition(max(1, min(blocks, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "line", "block").mapInArrow(merge_parts, "line int, block int, bits binary")
    bits = np.zeros((DEPTH, max(cells, 1 << BLOCK_BITS) // 8), np.uint8)
    size = (1 << BLOCK_BITS) // 8
    for row in merged.toLocalIterator():
        bits[row["line"], row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return bits


def repeated(minimizers: np.ndarray, bits: np.ndarray, cells: int) -> np.ndarray:
    """Whether the sketch estimates a count of two or more."""
    yes = np.ones(len(minimizers), bool)
    for r, cell in enumerate(cells_of(minimizers, cells)):
        yes &= (bits[r][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return yes


def candidates(texts: pa.Array, bits: np.ndarray, cells: int, width: int, run: int):
    """(words of each text, start of each window estimated repeated, its two hashes); starts count
    words from the first text on."""
    words, lengths = split_words(texts)
    distinct, number = numbered(words)
    if len(number) < width:
        none = np.empty(0, np.uint64)
        return lengths, np.empty(0, np.int64), none, none
    hashes = hash_words(distinct)
    first, second = hashes[number, 0], hashes[number, 1]
    found = windows_of(first, lengths, width, run)
    start = found.start[repeated(found.least, bits, cells)]
    return lengths, start, runs(first, 0, width)[start], runs(second, 1, width)[start] >> np.uint64(32)


def more_than_once(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the pair of hashes occurs again."""
    order = np.lexsort((h2, h1))
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    out = np.zeros(len(h1), bool)
    out[order] = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(h1) else False
    return out


def find_candidates(batches: Iterator[pa.RecordBatch], sent, cells: int, width: int, run: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """Each document with the number of its windows estimated repeated and the starts of those that
    repeat among the texts at hand; a document without any is finished, and its text isn't kept."""
    bits = sent.value
    for batch in batches:
        for part in slices(batch, 1, 2_000_000):
            lengths, start, h1, h2 = candidates(part.column(1), bits, cells, width, run)
            edges = np.concatenate(([0], np.cumsum(lengths)))
            n = np.diff(np.searchsorted(start, edges))
            sure = start[more_than_once(h1, h2)]
            cuts = np.searchsorted(sure, edges)
            place = sure - np.repeat(edges[:-1], np.diff(cuts))
            texts, some = part.column(1).to_pylist(), (n > 0).tolist()
            whole = [None if s else b" ".join((t or "").encode().split()) for t, s in zip(texts, some)]
            whole = [w if w is None else hashlib.sha256(w).hexdigest() if digest else w.decode() for w in whole]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(lengths), pa.array(whole, pa.string()), pa.array([t if s else None for t, s in zip(texts, some)], pa.string()),
                    pa.array(n.astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(place.astype(np.int32))),
                ],
                names=["doc_id", "n_words", "kept", "text", "windows", "sure"],
            )


def send_windows(batches: Iterator[pa.RecordBatch], sent, cells: int, width: int, run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The candidate windows by bucket of their hash, packed. Of windows known to repeat one is sent
    for each hash, without its place (row -1), so a very common window costs a task one entry."""
    bits = sent.value
    told = np.empty(0, np.uint64)  # of repeated windows sent by this task; a very common one goes once
    for batch in batches:
        for part in slices(batch, 1, 2_000_000):
            lengths, start, h1, h2 = candidates(part.column(1), bits, cells, width, run)
            edges = np.concatenate(([0], np.cumsum(lengths)))
            owner = np.searchsorted(edges, start, "right") - 1
            place = start - edges[owner]
            lists = part.column(2)
            known = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(edges[:-1], pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            sure = np.isin(start, known, assume_unique=True)
            row = np.where(sure, -1, part.column(0).to_numpy(zero_copy_only=False)[owner])
            once = np.flatnonzero(sure)
            once = once[np.unique(np.stack((h1[once], h2[once])), axis=1, return_index=True)[1]] if len(once) else once
            both = h1[once] ^ mixed(h2[once])
            once = once[~np.isin(both, told)]
            told = np.concatenate((told, both))[-TOLD:]
            keep = np.concatenate((np.flatnonzero(~sure), once))
            bucket = (h1[keep] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            keep, bucket = keep[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keep) else []
            ends = [*cuts[1:], len(keep)]
            packs = [[x[keep[a:b]].astype(t).tobytes() for a, b in zip(cuts, ends)] for x, t in ((h1, "<u8"), (h2, "<u4"), (row, "<i8"), (place, "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int64()) if len(keep) else pa.array([], pa.int64()), *[pa.array(x, pa.binary()) for x in packs]], names=["bucket", "h1", "h2", "row", "place"])


def settle_windows(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Groups the windows of this task's buckets exactly; the places of those that repeat, packed by
    block of documents. Holds about 24 bytes for a window; the tasks grow in number with the windows."""
    held: list[list[bytes]] = [[], [], [], []]
    for batch in batches:
        for have, column in zip(held, batch.columns[1:]):
            have += column.to_pylist()
    h1, h2, row, place = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<u8", "<u4", "<i8", "<i4")))
    if not len(h1):
        return
    order = np.lexsort((h2, h1))
    h1, h2, row, place = h1[order], h2[order], row[order], place[order]
    group = np.cumsum(np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))) - 1
    weight = np.bincount(group, np.where(row < 0, 2, 1))
    yes = np.flatnonzero((row >= 0) & (weight[group] > 1))
    row, place = row[yes], place[yes]
    block = row % blocks
    order = np.argsort(block, kind="stable")
    row, place, block = row[order], place[order], block[order]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(row) else np.zeros(1, np.int64)
    packs = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in (row, place)]
    yield pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *[pa.array(x, pa.binary()) for x in packs]], names=["block", "rows", "places"])


def cut_block(docs: pa.Table, answers: pa.Table, width: int, digest: bool, kind: pa.DataType) -> pa.Table:
    """A block of documents (row, doc_id, text, sure) and the places of their repeated windows ->
    doc_id, n_words, n_removed, and the kept text or its hash."""
    row = np.frombuffer(b"".join(answers["rows"].to_pylist()), "<i8")
    place = np.frombuffer(b"".join(answers["places"].to_pylist()), "<i4")
    order = np.argsort(row, kind="stable")
    row, place = row[order], place[order]
    out = []
    for number, doc_id, text, sure in zip(*(docs[c].to_pylist() for c in ("row", "doc_id", "text", "sure"))):
        words = text.encode().split()
        a, b = np.searchsorted(row, (number, number + 1))
        starts = np.concatenate((np.asarray(sure, np.int64), place[a:b]))
        edge = np.bincount(starts, minlength=len(words) + 1) - np.bincount(starts + width, minlength=len(words) + 1)
        keep = np.cumsum(edge[:-1]) == 0
        kept = b" ".join([w for w, k in zip(words, keep.tolist()) if k])
        out.append((doc_id, len(words), len(words) - int(keep.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode()))
    a, b, c, d = zip(*out) if out else ((), (), (), ())
    return pa.table([pa.array(a, kind), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, width: int = 35, run: int = 8, digest: bool = True, windows_a_task: int = 1_000_000) -> DataFrame:
    """Per document doc_id, n_words, n_removed and kept_sha256 (or, without ``digest``, kept_text).

    A window is ``width`` consecutive words (runs of other than ASCII white space) of one document;
    words covered by a window that starts anywhere else too are removed, judged on the input. Windows
    are told apart by 96 bits of two hashes of their words.

    Null and empty texts and texts shorter than a window keep all their words; repeated rows are
    copies of each other; doc_id may be null or repeat; an empty table gives no row; other columns
    are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    likely = size / 6 * 2 / (width - run + 2)  # places with a minimizer
    cells = 1 << BLOCK_BITS
    while cells < 4 * likely and cells < MOST_CELLS:
        cells *= 2
    sent = spark.sparkContext.broadcast(merged_sketch(docs.select("text").where("text IS NOT NULL"), cells, width, run))
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.mapInArrow(lambda bs: find_candidates(bs, sent, cells, width, run, digest), f"doc_id {kind}, n_words long, kept string, text string, windows long, sure array<int>")
    found = stored(first.withColumn("row", F.monotonically_increasing_id()))
    some = found.where("text IS NOT NULL")
    windows = some.agg(F.sum("windows")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-windows // windows_a_task))
    buckets = 4 * tasks
    blocks = max(buckets, -(-size // BLOCK_BYTES))
    packed = some.select("row", "text", "sure").mapInArrow(lambda bs: send_windows(bs, sent, cells, width, run, buckets), "bucket long, h1 binary, h2 binary, row binary, place binary")
    answers = packed.repartition(tasks, "bucket").mapInArrow(lambda bs: settle_windows(bs, blocks), "block long, rows binary, places binary")
    arrow = to_arrow_type(docs.schema["doc_id"].dataType)
    left = some.select(F.pmod("row", F.lit(blocks)).alias("block"), "row", "doc_id", "text", "sure").groupBy("block").cogroup(answers.groupBy("block"))
    cut = left.applyInArrow(lambda d, a: cut_block(d, a, width, digest, arrow), f"doc_id {kind}, n_words long, n_removed long, kept string")
    plain = found.where("text IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return cut.unionByName(plain).withColumnRenamed("kept", "kept_sha256" if digest else "kept_text")


def substring_query(docs: DataFrame) -> DataFrame:
    """``op7_substring``."""
    return remove_repeats(docs)


#: The same result by grouping the windows' text itself.
SUBSTRING_SQL = r"""
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS nr, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), keys AS (
  SELECT nr, unnest(list_transform(range(1, len(words) - 33), lambda i: array_to_string(list_slice(words, i, i + 34), ' '))) AS k, unnest(range(1, len(words) - 33)) AS i FROM texts WHERE len(words) >= 35
), again AS (
  SELECT nr, i FROM keys WHERE k IN (SELECT k FROM keys GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT nr, i + d AS j FROM again CROSS JOIN (SELECT unnest(range(0, 35)) AS d) o
), placed AS (
  SELECT nr, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS j FROM texts
), kept AS (
  SELECT placed.nr, count(*) AS n, string_agg(w, ' ' ORDER BY placed.j) AS t FROM placed LEFT JOIN gone ON placed.nr = gone.nr AND placed.j = gone.j WHERE gone.j IS NULL GROUP BY placed.nr
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM texts LEFT JOIN kept ON texts.nr = kept.nr
"""
