"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .decontamination import bounded
from .mixing import uniform

#: Bounds of the fit: vectors of the sample, centroids of each of the two levels, parts of a code.
SAMPLE, LISTS, PARTS = 20_000, 4096, 32
#: Codes of one block of the index, queries that meet it in one task, vectors held against all lists at once,
#: distances of queries to lists held at once.
BLOCK, QUERIES, SLICE, HELD = 8192, 1024, 1024, 4_000_000


@dataclass(frozen=True)
class Index:
    """What the fit learns; its size depends on the bounds above, not on the table.

    A list is a pair of a coarse centroid and a fine one, which stands for what the coarse one leaves; the
    fine ones are shared by all coarse ones. So some thousand centroids name as many lists as the root
    of the table's rows, however many these are.
    """

    coarse: np.ndarray  # (coarse centroids, dim)
    fine: np.ndarray  # (fine centroids, dim); a single one, zero, while the coarse ones suffice
    books: tuple[np.ndarray, ...]  # per part of the dimensions: (up to 256, dims of the part)
    parts: tuple[np.ndarray, ...]  # dimensions of each part
    probes: int

    @property
    def lists(self) -> int:
        return len(self.coarse) * len(self.fine)

    def centre(self, number: np.ndarray | int) -> np.ndarray:
        return self.coarse[number // len(self.fine)] + self.fine[number % len(self.fine)]

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: its nearest coarse centroid, then the nearest fine one."""
        first = squared(x, self.coarse).argmin(1)
        return first * len(self.fine) + squared(x - self.coarse[first], self.fine).argmin(1)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of vectors to the centres of all lists, as a line of lists for each."""
        both = 2 * self.coarse @ self.fine.T + (self.fine * self.fine).sum(1)
        far = squared(x, self.coarse)[:, :, None] + both[None] - 2 * (x @ self.fine.T)[:, None, :]
        return far.reshape(len(x), -1)


def usable(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, without null or non-finite components, of the table's dimension."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if dim is None else ok & (F.size(vector) == dim), F.lit(False))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from distinct points; an empty cluster moves to the point furthest from its own."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centre = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        far = squared(x, centre)
        own = far.argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            centre[empty] = x[np.argsort(-far[np.arange(len(x)), own])[: len(empty)]]
    return centre


def fit(sample: np.ndarray, n: int, k: int, seed: int = 20240506, aim: float = 0.99) -> Index:
    """``sample``: distinct vectors; ``n``: rows of the table, which gets lists by its root. ``probes``: so
    many lists that, within the sample, the share ``aim`` of true neighbours of sampled queries is in
    the lists probed."""
    rng = np.random.default_rng(seed)
    dim, root = sample.shape[1], max(1, round(n**0.5))
    coarse = kmeans(sample, int(min(LISTS, root, max(1, len(sample) // 8))), rng)
    rest = sample - coarse[squared(sample, coarse).argmin(1)]
    wanted = int(min(LISTS, round(root / len(coarse)), max(1, len(sample) // 8)))
    fine = kmeans(rest, wanted, rng) if wanted > 1 else np.zeros((1, dim))
    parts = tuple(np.array_split(np.arange(dim), min(PARTS, dim)))
    index = Index(coarse, fine, (), parts, 1)
    own = index.own(sample)
    rest = sample - index.centre(own)
    books = tuple(kmeans(rest[:, p], 256, rng, 8) for p in parts)
    asked = rng.choice(len(sample), min(256, len(sample)), replace=False)
    need = [1]
    for q in asked:
        far = squared(sample[[q]], sample)[0]
        far[q] = np.inf
        near = np.argsort(far)[: min(k, len(sample) - 1)]
        to = index.apart(sample[[q]])[0]
        need += (1 + np.searchsorted(np.sort(to), to[own[near]])).tolist()
    return Index(coarse, fine, books, parts, int(np.quantile(need, aim, method="higher")))


def room(index: Index) -> int:
    """Vectors whose distances to all lists are held at once."""
    return max(1, min(SLICE, HELD // index.lists))


def sliced(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows."""
    return (b.slice(at, most) for b in batches for at in range(0, len(b), most))


def encode(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Each vector with its list, its code and how far it lies from what its code stands for."""
    for b in sliced(batches, SLICE):
        x = matrix(b.column(2))
        own = index.own(x)
        rest = x - index.centre(own)
        code = np.stack([squared(rest[:, p], book).argmin(1).astype(np.uint8) for p, book in zip(index.parts, index.books)], 1)
        lost = sum(((rest[:, p] - book[code[:, j]]) ** 2).sum(1) for j, (p, book) in enumerate(zip(index.parts, index.books)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(np.sqrt(lost) * np.ones(len(b))), b.column(2)],
            names=["row", "vec_id", "list", "code", "lost", "vector"],
        )


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def plan_blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each list: short lists share a block, long ones are split."""
    first, count, block, room = np.zeros(len(sizes), int), np.ones(len(sizes), int), 0, BLOCK
    for i, n in enumerate(sizes.tolist()):
        if n > room and room < BLOCK:
            block, room = block + 1, BLOCK
        first[i], count[i] = block, max(1, -(-n // BLOCK))
        if count[i] > 1:
            block, room = block + count[i], BLOCK
        else:
            room -= n
    return first, count


def send_queries(batches: Iterator[pa.RecordBatch], index: Index, sizes: np.ndarray, first: np.ndarray, count: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Each query once for every block that holds one of its lists, with those lists.

    A query probes the nearest ``probes`` lists, and more until they hold 4 * k candidates besides it.
    """
    for b in sliced(batches, room(index)):
        order = np.argsort(index.apart(matrix(b.column(1))), 1, kind="stable")
        rows, blocks, lists = [], [], []
        for i, line in enumerate(order):
            held = np.searchsorted(np.cumsum(sizes[line]), 4 * k + 1) + 1
            to: dict[int, list[int]] = {}
            for c in line[: max(index.probes, held)].tolist():
                for block in range(first[c], first[c] + count[c]):
                    to.setdefault(block, []).append(c)
            rows += [i] * len(to)
            blocks += to.keys()
            lists += to.values()
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(lists, pa.list_(pa.int32()))], names=["block", "asked", "vector", "lists"])


def search_block(queries: pa.Table, codes: pa.Table, index: Index, k: int) -> pa.Table:
    """The ``k`` nearest vectors of a block for each query, among those of its lists.

    Asymmetric distance tables give the distance to what each code stands for; the vector's own differs
    by no more than its code lost. Every vector that may be one of the ``k`` nearest by these bounds is
    measured exactly.
    """
    schema = pa.schema([("asked", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("far", pa.float64())])
    if not queries.num_rows or not codes.num_rows:
        return schema.empty_table()
    codes, queries = codes.combine_chunks().sort_by([("vec_id", "ascending"), ("row", "ascending")]), queries.combine_chunks()
    rows, ids = codes["row"].to_numpy(), codes["vec_id"].to_numpy()
    own = codes["list"].to_numpy()
    code = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
    asked = queries["asked"].to_numpy()
    x = matrix(queries["vector"].combine_chunks() if isinstance(queries["vector"], pa.ChunkedArray) else queries["vector"])
    own_x, lost = matrix(codes["vector"].combine_chunks() if isinstance(codes["vector"], pa.ChunkedArray) else codes["vector"]), codes["lost"].to_numpy()
    own_size, size = np.sqrt((own_x * own_x).sum(1)), np.sqrt((x * x).sum(1))
    probing: dict[int, list[int]] = {}
    for i, lists in enumerate(queries["lists"].to_pylist()):
        for c in lists:
            probing.setdefault(c, []).append(i)
    far = np.full((len(asked), len(ids)), np.inf)
    for c, who in probing.items():
        at = np.flatnonzero(own == c)
        rest = x[who] - index.centre(c)
        sums = np.zeros((len(who), len(at)))
        for j, (p, book) in enumerate(zip(index.parts, index.books)):
            sums += squared(rest[:, p], book)[:, code[at, j]]
        far[np.ix_(who, at)] = sums
    far[asked[:, None] == rows[None, :]] = np.inf
    out = []
    for i, line in enumerate(far):
        held = np.flatnonzero(line < np.inf)
        apart = np.sqrt(line[held])
        slack = lost[held] + 1e-6 * (size[i] + own_size[held])  # what the code lost, and rounding
        edge = np.partition(apart + slack, k - 1)[k - 1] if len(held) > k else np.inf
        near = held[apart - slack <= edge]
        exact = np.sqrt(((own_x[near] - x[i]) ** 2).sum(1))
        best = np.argsort(exact, kind="stable")[:k]  # codes are in the order of vec_id
        out.append((np.full(len(best), asked[i]), rows[near[best]], ids[near[best]], exact[best]))
    return pa.table([np.concatenate(c) for c in zip(*out)], schema=schema)


def nearest(vectors: DataFrame, queries: Column, k: int = 10, seed: int = 20240506) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found for each row where ``queries``.

    ``vectors`` has vec_id (long) and embedding. Rows whose vector is null, zero, of another dimension
    than most, or holds null or non-finite components take no part, nor do rows without vec_id. Every other row is indexed, also those that
    repeat a vec_id, and only a query's own row is no candidate of it; and fewer candidates than ``k`` are all returned. Lists, codes and probes are
    fitted on a bounded sample (SAMPLE vectors); within the lists probed the result is exact: all
    vectors that the codes' error bounds don't exclude are ranked by the exact Euclidean distance,
    ties to the smaller vec_id. An empty table gives
    no row; other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = dims[0]["d"]
    rows = stored(rows.where(F.size("vector") == dim).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    # Drawn by the hash of the vector, the lowest first: copies are drawn together and count once.
    hashed = rows.select("vector", F.xxhash64(F.lit(seed), "vector").alias("h"))
    kinds = hashed.agg(F.approx_count_distinct("h")).first()[0]
    drawn = hashed.where(uniform(F.col("h")) < F.lit(1.3 * SAMPLE / kinds)).groupBy("h").agg(F.first("vector").alias("vector"))
    sample = np.unique(matrix(drawn.orderBy("h").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()), axis=0)
    index = fit(sample, n, k, seed)
    codes = stored(rows.select("row", "vec_id", "vector").mapInArrow(lambda bs: encode(bs, index), f"row long, vec_id long, list int, code binary, lost double, vector {rows.schema['vector'].dataType.simpleString()}"))
    sizes = np.zeros(index.lists, np.int64)
    for r in codes.groupBy("list").count().collect():  # a row per list: the root of the rows
        sizes[r["list"]] = r["count"]
    first, count = plan_blocks(sizes)
    used = np.flatnonzero(sizes)
    places = vectors.sparkSession.createDataFrame(pa.table([used.astype(np.int32), first[used].astype(np.int32), count[used].astype(np.int32)], names=["list", "first", "count"]))
    block = F.col("first") + F.pmod(F.xxhash64("row"), F.col("count")).cast("int")
    asked = rows.where("asks").select("row", "vector")
    sent = stored(asked.mapInArrow(lambda bs: send_queries(bs, index, sizes, first, count, k), f"block int, asked long, vector {rows.schema['vector'].dataType.simpleString()}, lists array<int>"))
    groups = sent.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))  # a row per block
    meet = sent.join(F.broadcast(groups), "block").withColumn("part", F.pmod(F.xxhash64("asked"), F.col("groups")).cast("int"))
    held = codes.join(F.broadcast(places), "list").withColumn("block", block).drop("first", "count").join(F.broadcast(groups), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    found = meet.drop("groups").groupBy("block", "part").cogroup(held.drop("groups").groupBy("block", "part")).applyInArrow(
        lambda q, c: search_block(q, c, index, k), "asked long, row long, vec_id long, far double"
    )
    best = Window.partitionBy("asked").orderBy("far", "vec_id", "row")
    candidates = stored(found.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).select("asked", "row"))
    pairs = rows.select("row", "vec_id", F.col("vector").alias("v")).join(bounded(candidates), "row")
    pairs = pairs.join(rows.where("asks").select(F.col("row").alias("asked"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "asked")
    gaps = F.zip_with("q", "v", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))
    scored = pairs.select("asked", "query_id", "row", "vec_id", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)).alias("score"))
    final = Window.partitionBy("asked").orderBy("score", "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_query(embeddings: DataFrame) -> DataFrame:
    """``op6_neighbours``: queries are the rows whose vec_id is divisible by 100."""
    return nearest(embeddings, F.col("vec_id") % 100 == 0)
