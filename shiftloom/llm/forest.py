"""Near duplicates of embeddings: a forest of random-projection trees with spill, compared within leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored
from .components import connected_components
from .mixing import uniform
from .neighbours import matrix, usable

#: Vectors that a fit sees, vectors of a leaf to aim at, vectors of a side compared at once.
SAMPLE, LEAF, BLOCK = 20_000, 512, 1024
#: Reach of the overlap as a share of what a pair at the threshold differs by along a random direction; a
#: split that would send more than MOST_SPILL to both sides is none; directions tried for a split.
SPILL, MOST_SPILL, TRIES = 0.35, 0.5, 4
#: Share of pairs at the threshold that should meet in some leaf, and trees at most.
AIM, MOST_TREES = 0.985, 64
#: Vectors of the sample from which a dense ball is one.
CROWD = 32


@dataclass
class Tree:
    """Splits: a direction, a cut and two children each; a child below 0 is the leaf ``~child``."""

    planes: np.ndarray
    cuts: np.ndarray
    kids: np.ndarray
    margin: float

    @property
    def leaves(self) -> int:
        return len(self.cuts) + 1

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches; rows within the margin of a cut go both ways."""
        if not len(self.cuts):
            return np.arange(len(x)), np.zeros(len(x), np.int64)
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            if node < 0:
                rows.append(own)
                leaves.append(np.full(len(own), ~node))
                continue
            z = x[own] @ self.planes[node] - self.cuts[node]
            todo += [(int(self.kids[node, 0]), own[z < self.margin]), (int(self.kids[node, 1]), own[z >= -self.margin])]
        return np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *leaves])


def grow(x: np.ndarray, leaf_at: int, margin: float, rng: np.random.Generator) -> Tree:
    """Recursive splits of a sample at the median along random directions, the widest of a few, down to
    ``leaf_at`` rows; where too much would spill, as inside a dense ball, the leaf stays whole."""
    planes, cuts, kids, leaves = [], [], [], 0
    todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        best = None
        if len(rows) > leaf_at:
            tried = rng.standard_normal((TRIES, x.shape[1]))
            tried /= np.linalg.norm(tried, axis=1)[:, None]
            z = x[rows] @ tried.T
            cut = np.median(z, axis=0)
            spills = (np.abs(z - cut) < margin).mean(0)
            i = int(spills.argmin())
            if spills[i] <= MOST_SPILL:
                best = tried[i], cut[i], z[:, i] - cut[i]
        if best is None:
            child, leaves = ~leaves, leaves + 1
        else:
            child = len(cuts)
            planes.append(best[0])
            cuts.append(best[1])
            kids.append([0, 0])
            todo += [(rows[best[2] < margin], child, 0), (rows[best[2] >= -margin], child, 1)]
        if parent >= 0:
            kids[parent][side] = child
    return Tree(np.array(planes).reshape(-1, x.shape[1]), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), margin)


def meet(tree: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row of ``a`` reaches a leaf that the same row of ``b`` reaches."""
    out = np.zeros(len(a), bool)
    keys = [r * tree.leaves + leaf for r, leaf in (tree.descend(a), tree.descend(b))]
    out[np.intersect1d(*keys) // tree.leaves] = True
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by a power of two first, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def dense_balls(x: np.ndarray, tree: Tree, half: float) -> np.ndarray:
    """Centres of balls that hold CROWD rows of the sample or more within half the threshold's angle."""
    rows, leaves = tree.descend(x)
    centres: list[np.ndarray] = []
    taken = np.zeros(len(x), bool)
    for leaf in range(tree.leaves):
        own = rows[leaves == leaf]
        own = own[~taken[own]]
        own = own[: 4 * BLOCK]  # of the sample; what is left over is compared like all else
        near = x[own] @ x[own].T >= half
        while len(own) >= CROWD and (size := near.sum(1)).max() >= CROWD:
            i = int(size.argmax())
            centre = unit(x[own[near[i]]].mean(0)[None, :])
            held = (x[own] @ centre[0] >= half) | near[i]
            centres.append(centre[0])
            taken[own[held]] = True
            own, near = own[~held], near[np.ix_(~held, ~held)]
    return np.array(centres).reshape(-1, x.shape[1])


def fit(x: np.ndarray, n: int, least: float, seed: int) -> tuple[list[Tree], np.ndarray]:
    """Trees and ball centres from a sample ``x`` of ``n`` vectors (both of length 1).

    Trees are added until AIM of pairs made at the threshold meet, allowing for the further splits that
    more vectors than the sample holds will need.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    margin = SPILL * math.sqrt(max(0.0, 2 - 2 * least) / dim)
    leaf_at = max(24, LEAF * len(x) // max(1, n))
    one = x[rng.choice(len(x), min(len(x), 1000), replace=False)]
    off = rng.standard_normal(one.shape)
    off -= (off * one).sum(1)[:, None] * one
    # In one dimension nothing is off at an angle: such a pair is one of equal vectors.
    other = unit(least * one + math.sqrt(1 - least * least) * off / np.maximum(np.linalg.norm(off, axis=1), 1e-300)[:, None])
    trees, met = [], np.zeros(len(one), bool)
    chances: list[float] = []
    while len(trees) < MOST_TREES:
        tree = grow(x, leaf_at, margin, rng)
        trees.append(tree)
        now = meet(tree, one, other)
        met |= now
        deeper = max(1.0, math.log2(max(2.0, n / LEAF)) / math.log2(max(2, tree.leaves)))
        chances.append(now.mean() ** deeper)
        if met.mean() >= AIM and math.prod(1 - c for c in chances) <= 1 - AIM:
            break
    return trees, dense_balls(x, trees[0], math.cos(math.acos(least) / 2) + 1e-9)


def route(batches: Iterator[pa.RecordBatch], trees: list[Tree], balls: np.ndarray, half: float) -> Iterator[pa.RecordBatch]:
    """(class, weight, vector) with its dense ball, -1 for none, and all its leaves."""
    for b in batches:
        if not len(b):
            continue
        x = unit(matrix(b.column(2)))
        ball = np.full(len(x), -1)
        if len(balls):
            near = x @ balls.T
            ball = np.where(near.max(1) >= half, near.argmax(1), -1)
        rows, leaves = zip(*[tree.descend(x) for tree in trees])
        leaf = np.concatenate([own + (t << 32) for t, own in enumerate(leaves)])
        order = np.argsort(np.concatenate(rows), kind="stable")
        ends = np.concatenate(([0], np.cumsum(np.bincount(np.concatenate(rows), minlength=len(x))))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(leaf[order].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ball.astype(np.int32)), lists], names=["class", "weight", "vector", "ball", "leaves"])


def split_further(routed: DataFrame, margin: float, seed: int, rounds: int = 8) -> DataFrame:
    """Leaves that a bounded sample left too large are split again from a sample of their own, in Spark,
    round by round; a leaf that can't be split, as a dense ball, stays."""
    kind = routed.schema["vector"].dataType.simpleString()
    whole: DataFrame | None = None
    for at in range(rounds):
        homes = routed.select("class", F.explode("leaves").alias("leaf"))
        large = homes.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 4 * LEAF)
        large = stored(large if whole is None else large.join(whole, "leaf", "left_anti"))
        if not large.limit(1).count():
            return routed
        members = homes.join(large, "leaf").join(routed.select("class", "vector"), "class")
        drawn = members.where(uniform(F.xxhash64(F.lit(seed + at), "class", "leaf")) < F.lit(float(8 * LEAF)) / F.col("n"))

        def grown(group: pa.Table) -> pa.Table:
            x, n = unit(matrix(group["vector"].combine_chunks())), group["n"][0].as_py()
            leaf = group["leaf"][0].as_py()
            tree = grow(x, max(24, LEAF * len(x) // n), margin, np.random.default_rng([seed, at, leaf % (1 << 32)]))
            return pa.table({"leaf": [leaf], "planes": [tree.planes.tobytes()], "cuts": [tree.cuts.tobytes()], "kids": [tree.kids.tobytes()], "split": [len(tree.cuts) > 0]})

        trees = stored(drawn.select("leaf", "n", "vector").groupBy("leaf").applyInArrow(grown, "leaf long, planes binary, cuts binary, kids binary, split boolean"))
        left = large.join(trees.where("split").select("leaf"), "leaf", "left_anti").select("leaf")
        whole = stored(left if whole is None else whole.unionByName(left))

        def descended(rows: pa.Table, trees: pa.Table) -> pa.Table:
            schema = pa.schema([("class", pa.int64()), ("leaf", pa.int64()), ("sub", pa.int64())])
            if not rows.num_rows or not trees.num_rows:
                return schema.empty_table()
            x = unit(matrix(rows["vector"].combine_chunks()))
            t = {c: trees[c][0].as_py() for c in trees.schema.names}
            tree = Tree(np.frombuffer(t["planes"]).reshape(-1, x.shape[1]), np.frombuffer(t["cuts"]), np.frombuffer(t["kids"], np.int64).reshape(-1, 2), margin)
            own, leaf = tree.descend(x)
            return pa.table([rows["class"].take(pa.array(own)), pa.array(np.full(len(own), t["leaf"])), pa.array(leaf)], schema=schema)

        ways = trees.where("split").join(large, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / SAMPLE).cast("int"))))
        dealt = members.join(trees.where("split").select("leaf"), "leaf").withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / SAMPLE) + 1).cast("int"))
        moved = dealt.select("leaf", "part", "class", "vector").groupBy("leaf", "part").cogroup(ways.select("leaf", "part", "planes", "cuts", "kids").groupBy("leaf", "part")).applyInArrow(descended, "class long, leaf long, sub long")
        moved = moved.groupBy("class").agg(F.collect_set("leaf").alias("old"), F.collect_set(F.xxhash64("leaf", "sub")).alias("new"))
        # A class has a few leaves in each tree.
        now = routed.join(moved, "class", "left")
        leaves = F.when(F.col("new").isNotNull(), F.concat(F.array_except("leaves", "old"), "new")).otherwise(F.col("leaves"))
        routed = stored(now.select("class", "weight", F.col("vector").cast(kind).alias("vector"), "ball", leaves.alias("leaves")))
    return routed


def in_blocks(routed: DataFrame) -> DataFrame:
    """Each class once for every two blocks (i, j) of a leaf that are to be compared.

    A leaf of up to BLOCK classes is one block. Others are dealt into blocks by ball and hash, and every two
    blocks meet but those of one ball: its classes are all linked already.
    """
    homes = routed.select("class", "weight", "vector", "ball", "leaves", F.explode("leaves").alias("leaf"))
    sizes = homes.groupBy("leaf", "ball").agg(F.count("*").alias("n"))
    by_leaf = Window.partitionBy("leaf")
    plan = sizes.withColumns({"all": F.sum("n").over(by_leaf), "balls": F.count("*").over(by_leaf)}).where((F.col("all") > 1) & ((F.col("balls") > 1) | (F.col("ball") < 0)))
    plan = plan.withColumn("parts", F.when(F.col("all") <= BLOCK, 0).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int"))
    plan = plan.withColumns({"blocks": F.sum("parts").over(by_leaf), "first": F.sum("parts").over(by_leaf.orderBy("ball")) - F.col("parts")}).select("leaf", "ball", "parts", "blocks", "first")
    placed = homes.join(stored(plan), ["leaf", "ball"])
    block = F.when(F.col("parts") == 0, 0).otherwise(F.col("first") + F.pmod(F.xxhash64("class"), F.col("parts"))).cast("int")
    every = F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)).cast("int"))
    others = F.when((F.col("ball") < 0) | (F.col("parts") == 0), every).otherwise(F.filter(every, lambda c: (c < F.col("first")) | (c >= F.col("first") + F.col("parts"))))
    met = placed.withColumn("block", block).withColumn("other", F.explode(others))
    earlier = F.filter("leaves", lambda x: x < F.col("leaf"))
    return met.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "class", "weight", "vector", "ball", earlier.alias("earlier"))


def share_any(lists: list[list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the lists of each pair have a number in common."""
    if not len(a):
        return np.zeros(0, bool)
    wide = max(1, max(map(len, lists)))
    known = np.array([x + [None] * (wide - len(x)) for x in lists], dtype=object)
    filled = known != None  # noqa: E711  elementwise
    numbers = np.where(filled, known, 0).astype(np.int64)
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 15):
        p, q = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
        for k in range(wide):
            out[at : at + (1 << 15)] |= filled[p, k] & ((numbers[q] == numbers[p, k][:, None]) & filled[q]).any(1)
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(group: pa.Table, least: float) -> pa.Table:
    """Links of two blocks of a leaf: for each class the copies it links with here, and its root.

    A pair counts only in the smallest leaf that both reach, so that no pair counts twice, and not at all
    where one dense ball holds both.
    """
    schema = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    group = group.combine_chunks().sort_by("class")
    i, j = group["i"][0].as_py(), group["j"][0].as_py()
    block, ids, ball, weight = (group[c].to_numpy() for c in ("block", "class", "ball", "weight"))
    x = matrix(group["vector"].combine_chunks() if isinstance(group["vector"], pa.ChunkedArray) else group["vector"])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    size = np.sqrt((x * x).sum(1))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    near = x[left] @ x[right].T / (size[left][:, None] * size[right][None, :]) >= least
    near &= (ball[left][:, None] < 0) | (ball[left][:, None] != ball[right][None, :])
    if i == j:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    new = ~share_any(group["earlier"].to_pylist(), a, b)
    a, b = a[new], b[new]
    linked = np.unique(np.concatenate((a, b)))
    links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
    return pa.table([ids[linked], links[linked].astype(np.int64), ids[roots(len(ids), a, b)[linked]]], schema=schema)


def near_duplicates(vectors: DataFrame, least: float = 0.9, seed: int = 20240506) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors`` (vec_id, embedding).

    Two rows are linked if their vectors' cosine is ``least`` or more and some leaf holds both, or they are
    equal, or one dense ball holds both; every link is checked in double precision, but within a ball of
    half the threshold's angle, which proves it. ``n_links`` counts other rows, each once; ``component_id`` is the
    smallest vec_id reachable. A vector that is null, zero or holds null or non-finite components, and a
    row without vec_id, links with nothing (component_id is its own vec_id; kept). Vectors of other lengths never link with each other.
    Rows that repeat an id are rows of their own. An empty table gives no row; other columns are ignored.

    Equal vectors are one class with a weight. Trees are fitted on a bounded sample (SAMPLE) and split
    further in Spark; every class is routed through all of them. What leaves a leaf is a row for each
    linked class, never a pair.
    """
    rows = stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).withColumn("row", F.monotonically_increasing_id()))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    classes = stored(good.groupBy("vector").agg(F.min("row").alias("class"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id")))
    half = math.cos(math.acos(least) / 2) + 1e-9
    found = vectors.sparkSession.createDataFrame([], "class long, links long, root long")
    for d in classes.groupBy(F.size("vector").alias("d")).count().orderBy("d").collect():  # a row for each length of vectors
        own = classes.where(F.size("vector") == d["d"])
        drawn = own.where(uniform(F.xxhash64(F.lit(seed), "vector")) < F.lit(1.05 * SAMPLE / d["count"])) if d["count"] > SAMPLE else own
        sample = unit(matrix(drawn.select("vector").toArrow()["vector"].combine_chunks()))
        trees, balls = fit(sample, d["count"], least, seed)
        routed = stored(own.select("class", "weight", "vector").mapInArrow(lambda bs, trees=trees, balls=balls: route(bs, trees, balls, half), f"class long, weight long, vector {rows.schema['vector'].dataType.simpleString()}, ball int, leaves array<long>"))
        routed = split_further(routed, trees[0].margin, seed)
        compared = in_blocks(routed).groupBy("leaf", "i", "j").applyInArrow(lambda g: compare(g, least), "class long, links long, root long")
        held = routed.where("ball >= 0")
        balls_of = held.groupBy("ball").agg(F.sum("weight").alias("total"), F.min("class").alias("root"))  # a row for each ball of the fit
        in_ball = held.join(balls_of, "ball").select("class", (F.col("total") - F.col("weight")).alias("links"), "root")
        found = found.unionByName(compared).unionByName(in_ball)
    found = stored(found)
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v")))
    known = classes.select("class", "weight", "first_id").join(links, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("root", F.coalesce("root", "class"))
    named = known.join(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "root")
    # Rows meet their class by the vector itself; alone in it, by the row.
    alone = named.where("weight = 1").select(F.col("class").alias("row"), F.coalesce("links", F.lit(0)).alias("n_links"), "component_id")
    copies = named.where("weight > 1").select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    of_row = good.join(classes.where("weight > 1").select("vector", "class"), "vector").select("row", "class").join(copies, "class").select("row", "n_links", "component_id")
    out = rows.select("row", "vec_id").join(alone.unionByName(of_row), "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def forest_query(embeddings: DataFrame) -> DataFrame:
    """``op13_forest``."""
    return near_duplicates(embeddings)
