"""Sizes at which the plain way ends: many item seeds, shares near 0 and 1, large crowds of near copies."""

import itertools
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftloom.llm import components, decontamination, mixing, simhash
from shiftloom.llm.common import TIDY, stored


def test_half_a_million_item_seeds(spark):
    """The shuffled join behind the bit filter, against the same leaks by broadcast of the few items that matter."""
    word = lambda i, k: F.concat(F.lit("w"), F.pmod(F.xxhash64(i, k), F.lit(50_000)).cast("string"))
    many = spark.range(7000).select((F.col("id") + 1000).alias("item_id"), F.concat_ws(" ", *[word(F.col("id"), F.lit(k)) for k in range(32)]).alias("text"))
    few = spark.createDataFrame([(i, " ".join(f"p{i}x{j}" for j in range(20))) for i in range(5)], "item_id long, text string")
    docs = [(i, " ".join(f"q{i}x{j}" for j in range(30)) + (" " + " ".join(f"p{i % 7}x{j}" if j != 6 else "zz" for j in range(20)) if i % 3 == 0 else "")) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = many.unionByName(few)
    assert decontamination.seeds(items.select("item_id", decontamination.tokens(F.col("text")).alias("w")), "w", decontamination.MASKS).count() > 500_000
    began = time.time()
    got = Counter((r.doc_id, r.item_id, r.n_matched) for r in decontamination.find_leaks(d, items).collect())
    assert time.time() - began < 120
    assert got == Counter((r.doc_id, r.item_id, r.n_matched) for r in decontamination.find_leaks(d, few).collect())
    assert len(got) == sum(1 for i in range(0, 300, 3) if i % 7 < 5)


@pytest.mark.parametrize("share", [0.00001, 0.001, 0.5, 0.999, 0.99999, mixing.MOST])
def test_rank_keys_spread(spark, share):
    """No bucket holds over a hundredth of a source, whatever its inclusion share; buckets keep the order."""
    keys = spark.range(200_000).select(mixing.pareto_place(mixing.uniform(F.xxhash64("id")), F.lit(share)).alias("place"))
    held = keys.select("place", mixing.bucket_of(F.col("place"), 16384).alias("b"))
    assert held.groupBy("b").count().agg(F.max("count")).first()[0] < 2000
    p, b = (np.array(x) for x in zip(*held.orderBy("place").collect()))
    assert (np.diff(b) >= 0).all() and b.min() > 0 and b.max() < 16383


def test_mix_fills_shares_near_one_and_near_zero(spark):
    """A target just under or over a whole copy of its source, and one that wants hardly anything."""
    rows = [(s * 10_000 + i, "w " * (1 + i % 3), f"s{s}") for s in range(3) for i in range(3000)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0005, 0.9995, 1e-6))
    for r in out.groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n")).collect():
        assert abs(r.n - r.t) <= 3


def test_a_crowd_of_thousands(spark, monkeypatch):
    """One crowd, nearly all of one label: few rows meet, and the groups are right."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(3000):
        words = list(base)
        for j in rng.choice(120, 1, replace=False):
            words[j] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(5000 + i, " ".join(f"y{i}z{j}" for j in range(60))) for i in range(50)]
    monkeypatch.setattr(simhash, "CROWD", 256)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    nodes = simhash.with_fingerprints(df, simhash.STAGE).select(F.col("fingerprint").alias("node"))
    every, crowd = simhash.links_and_crowd(nodes.distinct(), simhash.STAGE)
    assert crowd.distinct().count() > 2000
    assert every.where("verify").count() < (simhash.NEAREST + simhash.FEW) * 3050
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(df).collect())
    assert kept == [0, *range(5000, 5050)]


def test_a_crowd_in_a_bucket_is_compared_in_bounded_parts():
    """What a task holds of a bucket's pairs is bounded, however many of its members are near each other."""
    x = np.zeros((2_000, simhash.STAGE.lanes), np.uint32)
    x[:, 1] = np.arange(2_000) % 8
    sizes = [len(rows) for rows, _, _ in simhash.near_in_bucket(x, 0, simhash.STAGE)]
    assert sum(sizes) == 2_000 * 1_999 and max(sizes) <= 1 << 17


def shuffled_by_stage(spark, since=0):
    """Bytes that each stage from ``since`` on has shuffled."""
    store, out = spark.sparkContext._jsc.sc().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in itertools.count(since):
        try:
            out.append(store.lastStageAttempt(i).shuffleWriteBytes())
        except Exception:
            return out


def near_prints(n, crowd, seed=3):
    """Fingerprints with the 8 bytes of their sets: random ones, near copies of every tenth, and a crowd of the first."""
    rng = np.random.default_rng(seed)
    prints = rng.integers(0, 256, (n, 24), dtype=np.uint8)
    copies = np.concatenate([prints[::10], np.repeat(prints[:1], crowd, axis=0)])
    for bit in rng.integers(0, 128, (8, len(copies))):
        copies[np.arange(len(copies)), bit // 8] ^= (1 << bit % 8).astype(np.uint8)
    copies[:, 16:] = rng.integers(0, 256, (len(copies), 8), dtype=np.uint8)
    return np.concatenate([prints, copies])


@pytest.mark.parametrize("most", [20_000, 60])
def test_rounds_bound_what_is_shuffled_and_find_the_same(spark, monkeypatch, most):
    """With as many choices of blocks as large tables have (84 a lane), no stage shuffles all of them, and rounds connect what
    all at once connect and what comparing every two does."""
    monkeypatch.setattr(simhash, "blocks_for", lambda n, near, bits=64: (near + 3, 3))
    raw = near_prints(2000, 120)
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in raw], "u binary")
    x = raw[:, :16].copy().view(np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= simhash.STAGE.near, 1))
    want = list(range(len(raw)))
    for _ in range(8):
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
    groups = lambda label: sorted(map(sorted, ([i for i, y in enumerate(label) if y == k] for k in set(label))))
    at = {r.tobytes(): i for i, r in enumerate(raw)}
    room, most_at_once = len(raw) * 32 * 336 // 6, []
    for given in (None, room):
        since = len(shuffled_by_stage(spark))
        every, crowd = simhash.links_and_crowd(df, simhash.STAGE, most=most, room=given)
        most_at_once.append(max(shuffled_by_stage(spark, since)))
        got = list(range(len(raw)))
        for r in components.connected_components(every.select("u", "v")).collect():
            got[at[bytes(r.node)]] = at[bytes(r.root)]
        assert groups(got) == groups(want)
        alone = {i for i, n in enumerate(np.bincount(near.ravel(), minlength=len(raw))) if n <= simhash.FEW}
        told = {tuple(sorted((at[bytes(r.u)], at[bytes(r.v)]))) for r in every.where("verify").collect()}
        assert {(a, b) for a, b in near.tolist() if {a, b} <= alone} <= told <= set(map(tuple, near.tolist()))
        assert {at[bytes(r.u)] for r in crowd.collect()} & alone == set()
    assert most < len(raw) or most_at_once[1] < room < most_at_once[0]


def test_a_pair_is_told_by_its_first_bucket_only(spark):
    """Near fingerprints share many buckets; together these tell a pair once."""
    rule, (m, c) = simhash.STAGE, (9, 3)
    raw = near_prints(300, 0)
    x, masks, left_out = simhash.lanes_of(raw, rule), simhash.masks_for(m, c, rule.bits), simhash.skipped(m, c, rule.bits)
    told = Counter()
    for lane, (mask, out) in itertools.product(range(rule.lanes), zip(masks, left_out)):
        key = x[:, lane] & mask.astype(x.dtype)
        for k in np.unique(key):
            ids = np.flatnonzero(key == k)
            u, v, crowd = simhash.partners(x[ids], lane, out, rule)
            assert not len(crowd)
            told.update(tuple(sorted(p)) for p in zip(ids[u].tolist(), ids[v].tolist()))
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]).sum(axis=2) <= rule.near, 1))
    assert told == Counter(map(tuple, near.tolist())) and len(near) >= 30


def test_shuffle_files_of_a_tidy_table_go_at_once(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {str(f) for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    table = stored(spark.range(10_000).repartition(5, "id"), tidy=True)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before and table.count() == 10_000
    assert spark.conf.get(TIDY, "false") == "false"
