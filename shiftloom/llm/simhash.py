"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, verified Hamming distance, and for
stages an exact check of the shingles."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, release, stored, stored_bytes
from .components import connected_components
from .decontamination import bounded
from .words import hash_words, lowered, mixed, numbered, packed, runs, slices, split_words

CHUNK = 1 << 15
#: A text of at most so many partners in a bucket is paired with each of them; one of more, in a crowd of
#: near copies, with its nearest there, and what that leaves open is settled by :func:`crowd_links`.
FEW = 16
#: Members of a crowd that meet as many others in one task.
CROWD = 512
#: Nearest partners of a member of a crowd whose shingles are compared at once.
NEAREST = 4
#: Bytes that tell sets of shingles with equal bits apart.
SUM = 8
#: Keys of buckets end in the number of their choice of lane and blocks.
CHOICES = np.uint64(1 << 16)
#: Bytes of fingerprints that are always sent to buckets at once.
ROOM = 64_000_000
#: Pairs of a bucket and bytes of text that a task works on at once.
PAIRS, BYTES = 1 << 17, 1_000_000
SEED = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Rule:
    """Fingerprints of ``lanes`` lanes (a power of two) of ``bits`` bits over shingles of ``words`` words are near if they
    differ in ``near`` bits or fewer: then some lane differs in ``near // lanes`` or fewer. With
    ``similarity``, near texts link only if their sets of shingles have that Jaccard similarity."""

    words: int = 5
    bits: int = 32
    lanes: int = 4
    near: int = 27
    similarity: float | None = 0.8


#: What the query's contract says: 4-word shingles, one lane, 4 bits.
CONTRACT = Rule(words=4, bits=64, lanes=1, near=4, similarity=None)
#: For a stage: of the texts of similarity 0.8, two in a hundred are further apart than 27 of 128 bits.
STAGE = Rule()


def fingerprint(text: bytes | None, words: int) -> bytes:
    """The contract's 64 bits: majority over XXH64 of each shingle, repeats included; no word: zero."""
    import xxhash

    cut = (text or b"").lower().split()  # ASCII letters and ASCII white space only, as bytes
    if not cut:
        return bytes(8)
    line = b" ".join(cut)
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(cut))
    starts, ends = starts[: len(cut) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(starts)).tobytes()


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text end to end, how many of each). A text of fewer words
    is one shingle, one without words has none. Hashes combine those of the words."""
    flat, lengths = split_words(lowered(texts))
    if not len(flat):
        return np.empty(0, np.uint64), np.zeros(len(lengths), np.int64)
    distinct, number = numbered(flat)
    hashes = hash_words(distinct)[number, 0]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(np.arange(len(lengths)), lengths)
    parts = []
    for k in range(1, words + 1):
        grams = runs(hashes, 0, k)
        start = np.arange(len(grams))
        if k == words:
            start = start[owner[start] == owner[start + k - 1]]
        else:
            start = edges[:-1][lengths == k]
        parts.append((owner[start], mixed(grams[start] + np.uint64(k))))
    owner, grams = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((grams, owner))
    owner, grams = owner[order], grams[order]
    first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (grams[1:] != grams[:-1])))
    return grams[first], np.bincount(owner[first], minlength=len(lengths))


def set_prints(texts: pa.Array, rule: Rule) -> np.ndarray:
    """For each text the majority bits over its distinct shingles and 8 bytes that tell sets of shingles
    with equal bits apart, as bytes; no word: zero."""
    grams, sizes = shingle_sets(texts, rule.words)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((len(sizes), rule.bits * rule.lanes // 8 + SUM), np.uint8)
    for k in range(rule.bits * rule.lanes // 64):
        ones = np.zeros((len(sizes), 64), np.int32)
        for at in range(0, len(grams), CHUNK):
            part, who = mixed(grams[at : at + CHUNK] ^ np.uint64(SEED * (k + 1) % (1 << 64))), owner[at : at + CHUNK]
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            ones[who[first]] += np.add.reduceat(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
        out[:, 8 * k : 8 * k + 8] = np.packbits(ones * 2 > sizes[:, None], axis=1)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some, -SUM:] = np.add.reduceat(mixed(grams + np.uint64(SEED)), cuts[:-1][some]).astype("<u8").view(np.uint8).reshape(-1, SUM)
    return out


def with_fingerprints(docs: DataFrame, rule: Rule, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """``docs`` with a binary column ``name``: the fingerprint, and with a ``similarity`` the 8 bytes of
    :func:`set_prints`."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, at, BYTES):
                if rule.similarity is None:
                    texts = b.column(at).cast(pa.binary() if not pa.types.is_large_string(b.column(at).type) else pa.large_binary())
                    prints = [fingerprint(x.as_py(), rule.words) for x in texts]
                else:
                    prints = [x.tobytes() for x in set_prints(b.column(at), rule)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prints, pa.binary())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def blocks_for(n: int, near: int, bits: int = 64) -> tuple[int, int]:
    """(m, c): cut a lane of ``bits`` bits into m blocks, join on every c of them. Lanes within ``near`` = m - c bits
    share c whole blocks. c is the cheapest from 2 on for n fingerprints, counting about 1 microsecond
    for a row sent and 2.5 nanoseconds for a comparison; the result is the same for each c. A single
    block is cheaper for few fingerprints only, and would make the rows sent for each grow with n."""
    cost = lambda c: comb(near + c, c) * (1 + 0.0025 * n / 2 ** (bits * c / (near + c)))
    c = min(range(2, 6), key=cost)
    return near + c, c


def blocks_of(m: int, bits: int = 64) -> list[int]:
    """The bits of each of m blocks."""
    edges = [round(bits * i / m) for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def masks_for(m: int, c: int, bits: int = 64) -> np.ndarray:
    return np.array([sum(pick) for pick in itertools.combinations(blocks_of(m, bits), c)], dtype=np.uint64)


def skipped(m: int, c: int, bits: int = 64) -> list[np.ndarray]:
    """For each choice of blocks those that it leaves out before its last one: lanes that share one of these as well share
    an earlier choice."""
    block = np.array(blocks_of(m, bits), dtype=np.uint64)
    return [block[[b for b in range(pick[-1]) if b not in pick]] for pick in itertools.combinations(range(m), c)]


def lanes_of(prints: np.ndarray, rule: Rule) -> np.ndarray:
    """Lanes of fingerprints (n, bytes) as (n, lanes) unsigned integers of their size."""
    own = np.ascontiguousarray(prints[:, : rule.bits * rule.lanes // 8])
    return own.view(f">u{rule.bits // 8}").astype(f"u{rule.bits // 8}")


def near_in_bucket(x: np.ndarray, lane: int, rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, bits apart) of all near fingerprints of a bucket of one lane, both ways, row by row. Every two
    are compared once, unless more pairs are near than a task holds."""
    n, most = len(x), rule.near // rule.lanes
    step = max(1, PAIRS // n)
    own, whole = np.ascontiguousarray(x[:, lane]), np.ascontiguousarray(x).view(np.uint64)

    def near(s: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = s if once else 0
        at = np.flatnonzero(np.bitwise_count(own[s : s + step, None] ^ own[first:]) <= most)
        rows, cols = (i.astype(np.int64) for i in np.divmod(at.astype(np.uint32), np.uint32(n - first)))
        rows, cols = rows + s, cols + first
        other = rows < cols if once else rows != cols
        rows, cols = rows[other], cols[other]
        apart = np.bitwise_count(whole[rows] ^ whole[cols]).sum(axis=1, dtype=np.int64)
        ok = apart <= rule.near
        return rows[ok], cols[ok], apart[ok]

    found, held = [], 0
    for s in range(0, n, step):
        found.append(near(s, True))
        held += 2 * len(found[-1][0])
        if held > PAIRS:
            break
    else:
        rows, cols, apart = (np.concatenate(c) for c in zip(*found))
        u, v, apart = np.concatenate([rows, cols]), np.concatenate([cols, rows]), np.concatenate([apart, apart])
        order = np.lexsort((v, u))
        yield u[order], v[order], apart[order]
        return
    for s in range(0, n, step):
        yield near(s, False)


def stars(x: np.ndarray, lane: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Each member of a component of the bucket with the component's first."""
    labels = np.arange(len(x))
    for rows, cols, _ in near_in_bucket(x, lane, rule):
        cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True]))) if len(rows) else []
        for a, b in zip(cuts[:-1], cuts[1:]):
            seen = labels[np.append(cols[a:b], rows[a])]
            low = seen.min()
            if (seen != low).any():
                labels[np.isin(labels, np.unique(seen))] = low
    moved = np.flatnonzero(labels != np.arange(len(x)))
    return moved, labels[moved]


def told_before(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, lane: int, left_out: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of a bucket share a bucket of an earlier lane or choice of blocks too."""
    apart = x[rows, : lane + 1] ^ x[cols, : lane + 1]
    before = (np.bitwise_count(apart[:, :lane]) <= rule.near // rule.lanes).any(axis=1)
    for block in left_out.astype(x.dtype):
        before |= apart[:, lane] & block == 0
    return before


def partners(x: np.ndarray, lane: int, left_out: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each member of the bucket with all that are near, if they are FEW, or with the nearest; and the
    members of which not all partners were given. With such ones, a star per component is given too. A pair that
    shares an earlier bucket is left to that one: there it is given, or its two members are in a crowd."""
    left, right, crowd = [], [], []
    for rows, cols, apart in near_in_bucket(x, lane, rule):
        if not len(rows):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        degree = np.diff(np.append(cuts, len(rows)))
        every = np.repeat(degree <= FEW, degree)
        u, v = rows[every], cols[every]
        new = ~told_before(x, u, v, lane, left_out, rule)
        many = degree > FEW
        nearest = np.minimum.reduceat(apart * len(x) + cols, cuts) % len(x)
        left += [u[new], rows[cuts][many]]
        right += [v[new], nearest[many]]
        crowd.append(rows[cuts][many])
    none = np.empty(0, np.int64)
    crowd = np.concatenate([none, *crowd])
    if len(crowd):
        u, v = stars(x, lane, rule)
        left.append(u)
        right.append(v)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    both = np.unique(np.maximum(a, b) * len(x) + np.minimum(a, b))
    return both // len(x), both % len(x), crowd


#: What the tasks of the buckets return: pairs packed by part, or a fingerprint of a bucket too large.
FOUND = "part long, pairs binary, key long, u binary"


def bucket_links(batches: Iterator[pa.RecordBatch], rule: Rule, left_out: list[np.ndarray], most: int | None, parts: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v), v the smaller, within the buckets of one task, packed. Columns: keys and fingerprints, many to
    a row; ``left_out``: see :func:`skipped`. A bucket of over ``most`` fingerprints is handed back row by row with its key."""
    keys, prints = [], []
    for b in batches:
        keys += b.column(0).to_pylist()
        prints += b.column(1).to_pylist()
    if not keys:
        return
    key = np.frombuffer(b"".join(keys), "<i8")
    raw = np.frombuffer(b"".join(prints), np.uint8).reshape(len(key), -1)
    order = np.lexsort((np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel(), key))
    key, raw = key[order], raw[order]
    x = lanes_of(raw, rule)
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    sizes = np.diff(cuts)
    left, right, hot, crowd = [], [], [], [np.empty(0, np.int64)]
    for a, n in zip(cuts[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        if most and n > most:
            hot.append(np.arange(a, a + n))
            continue
        lane, choice = divmod(int(key[a]) % int(CHOICES), len(left_out))
        if rule.similarity is None:
            u, v = stars(x[a : a + n], lane, rule)
        else:
            u, v, some = partners(x[a : a + n], lane, left_out[choice], rule)
            crowd.append(some + a)
        left.append(u + a)
        right.append(v + a)
    many = np.unique(np.concatenate(crowd))  # told as pairs with themselves
    left.append(many)
    right.append(many)
    names = ["part", "pairs", "key", "u"]
    if left and len(u := np.concatenate(left)):
        pairs = unique_rows(np.concatenate([raw[u], raw[np.concatenate(right)]], axis=1))
        part = (mixed(lanes_of(pairs, rule)[:, 0].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        at, packs = packed(part, pairs)
        yield pa.RecordBatch.from_arrays([pa.array(at), *packs, pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary())], names=names)
    for ids in hot:
        yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary()), pa.array(key[ids]), pa.array([r.tobytes() for r in raw[ids]], pa.binary())], names=names)


def unique_rows(raw: np.ndarray) -> np.ndarray:
    """Distinct rows of bytes."""
    return raw[np.unique(np.ascontiguousarray(raw).view(f"S{raw.shape[1]}").ravel(), return_index=True)[1]]


def distinct_pairs(batches: Iterator[pa.RecordBatch], width: int, rule: Rule) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of one task, a row each. Of a member of a crowd (one that is told as a pair with itself)
    only the pairs with its NEAREST are to ``verify``. The others only tell which texts hang together: the
    member is linked to the least of its partners, and they to that one, which many members share."""
    raw = unique_rows(np.frombuffer(b"".join(x for b in batches for x in b.column(0).to_pylist()), np.uint8).reshape(-1, 2 * width))
    if not len(raw):
        return
    u, v = np.ascontiguousarray(raw[:, :width]), np.ascontiguousarray(raw[:, width:])
    apart = np.bitwise_count(lanes_of(u, rule) ^ lanes_of(v, rule)).sum(axis=1, dtype=np.int64)
    own = (u == v).all(1)
    who = np.cumsum(np.concatenate(([True], (u[1:] != u[:-1]).any(1)))) - 1  # pairs are in order of u
    crowd = np.zeros(who[-1] + 1, bool)
    crowd[who[own]] = True
    order = np.lexsort((apart, own, who))
    first = np.searchsorted(who[order], np.arange(who[-1] + 1))
    rank = np.empty(len(raw), np.int64)
    rank[order] = np.arange(len(raw)) - first[who[order]]
    verify = ~crowd[who] | (rank < NEAREST)
    rest = np.flatnonzero(~verify & ~own)
    least = np.searchsorted(who, who[rest])  # the first pair of a text is with the least
    hang = np.concatenate([raw[:0], np.concatenate([v[rest], v[least]], axis=1), raw[np.unique(least)]])
    hang = unique_rows(hang[(hang[:, :width] != hang[:, width:]).any(1)]) if len(hang) else hang
    for pairs, sure in ((raw[verify | own], True), (hang, False)):
        for at in range(0, len(pairs), CHUNK):
            part = pairs[at : at + CHUNK]
            columns = [pa.array([x.tobytes() for x in part[:, i : i + width]], pa.binary()) for i in (0, width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sure] * len(part))], names=["u", "v", "verify"])


def pack(key: np.ndarray, raw: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Keys and fingerprints by bucket, a row per bucket."""
    at, packs = packed(np.asarray(key.astype(np.uint64) // CHOICES % np.uint64(buckets), np.int64), key.astype("<i8"), raw)
    return pa.RecordBatch.from_arrays([pa.array(at), *packs], names=["bucket", "keys", "prints"])


def fingerprint_links(prints: DataFrame, rule: Rule, most: int = 20_000, rows_a_task: int = 1_000_000) -> DataFrame:
    return links_and_crowd(prints, rule, most, rows_a_task)[0]


def links_and_crowd(prints: DataFrame, rule: Rule, most: int = 20_000, rows_a_task: int = 1_000_000, room: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links (u, v, verify) among all fingerprints (one binary column, distinct). Without a ``similarity`` in the
    rule they connect all fingerprints that near ones connect; with one they are near pairs, to be verified where
    ``verify`` says so, and the second table (u) has the fingerprints, maybe repeated, of which not all near partners are among them.

    Each fingerprint goes to one bucket per lane and choice of blocks. A bucket sends on a star per
    component, or a few partners of each member, and never the pairs of a crowd. Buckets of over ``most`` distinct
    fingerprints are cut into parts, and every two parts meet in a task of their own.

    The more fingerprints, the more choices of blocks. With ``room`` they are gone through in rounds, each of
    which shuffles about so many bytes; its files are deleted before the next one.
    """
    spark = prints.sparkSession
    prints = prints.toDF("u")
    n = prints.count()
    m, c = blocks_for(n, rule.near // rule.lanes, rule.bits)
    masks = masks_for(m, c, rule.bits)
    salt = mixed(np.arange(1, len(masks) + 1, dtype=np.uint64))
    left_out = skipped(m, c, rule.bits)
    width = rule.bits * rule.lanes // 8 + (0 if rule.similarity is None else SUM)
    choices = np.arange(rule.lanes * len(masks))
    rounds = 1 if room is None else min(len(choices), max(1, -(-n * len(choices) * (8 + width) // room)))
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(at_least, -(-n * len(choices) // (8 * rows_a_task)))  # pairs are far fewer than the rows sent
    links, made_of = [], []

    def emit(batches: Iterator[pa.RecordBatch], some: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
        lane, pick = np.divmod(some, len(masks))
        step = max(1, 2 * PAIRS // len(some))
        for b in batches:
            for at in range(0, len(b), step):
                raw = np.frombuffer(b"".join(b.column(0).slice(at, step).to_pylist()), np.uint8).reshape(min(step, len(b) - at), -1)
                key = mixed((lanes_of(raw, rule)[:, lane].astype(np.uint64) & masks[pick]) ^ salt[pick])
                key = key // CHOICES * CHOICES + some.astype(np.uint64)
                yield pack(key.view(np.int64).ravel(), np.repeat(raw, len(some), axis=0), buckets)

    def meet(keyed: DataFrame, tasks: int, most: int | None) -> DataFrame:
        dealt = keyed.repartition(tasks, "bucket").select("keys", "prints")
        found = stored(dealt.mapInArrow(lambda bs: bucket_links(bs, rule, left_out, most, parts), FOUND), tidy=True)
        made_of.append(found)
        links.append(found.where("part IS NOT NULL").select("part", "pairs"))
        return found.where("key IS NOT NULL").select("key", "u")

    for some in np.array_split(choices, rounds):
        tasks = max(at_least, -(-n * len(some) // rows_a_task))
        spread = prints.repartition(max(1, -(-n * len(some) // rows_a_task))) if room else prints  # a few files would make a few large tasks
        hot = meet(spread.mapInArrow(lambda bs, some=some, tasks=tasks: emit(bs, some, 4 * tasks), "bucket long, keys binary, prints binary"), tasks, most)
        if not hot.limit(1).count():
            continue
        half = max(1, most // 2)
        cut = hot.groupBy("key").agg(F.ceil(F.count("*") / half).cast("int").alias("parts"))
        own = F.pmod(F.xxhash64("u", F.lit(7)), F.col("parts")).cast("int")
        choice = F.pmod("key", F.lit(int(CHOICES)))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.xxhash64("key", F.least(p, F.col("own")), F.greatest(p, F.col("own"))))
        dealt = hot.join(cut, "key").withColumn("own", own).select(F.explode(meets).alias("meet"), choice.alias("choice"), "u")
        dealt = dealt.select((F.col("meet") - F.pmod("meet", F.lit(int(CHOICES))) + F.col("choice")).alias("key"), "u")
        repack = lambda bs, tasks=tasks: (pack(b.column(0).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(len(b), -1), 4 * tasks) for b in bs if len(b))
        meet(dealt.mapInArrow(repack, "bucket long, keys binary, prints binary"), tasks, None)
    every = functools.reduce(DataFrame.unionByName, links)
    made = stored(every.repartition(parts, "part").select("pairs").mapInArrow(lambda bs: distinct_pairs(bs, width, rule), "u binary, v binary, verify boolean"), tidy=True)
    release(spark, *made_of)
    return made.where("u <> v"), made.where("u = v").select("u")


def contracted(links: DataFrame) -> DataFrame:
    """The same components with about one link a node: each node keeps its least centre, and its other
    centres, no more than the buckets that it is in, are linked to that one."""
    own = links.groupBy("u").agg(F.min("v").alias("low"), F.collect_set("v").alias("all"))
    far = own.select(F.explode("all").alias("u"), F.col("low").alias("v")).where("u <> v")
    return own.select("u", F.col("low").alias("v")).unionByName(far).distinct()


def simhash_query(docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """``op8_simhash``: doc_id, fingerprint and component_id of every document.

    Null and empty texts have fingerprint zero, linked like any other; a null doc_id is never a
    component_id unless no other id is reachable; repeated rows stay; an empty table gives no row.
    """
    rows = stored(with_fingerprints(docs.select("doc_id", "text"), rule).select("doc_id", "fingerprint"))
    classes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("low")))
    found = connected_components(contracted(fingerprint_links(classes.select("fingerprint"), rule)))
    roots = stored(classes.join(found, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "low", F.coalesce("root", "fingerprint").alias("root")))
    low = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(low, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def with_sets(texts: DataFrame, words: int) -> DataFrame:
    """``texts`` (node, text) -> node and the text's sorted distinct shingles, 4 bytes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1, BYTES):
                grams, sizes = shingle_sets(b.column(1), words)
                cuts = np.concatenate(([0], np.cumsum(sizes)))
                short = (grams >> np.uint64(32)).astype("<u4")  # still sorted
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([short[a:c].tobytes() for a, c in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["node", "grams"])

    return texts.mapInArrow(run, "node binary, grams binary")


def similar(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Of the rows u, v, one, two (their shingles) the u and v of Jaccard similarity ``least`` or more."""
    for batch in batches:
        ok = [alike(*(np.unique(np.frombuffer(z.as_py(), "<u4")) for z in (a, b)), least) for a, b in zip(batch.column(2), batch.column(3))]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    shared = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= least * max(len(x), len(y)) else 0
    return shared >= least * (len(x) + len(y) - shared) - 1e-9


def settle_crowds(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Links between members (meet, node, label, grams) that meet and have other labels: near, of the rule's
    similarity, and one of each two groups that it joins. Rows of a meeting stand together."""
    parts: dict[int, list[tuple[bytes, bytes, bytes]]] = {}

    def links_of(rows: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
        x = lanes_of(np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(len(rows), -1), rule)
        label = np.unique([r[1] for r in rows], return_inverse=True)[1]
        sets = [np.unique(np.frombuffer(r[2], "<u4")) for r in rows]
        for i in range(len(rows)):
            other = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
            apart = np.bitwise_count(x[other] ^ x[i]).sum(axis=1, dtype=np.int64)
            for j in other[np.argsort(apart, kind="stable")][: int((apart <= rule.near).sum())].tolist():
                if label[i] != label[j] and alike(sets[i], sets[j], rule.similarity):
                    label[label == label[j]] = label[i]
                    yield rows[i][0], rows[j][0]

    def settled(last: int | None) -> Iterator[pa.RecordBatch]:
        for key in [k for k in parts if k != last]:
            found = list(links_of(parts.pop(key)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=["u", "v"])

    for batch in batches:
        for meet, *row in zip(*(c.to_pylist() for c in batch.columns)):
            parts.setdefault(meet, []).append(tuple(row))
        yield from settled(meet if len(batch) else None)
    yield from settled(None)


def crowd_links(rows: DataFrame, row: str, nodes: DataFrame, pairs: DataFrame, crowd: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """The links that pairs of a crowd leave open: all members of a component of near pairs with a crowd in
    it are compared unless they are linked already.

    Members go to blocks of about CROWD, every two blocks meet in a task, and only links come back. A label
    (what is linked already) of CROWD members or more has blocks of its own, which never meet each other: a
    crowd that is all one label but for r members costs r times its blocks, not its square.
    """
    near = connected_components(contracted(pairs)).withColumnRenamed("node", "member")
    open_ = near.join(crowd.distinct(), F.col("member") == F.col("u"), "left_semi").select(F.col("root").alias("open")).distinct()
    named = near.join(open_, F.col("root") == F.col("open"), "left_semi").withColumnRenamed("root", "crowd")
    labelled = stored(named.join(found.withColumnRenamed("member", "m"), F.col("member") == F.col("m"), "left").select("crowd", "member", F.coalesce("root", "member").alias("label")))
    by_label = labelled.groupBy("crowd", "label").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= CROWD, F.col("label"))  # null: the small labels of a crowd, mixed
    by_crowd = Window.partitionBy("crowd")
    sized = by_label.groupBy("crowd", own.alias("own")).agg(F.sum("n").alias("n"), F.count("*").alias("labels")).withColumn("all", F.sum("labels").over(by_crowd)).where(F.col("all") > 1)
    sized = sized.withColumn("parts", F.ceil(F.col("n") / CROWD).cast("int"))
    plan = stored(sized.withColumns({"blocks": F.sum("parts").over(by_crowd).cast("int"), "first": (F.sum("parts").over(by_crowd.orderBy(F.col("own").asc_nulls_first())) - F.col("parts")).cast("int")}).select("crowd", "own", "parts", "blocks", "first"))
    large = by_label.where(F.col("n") >= CROWD).select(F.col("crowd").alias("c"), F.col("label").alias("large"))
    marked = labelled.join(large, (F.col("crowd") == F.col("c")) & (F.col("label") == F.col("large")), "left").drop("c")
    block = (F.col("first") + F.pmod(F.xxhash64("member", F.lit(11)), F.col("parts"))).cast("int")
    at = plan.withColumnRenamed("crowd", "c")
    placed = marked.join(at, (F.col("crowd") == F.col("c")) & F.col("large").eqNullSafe(F.col("own"))).withColumn("block", block)
    placed = stored(placed.join(nodes, F.col("member") == F.col("node")).select("crowd", "member", "label", "own", "parts", "blocks", "first", "block", "row"))
    texts = rows.join(bounded(placed.select(F.col("member").alias("node_"), F.col("row").alias("place_"))), F.col(row) == F.col("place_")).select(F.col("node_").alias("node"), "text")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("own").isNull() | (b < F.col("first")) | (b >= F.col("first") + F.col("parts")))
    meets = F.transform(others, lambda b: F.xxhash64("crowd", F.least(b, F.col("block")), F.greatest(b, F.col("block"))))
    dealt = placed.join(with_sets(texts, rule.words).withColumnRenamed("node", "n"), F.col("member") == F.col("n")).select(F.explode(meets).alias("meet"), "member", "label", "grams")
    return dealt.repartition("meet").sortWithinPartitions("meet").mapInArrow(lambda bs: settle_crowds(bs, rule), "u binary, v binary")


def drop_near_duplicates(docs: DataFrame, rule: Rule = STAGE) -> DataFrame:
    """``docs`` with one row of each group of linked documents: that of the smallest doc_id (null
    last), of equal ids the first stored. Texts are stored once with their fingerprints and row
    numbers, so a repeated row is still a row of its own. Texts of one set of shingles are one node;
    near nodes link if the sets of shingles have the rule's similarity. Null and empty texts are one
    group. All columns are kept.
    """
    mark, row = fresh(docs, "fingerprint_", "row_")
    rows = stored(with_fingerprints(docs, rule, mark).withColumn(row, F.monotonically_increasing_id()))
    slim = rows.select(F.col(mark).alias("node"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(row).alias("row")).alias("who"))
    nodes = stored(slim.groupBy("node").agg(F.min("who.row").alias("row")))
    every, crowd = links_and_crowd(nodes.select("node"), rule, room=max(ROOM, stored_bytes(rows)))
    pairs = every.where("verify")
    ends = stored(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct().join(nodes, "node"))
    texts = rows.join(bounded(ends.select(F.col("node").alias("node_"), F.col("row").alias("place_"))), F.col(row) == F.col("place_")).select(F.col("node_").alias("node"), "text")
    sets = stored(with_sets(texts, rule.words), tidy=True)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("one")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("two")), "v")
    links = both.select("u", "v", "one", "two").mapInArrow(lambda bs: similar(bs, rule.similarity), "u binary, v binary")
    links = stored(links, tidy=True)
    release(docs.sparkSession, sets)
    found = connected_components(links).withColumnRenamed("node", "member")
    if crowd.limit(1).count():
        more = crowd_links(rows, row, nodes, every.select("u", "v"), crowd, found, rule)
        found = connected_components(links.unionByName(more)).withColumnRenamed("node", "member")
    members = stored(slim.join(found, F.col("node") == F.col("member"), "left").select(F.coalesce("root", "node").alias("root"), "who"))
    keepers = members.groupBy("root").agg(F.min("who").alias("kept"), F.count("*").alias("n")).where("n > 1")
    gone = stored(members.join(keepers, "root").where("who.row <> kept.row").select(F.col("who.row").alias("gone_")))
    return rows.join(bounded(gone), rows[row] == gone["gone_"], "left_anti").select(*docs.columns)
