"""Words of Arrow text columns and their hashes, whole columns at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``most_bytes``; a longer text is a part of its own. After the last one, memory
    that Arrow holds unused goes back, as workers live on and are shared by later stages."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, room = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and room + n > most_bytes:
            yield batch.slice(at, i - at)
            at, room = i, 0
        room += n
    if len(sizes) > at:
        yield batch.slice(at)
    pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, number of words of each text); words are cut at ASCII white space only."""
    trimmed = pc.ascii_trim_whitespace(pc.cast(texts, pa.large_string()))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.large_string()), trimmed))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), lengths


def numbered(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, number of each word among them)."""
    coded = words.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def hash_words(distinct: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word, (n, 2)."""
    from xxhash import xxh3_128_digest

    distinct = distinct.cast(pa.large_binary())
    if not len(distinct):
        return np.empty((0, 2), np.uint64)
    _, places, data = distinct.buffers()
    at = np.frombuffer(places, np.int64)[distinct.offset : distinct.offset + len(distinct) + 1].tolist()
    line = data.to_pybytes() if data is not None else b""  # words cut from it here: one by one through Arrow takes three times as long
    return np.frombuffer(b"".join([xxh3_128_digest(line[a:b]) for a, b in zip(at, at[1:])]), dtype="<u8").reshape(-1, 2)


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased A-Z. The copy is needed: on part of a longer array the kernel reads wrong bytes."""
    return pc.ascii_lower(pc.cast(texts, pa.large_string()).take(pa.array(np.arange(len(texts)))))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, as many as were asked for."""

    base: np.uint64
    up: np.ndarray
    down: np.ndarray


_powers: dict[int, Powers] = {}


def powers(which: int, n: int) -> Powers:
    have = _powers.get(which)
    if have is None or len(have.up) < n:
        base = int(BASES[which])
        inverse = pow(base, -1, 1 << 64)
        line = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))))
        have = _powers[which] = Powers(BASES[which], line(np.uint64(base)), line(np.uint64(inverse)))
    return have


def runs(hashes: np.ndarray, which: int, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` words, from the words' hashes."""
    n = len(hashes)
    if n < length:
        return np.empty(0, np.uint64)
    p = powers(which, n)
    total = np.concatenate(([np.uint64(0)], np.cumsum(hashes * p.up[:n])))
    return mixed((total[length:] - total[:-length]) * p.down[: n - length + 1])


def packed(bucket: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """(buckets in order, the bytes of each column by bucket)."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")  # short keys sort by radix
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(1, np.int64)
    return bucket[cuts[:-1]], [pa.array([x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()) for x in (c[order] for c in columns)]
