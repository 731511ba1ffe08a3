"""LM scoring: an attention model over subword ids next to a unigram base, for every document.

The unigram base counts every word of every training document exactly. Words that are frequent in a
bounded sample are counted by number, all others by a 64-bit hash through a shuffle, so no vocabulary
is gathered in one place. The attention model starts from the same sample, on the driver, and is then
trained in Spark tasks over every whole training text: a few rounds, each over its own part of the
texts, after each of which Spark averages the tasks' weights. A word's probability under the model is
a mixture: the attention model's for its subword ids in their context, and the word's share of the
whole training text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import stored
from .mixing import uniform
from .words import hash_words, lowered, numbered, packed, slices, split_words

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Pieces as the vocabulary was made for: contractions, letters, digits, others, spaces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Bounds of the start: documents of the sample and words of one. Units of the model. Words counted by
#: number; which they are changes no result.
SAMPLE_DOCS, SAMPLE_WORDS, UNITS, FREQUENT = 4000, 600, 1024, 50_000
REST, END = 0, 1
#: Passes over parts of the training texts, together one over all; the first one's rate, which falls
#: in equal steps; weights of a row on their way to the sum.
ROUNDS, RATE, CHUNK = 2, 2e-3, 8192
#: Bytes of texts that one copy of the model is trained on in a round, and the share of the sample that is
#: learned in the last round only, so that the mixture can be fitted on it before.
PART_BYTES, TUNING = 24_000_000, 0.1
#: Words that one task settles, about 40 bytes each.
WORDS_A_TASK = 1_000_000


@lru_cache(1)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    opens = np.zeros(max(ranks.values()) + 1, bool)
    for token, i in ranks.items():
        opens[i] = token[:1] == b" "
    return tiktoken.Encoding("words", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), opens


def word_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(subword ids of all words in order, number of ids of each word); a word begins with a space."""
    encoding, opens = tokenizer(path)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    line = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(" ", words.type))[0].as_py()
    ids = np.array(encoding.encode_ordinary(" " + line), np.int64)
    cuts = np.flatnonzero(opens[ids])
    if len(cuts) == len(words) and cuts[0] == 0:
        return ids, np.diff(np.concatenate((cuts, [len(ids)])))
    each = [encoding.encode_ordinary(" " + w) for w in words.to_pylist()]  # odd white space inside words
    return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)


def picked(flat: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that ``which`` names, end to end, and their lengths."""
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    n = lengths[which]
    before = np.cumsum(n) - n
    return flat[np.repeat(first[which] - before, n) + np.arange(int(n.sum()))], n


@dataclass
class Scorer:
    """What every task needs; its size depends on the bounds above, not on the input."""

    path: str
    model: attention.Model
    unit_of: np.ndarray  # of each subword id; last: of the end
    rest_log10: np.ndarray  # log10 share of each subword id within its unit; last: of the end
    frequent: list[str]
    log_count: np.ndarray | None = None  # log10(c + 0.5) of the frequent words
    known: np.ndarray | None = None  # c > 0
    log_share: np.ndarray | None = None  # log10 of c over all training tokens; last: of the end
    mix: float = 0.0  # weight of the words' shares
    earlier: attention.Model | None = None  # before the last round


def sample_words(sample: list[str], tuning: list[str]) -> tuple[list[str], list[str]]:
    """(frequent words of the sample, other words of its tuning texts)."""
    distinct, number = numbered(split_words(lowered(pa.array(sample, pa.string())))[0])
    text = distinct.to_pylist()
    count = np.bincount(number, minlength=len(text)) if len(text) else np.empty(0, np.int64)
    frequent = [text[i] for i in np.lexsort((np.arange(len(text)), -count))[:FREQUENT] if count[i] > 1]
    tried = numbered(split_words(lowered(pa.array(tuning, pa.string())))[0])[0].to_pylist()
    return frequent, sorted(set(tried) - set(frequent))


def fit_scorer(sample: list[str], path: str, frequent: list[str], seen: np.ndarray, texts: int, seed: int = 20240504, steps: int = 1500) -> Scorer:
    """The start of the model. ``seen``: count of each subword id in all ``texts`` training texts."""
    vocabulary = len(seen)
    top = np.lexsort((np.arange(vocabulary), -seen))[: UNITS - 2]
    unit_of = np.full(vocabulary + 1, REST)
    unit_of[top] = np.arange(2, 2 + len(top))
    unit_of[-1] = END
    rest = unit_of == REST
    log10 = np.zeros(vocabulary + 1)
    share = np.append(seen, 0)[rest] + 0.5
    log10[rest] = np.log10(share / share.sum())
    rng = np.random.default_rng(seed)
    counts = np.bincount(unit_of, np.append(seen, texts), UNITS).astype(float)
    scorer = Scorer(path, attention.Model.fresh(counts, rng), unit_of, log10, frequent)
    if len(sample):
        attention.train(scorer.model, *text_units(scorer, pa.array(sample, pa.string())), rng, steps)
    return scorer


def text_units(scorer: Scorer, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(units of the texts end to end, units of each text)."""
    words, lengths = split_words(lowered(texts))
    distinct, number = numbered(words)
    flat, n = word_ids(distinct, scorer.path)
    ids, sizes, _ = id_sequences(flat, n, number, lengths, len(scorer.unit_of) - 1)
    return scorer.unit_of[ids], sizes


def learn_texts(batches: Iterator[pa.RecordBatch], sent, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    """Trains a copy of the model over all texts of one partition: its weights times the units seen."""
    scorer = sent.value
    model = attention.Model(scorer.model.units, {k: x.copy() for k, x in scorer.model.p.items()})
    adam, rng, n = attention.Adam(model), np.random.default_rng(seed), 0
    for batch in batches:
        for part in slices(batch, 0, 2_000_000):
            units, sizes = text_units(scorer, part.column(0))
            attention.train_once(model, adam, units, sizes, rng, rate)
            n += len(units)
    if n:
        line = flat_weights(model) * n
        cuts = range(0, len(line), CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts)), pa.int32()), pa.array([float(n)] * len(cuts)), pa.array([line[a : a + CHUNK] for a in cuts], pa.list_(pa.float64()))], names=["chunk", "n", "line"])


def sum_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each chunk."""
    sums: dict[int, list] = {}
    for b in batches:
        for i, k in enumerate(b.column(0).to_pylist()):
            line, n = b.column(2)[i].values.to_numpy(), b.column(1)[i].as_py()
            old = sums.get(k)
            sums[k] = [n, line.copy()] if old is None else [old[0] + n, old[1] + line]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()]), pa.array([x[1] for x in sums.values()], pa.list_(pa.float64()))], names=["chunk", "n", "line"])


def flat_weights(model: attention.Model) -> np.ndarray:
    return np.concatenate([model.p[k].ravel() for k in sorted(model.p)]).astype(np.float64)


def learn_all(scorer: Scorer, learn: DataFrame) -> int:
    """Trains the model over every text of ``learn`` (text, key, draw), whole and once; returns the units seen. Texts are dealt by their key into parts of about PART_BYTES and put in its order, so the result
    depends neither on the splits nor on the order of the rows."""
    size = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (ROUNDS * PART_BYTES)))
    spark, total = learn.sparkSession, 0
    kind = "chunk int, n double, line array<double>"
    for k in range(ROUNDS):
        if k == ROUNDS - 1:
            scorer.earlier = attention.Model(scorer.model.units, {name: x.copy() for name, x in scorer.model.p.items()})
        sent, rate = spark.sparkContext.broadcast(scorer), RATE * (1 - k / ROUNDS)
        part = learn.where(F.floor(F.col("draw") * ROUNDS) == k).select("text", "key").repartition(parts, "key").sortWithinPartitions("key", "text")
        made = part.select("text").mapInArrow(lambda bs: learn_texts(bs, sent, rate, k), kind)
        sums = made.repartition("chunk").mapInArrow(sum_weights, kind).collect()  # a row per CHUNK weights
        sent.unpersist()
        if not sums:
            continue
        line = np.concatenate([np.array(r["line"]) / r["n"] for r in sorted(sums, key=lambda r: r["chunk"])])
        total, at = total + int(sums[0]["n"]), 0
        for key in sorted(scorer.model.p):
            old = scorer.model.p[key]
            scorer.model.p[key] = line[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
    return total


def id_sequences(ids: np.ndarray, n: np.ndarray, number: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of each text: its words' in order and then ``end``; ids of each text; ids of each word,
    the ends as words). ids, n: of the distinct words."""
    ids, n = np.concatenate((ids, [end])).astype(np.int64), np.concatenate((n, [1])).astype(np.int64)
    line, each = picked(ids, n, np.insert(number, np.cumsum(lengths), len(n) - 1))
    ends = np.cumsum(lengths + 1)
    total = np.concatenate(([0], np.cumsum(each)))
    return line, total[ends] - total[ends - lengths - 1], each


def word_logs(scorer: Scorer, flat: np.ndarray, n: np.ndarray, number: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each word (and end) under the attention model, given all before it."""
    ids, sizes, each = id_sequences(flat, n, number, lengths, len(scorer.unit_of) - 1)
    logs = scorer.model.log10_probability(scorer.unit_of[ids], sizes) + scorer.rest_log10[ids]
    return np.add.reduceat(logs, np.cumsum(each) - each) if len(each) else np.zeros(0)


def mixed_logs(scorer: Scorer, logs: np.ndarray, number: np.ndarray, lengths: np.ndarray, mix: float) -> np.ndarray:
    """Word by word mixture of ``logs`` with the shares of frequent words (number below their count);
    of other words only the attention model's part, to which their counts add the rest later."""
    if mix <= 0:
        return logs
    with_end = np.insert(number, np.cumsum(lengths), -1)
    known = with_end < len(scorer.frequent)
    out = logs + np.float32(np.log10(1 - mix))
    share = np.power(10.0, scorer.log_share + np.log10(mix)).astype(np.float32)
    out[known] = np.log10(np.exp(out[known] * np.float32(np.log(10))) + share[with_end[known]])
    return out


def fit_mix(scorer: Scorer, tuning: list[str], count: dict[str, int], texts: int, train_tokens: int) -> float:
    """Weight of the words' shares, by a few rounds of expectation and maximisation over ``tuning``,
    training texts that the attention model before its last round hasn't seen; each is left out of the counts that it is tried on."""
    words, lengths = split_words(lowered(pa.array(tuning, pa.string())))
    distinct, number = numbered(words)
    if not len(lengths) or train_tokens < 2:
        return 0.0
    text = distinct.to_pylist()
    before = replace(scorer, model=scorer.earlier or scorer.model)
    logs = word_logs(before, *word_ids(distinct, scorer.path), number, lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    _, back, own = np.unique(owner * max(1, len(text)) + number, return_inverse=True, return_counts=True)
    c = np.array([count.get(w, 0) for w in text], np.float64)[number] - own[back] if len(text) else np.zeros(0)
    c = np.insert(c, np.cumsum(lengths), texts - 1)
    left = np.maximum(1, train_tokens - np.repeat(lengths + 1, lengths + 1))
    apart = np.clip(np.log10(np.maximum(c, 1e-300) / left) - logs, -300, 300)
    mix = 0.5
    for _ in range(20):
        odds = 10.0 ** np.clip(apart + np.log10(mix / (1 - mix)), -300, 300)
        mix = float(min(0.99, max(0.01, (odds / (1 + odds)).mean())))
    return mix


def count_words(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Counts of the named words in one partition; -1: all words, -2: texts, -3 and less: subword ids."""
    named, path = sent.value
    names = pa.array(named, pa.large_string())
    n_flat, n_n = word_ids(names, path)
    ids = np.zeros(len(tokenizer(path)[1]), np.int64)
    sums, words_seen, texts = np.zeros(len(names), np.int64), 0, 0
    for batch in batches:
        for part in slices(batch, 0):
            words, lengths = split_words(lowered(part.column(0)))
            distinct, number = numbered(words)
            texts, words_seen = texts + len(part), words_seen + len(number)
            where = pc.fill_null(pc.index_in(distinct, names), -1).to_numpy(zero_copy_only=False)
            n = np.bincount(number, minlength=len(where))
            sums[where[where >= 0]] += n[where >= 0]
            other = np.flatnonzero(where < 0)
            flat, each = word_ids(distinct.take(pa.array(other)), path)
            np.add.at(ids, flat, np.repeat(n[other], each))
    np.add.at(ids, n_flat, np.repeat(sums, n_n))
    some, used = np.flatnonzero(sums), np.flatnonzero(ids)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], some, -3 - used)).astype(np.int32)), pa.array(np.concatenate(([words_seen, texts], sums[some], ids[used])))], names=["word", "n"])


def score_texts(batches: Iterator[pa.RecordBatch], sent, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the rows row, doc_id, held_out, text: one row per document with the model's score, tokens and
    the frequent words' part of the base; and rows of packed other words by bucket of their hash: hash,
    document (row and whether held out) and the attention model's log10 of each."""
    scorer = sent.value
    names = pa.array(scorer.frequent, pa.large_string())
    f_flat, f_n = word_ids(names, scorer.path)
    for batch in batches:
        for part in slices(batch, 3, 2_000_000):
            words, lengths = split_words(lowered(part.column(3)))
            distinct, number = numbered(words)
            where = pc.fill_null(pc.index_in(distinct, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            other = np.flatnonzero(where < 0)
            rare = distinct.take(pa.array(other))
            r_flat, r_n = word_ids(rare, scorer.path)
            where[other] = len(f_n) + np.arange(len(other))
            flat, n = np.concatenate((f_flat, r_flat)), np.concatenate((f_n, r_n))
            number = where[number] if len(number) else number.astype(np.int64)
            plain = word_logs(scorer, flat, n, number, lengths)
            logs = mixed_logs(scorer, plain, number, lengths, scorer.mix)
            logs = np.add.reduceat(logs, np.cumsum(lengths + 1) - lengths - 1, dtype=np.float64)
            owner = np.repeat(np.arange(len(part)), lengths)
            known = number < len(f_n)
            base = np.bincount(owner[known], scorer.log_count[number[known]], len(part))
            seen = np.bincount(owner[known], scorer.known[number[known]], len(part)).astype(np.int64)
            who = part.column(0).to_numpy(zero_copy_only=False) * 2 + part.column(2).to_numpy(zero_copy_only=False)
            hashes = hash_words(rare)[:, 0][number[~known] - len(f_n)] if len(other) else np.empty(0, np.uint64)
            left = np.delete(plain, np.cumsum(lengths + 1) - 1)[~known]
            others = np.bincount(owner[~known], minlength=len(part)).astype(np.int64)
            bucket, packs = packed((hashes % np.uint64(buckets)).astype(np.int64), hashes, who[owner[~known]], left.astype("<f4"))
            none = lambda k, *kinds: [pa.nulls(k, x) for x in kinds]
            names_out = ["row", "doc_id", "held_out", "n_tokens", "score", "base", "seen", "others", "bucket", "hash", "who", "log"]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lengths + 1), pa.array(logs, pa.float64()), pa.array(base, pa.float64()), pa.array(seen), pa.array(others), *none(len(part), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=names_out)
            k = len(bucket)
            yield pa.RecordBatch.from_arrays([*none(k, pa.int64(), part.column(1).type, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()), pa.array(bucket, pa.int64()), *packs], names=names_out)


def settle_words(batches: Iterator[pa.RecordBatch], odds: float, blocks: int) -> Iterator[pa.RecordBatch]:
    """Counts the words of this task's buckets over the training documents, and sums over each document
    what its words add: to the base, to the known words and to the score. Packed by block of documents;
    ``kinds``: words counted."""
    held: list[list[bytes]] = [[], [], []]
    for batch in batches:
        for have, column in zip(held, batch.columns):
            have += column.to_pylist()
    word, who, log = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<u8", "<i8", "<f4")))
    if not len(word):
        return
    _, back = np.unique(word, return_inverse=True)
    c = np.bincount(back, who & 1 == 0)
    kinds, c = int((c > 0).sum()), c[back]
    # The mixture has 1 + odds times the attention model's part.
    apart = odds + np.log10(np.maximum(c, 1e-300)) - log
    gain = np.where(apart > 15, apart, np.log1p(np.power(10.0, np.minimum(apart, 15))) / np.log(10))
    row, own = np.unique(who >> 1, return_inverse=True)
    sums = [np.bincount(own, x, len(row)) for x in (np.where(c > 0, np.log10(c + 0.5), 0), c > 0, np.where(c > 0, gain, 0))]
    block, packs = packed(row % blocks, row, *sums)
    yield pa.RecordBatch.from_arrays([pa.array(block), *packs, pa.array([kinds] + [0] * (len(block) - 1), pa.int64())], names=["block", "rows", "base", "hits", "gain", "kinds"])


def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each document over all tasks that had words of it."""
    held: list[list[bytes]] = [[], [], [], []]
    for batch in batches:
        for have, column in zip(held, batch.columns):
            have += column.to_pylist()
    row, *sums = (np.frombuffer(b"".join(x), t) for x, t in zip(held, ("<i8", "<f8", "<f8", "<f8")))
    row, own = np.unique(row, return_inverse=True)
    base, hits, gain = (np.bincount(own, x, len(row)) for x in sums)
    yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(base, pa.float64()), pa.array(hits.astype(np.int64)), pa.array(gain, pa.float64())], names=["row", "logs", "hits", "gain"])


def score_documents(docs: DataFrame, out: Column, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out (``out``), n_tokens, n_known, train_tokens, base_score and score of every row.

    Texts are lower-cased (A-Z); tokens are words, then one end. Null and empty texts are their end
    alone; repeated rows are scored and counted like others; with nothing to learn from, counts are
    zero and the model is as it starts; an empty table gives no row; other columns are ignored. The
    model's probability is that of the words' subword ids, begun by a space each, and of the end.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    learn = rows.where("NOT held_out").select("doc_id", "text")
    draw = uniform(F.xxhash64(F.lit(20240504), "doc_id", "text"))
    place = uniform(F.xxhash64(F.lit(20240505), "doc_id", "text"))
    split = F.split("text", r"[\x20\x09-\x0D]+")
    start = F.floor(place * F.greatest(F.size(split) - SAMPLE_WORDS, F.lit(0))).cast("int") + 1
    piece = F.array_join(F.slice(split, start, SAMPLE_WORDS), " ")  # of the sample only
    taken = min(1.0, 1.2 * SAMPLE_DOCS / max(1, learn.count()))
    drawn = learn.withColumn("draw", draw).where(F.col("draw") < F.lit(taken))
    drawn = [(r[0], r[1] < TUNING * taken) for r in drawn.select(piece.alias("piece"), "draw").orderBy("draw", "piece").limit(SAMPLE_DOCS).collect()]
    sample, tuning = [p for p, tunes in drawn if not tunes], [p for p, tunes in drawn if tunes]
    frequent, more = sample_words([p for p, _ in drawn], tuning)
    sent = spark.sparkContext.broadcast((frequent + more, path))
    counts = {r["word"]: r["n"] for r in learn.select("text").mapInArrow(lambda bs: count_words(bs, sent), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row per named word and subword id
    sent.unpersist()
    texts, words = counts.get(-2, 0), counts.get(-1, 0)
    train_tokens = words + texts
    scorer = fit_scorer(sample, path, frequent, np.array([counts.get(-3 - i, 0) for i in range(len(tokenizer(path)[1]))], np.int64), texts)
    turn = F.when(draw < F.lit(TUNING * taken), F.lit(1 - 1e-9)).otherwise(uniform(F.xxhash64(F.lit(20240505), "doc_id", F.length("text"))))
    learn_all(scorer, learn.select("text", F.xxhash64("doc_id", "text").alias("key"), turn.alias("draw")))
    scorer.earlier, before = None, scorer.earlier
    c = np.array([counts.get(i, 0) for i in range(len(frequent))], np.float64)
    scorer.log_count, scorer.known = np.log10(c + 0.5), (c > 0).astype(np.float64)
    scorer.log_share = np.log10(np.maximum(np.concatenate((c, [texts])), 1e-9) / max(1, train_tokens))
    scorer.mix = fit_mix(replace(scorer, earlier=before), tuning, {w: counts.get(i, 0) for i, w in enumerate(frequent + more)}, texts, train_tokens)
    ready = spark.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * max(0, words - int(c.sum())) // WORDS_A_TASK))
    buckets = 4 * tasks
    marked = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = stored(marked.mapInArrow(
        lambda bs: score_texts(bs, ready, buckets),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, score double, base double, seen long, others long, bucket long, hash binary, who binary, log binary",
    ))
    odds = float(np.log10(scorer.mix / (1 - scorer.mix) / max(1, train_tokens))) if scorer.mix > 0 else -1e6
    packs = scored.where("bucket IS NOT NULL").select("bucket", "hash", "who", "log").repartition(tasks, "bucket").select("hash", "who", "log")
    settled = stored(packs.mapInArrow(lambda bs: settle_words(bs, odds, buckets), "block long, rows binary, base binary, hits binary, gain binary, kinds long"))
    distinct = int((c > 0).sum()) + (texts > 0) + (settled.agg(F.sum("kinds")).first()[0] or 0)
    sums = settled.repartition(tasks, "block").select("rows", "base", "hits", "gain").mapInArrow(sum_rows, "row long, logs double, hits long, gain double")
    full = scored.where("bucket IS NULL").join(sums, "row", "left")
    hits = F.coalesce("hits", F.lit(0))
    scale = float(np.log10(max(1e-300, train_tokens + 0.5 * (distinct + 1))))
    half, end = float(np.log10(0.5)), float(np.log10(texts + 0.5))
    # A word without a count has log10(0.5): every other word, less those found.
    base = F.col("base") + F.coalesce("logs", F.lit(0.0)) + (F.col("others") - hits) * half + F.lit(end) - F.col("n_tokens") * scale
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + hits + F.lit(int(texts > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )


def scoring_query(docs: DataFrame) -> DataFrame:
    """``op4_scoring``: documents whose crc32(doc_id as text) mod 5 is 1 are held out."""
    return score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
