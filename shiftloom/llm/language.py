"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh
from .mixing import uniform

#: The fit's bounds: pieces of labelled documents per language, code points of a piece, pieces in all,
#: fewest pieces of a language. Of more than ALL_PIECES / FEWEST labels the most frequent are learned.
PIECES, PIECE, ALL_PIECES, FEWEST = 96, 256, 6144, 4
SEGMENT, OPENING = 256, 32
#: Symbols from which on a text is long enough to tell whether it is of any language learned.
TELLING = 128


def labelled_sample(docs: DataFrame, train: Column, seed: int = 20240509, pieces: int = PIECES, piece: int = PIECE, every: int = ALL_PIECES) -> dict[str, str]:
    """A bounded sample of labelled text by language: ``pieces`` pieces of ``piece`` characters each
    (fewer, if the labels are so many that they come to over ``every``), cut at a random place out of
    documents drawn by hash."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.col("doc_id"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(every // FEWEST)
    share = uniform(F.xxhash64(F.lit(seed), "doc_id", "text"))
    cut = F.floor(uniform(F.xxhash64(F.lit(seed + 1), "doc_id", "text")) * F.greatest(F.length("text") - piece, F.lit(0))).cast("int")
    pieces = max(FEWEST, min(pieces, every // max(1, sizes.count())))
    few = (
        known.join(F.broadcast(sizes), "lang")
        .withColumn("share", share)
        .where(F.col("share") * F.col("n") < 4 * pieces)  # leaves about 4 * pieces rows of a language
        .select("lang", "share", F.substring("text", cut + 1, F.lit(piece)).alias("piece"))
        .withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("share", "piece")))
        .where(F.col("k") <= pieces)
    )
    out: dict[str, list[str]] = {}
    for r in few.orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["piece"])
    return {k: " ".join(v) for k, v in sorted(out.items())}


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``symbols``; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


def packed_automaton(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, target, start) of the transitions in one array: those of a state lie at its own number plus
    the symbol, where ``owner`` has its number. States are placed where their symbols find free places,
    those of most symbols first, so the array is about as long as there are transitions."""
    room = 2 * sum(map(len, moves)) + 2 * width + len(moves) + 2
    owner, after = np.full(room, -1, np.int32), list(range(room + 1))
    at: list[int] = [0] * len(moves)
    taken: set[int] = set()

    def free(i: int) -> int:
        first = i
        while after[i] != i:
            i = after[i]
        while after[first] != i:
            after[first], first = i, after[first]
        return i

    low, n = 0, -1
    for state in sorted(range(len(moves)), key=lambda i: -len(moves[i])):
        symbols = sorted(moves[state]) or [0]
        if len(moves[state]) != n:
            low, n = 0, len(moves[state])
        f = free(max(low, symbols[0]))
        while (b := f - symbols[0]) in taken or any(after[b + c] != b + c for c in symbols[1:]):
            f = free(f + 1)
        low = f
        at[state] = b
        taken.add(b)
        for c in moves[state]:
            owner[b + c] = b
            after[b + c] = b + c + 1
    target = np.zeros(room, np.int32)
    for state, go in enumerate(moves):
        for c, to in go.items():
            target[at[state] + c] = at[to]
    length = max(at) + width + 1
    return owner[:length], target[:length], at[0]


class Parser:
    """Cross-parsing of texts against every language at once.

    Letters are lower-cased; any run of other characters is one separator. A text is cut into the
    longest phrases that occur in the language's sample, from left to right; a letter that the sample
    lacks is a phrase by itself. Texts are parsed side by side in segments of SEGMENT symbols, all of
    them; a segment whose predecessor turns out to end within a phrase is parsed again from there, until
    every segment starts as its predecessor ends, so phrases go on over segments. Memory grows with the
    transitions, not with states times letters.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.names = [k for k, _ in samples]
        lowered = [code_points(t.lower()) for _, t in samples]
        seen = np.unique(np.concatenate([x[letters()[x]] for x in lowered])) if lowered else np.empty(0, np.uint32)
        #: 0: a letter that no sample has, 1: separator, then the letters
        self.width = len(seen) + 2
        self.code = np.where(letters(), 0, 1).astype(np.uint16 if self.width < 1 << 16 else np.uint32)
        self.code[seen] = np.arange(2, len(seen) + 2)
        owners, targets, starts, self.bits, base = [], [], [], [], 0
        #: Twice the state after a phrase's first symbol, and one more if the sample lacks it.
        self.first = np.zeros((len(samples), self.width), np.int32)
        for k, x in enumerate(lowered):
            symbols = self.symbols(x)
            moves = suffix_automaton(symbols.tolist())
            owner, target, start = packed_automaton(moves, self.width)
            known = list(moves[0])
            self.first[k] = 2 * (start + base) + 1
            self.first[k, known] = 2 * (target[start + np.array(known, np.int64)] + base)
            owners.append(np.where(owner < 0, -1, owner + base))
            targets.append(target + base)
            starts.append(start + base)
            self.bits.append(np.log2(max(2, len(symbols))))
            base += len(owner)
        #: The state that a transition belongs to, above the one that it leads to.
        self.moves = np.concatenate(owners).astype(np.int64) << 32 | np.concatenate(targets) if owners else np.empty(0, np.int64)
        self.starts = np.array(starts, np.int32)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.moves, self.first))

    def symbols(self, points: np.ndarray) -> np.ndarray:
        s = self.code[points]
        gap = s == 1
        return s[~(gap & np.concatenate(([False], gap[:-1])))]

    def parse(self, grid: np.ndarray, sizes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrases ended, last state) of each segment from its first state; segments by falling size."""
        count, state = np.zeros(state.shape, np.int32), state.copy()
        start, first = self.starts[:, None], self.first.ravel()
        offset = (np.arange(len(self.names), dtype=np.int32) * self.width)[:, None]
        for line, k in zip(grid, np.searchsorted(-sizes, -np.arange(len(grid))).tolist()):
            if not k:
                break
            line, now = line[:k], state[:, :k]
            move = self.moves.take(now + line, mode="clip")
            missed = move >> 32 != now
            anew = first.take(line + offset, mode="clip")
            to = move.astype(np.int32)  # the lower half
            np.copyto(to, anew >> 1, where=missed)
            anew &= 1
            anew += now != start
            anew *= missed
            count[:, :k] += anew
            state[:, :k] = to
        return count, state

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): bits of the normalised phrases per symbol."""
        lengths = np.array([len(t) for t in texts])
        pieces = -(-lengths // SEGMENT)
        total = int(pieces.sum())
        flat = np.zeros(total * SEGMENT, np.int32)
        ends = np.cumsum(pieces)
        for t, a in zip(texts, ((ends - pieces) * SEGMENT).tolist()):
            flat[a : a + len(t)] = t
        owner = np.repeat(np.arange(len(texts)), pieces)
        sizes = np.minimum(SEGMENT, lengths[owner] - SEGMENT * (np.arange(total) - (ends - pieces)[owner]))
        grid = flat.reshape(total, SEGMENT).T
        follows = np.concatenate(([False], owner[1:] == owner[:-1])) if total else np.zeros(0, bool)
        begin = np.repeat(self.starts[:, None], total, 1)
        count, last, todo = np.zeros_like(begin), begin.copy(), np.arange(total)
        head = (np.zeros_like(begin), np.full_like(begin, -1))  # phrases and state after the opening
        while len(todo):
            todo = todo[np.argsort(-sizes[todo], kind="stable")]
            opening, rest = np.minimum(sizes[todo], OPENING), np.maximum(sizes[todo] - OPENING, 0)
            n, state = self.parse(np.ascontiguousarray(grid[:OPENING, todo]), opening, begin[:, todo])
            # From where the state is as it was before, the rest of the segment is too.
            anew = np.flatnonzero((state != head[1][:, todo]).any(axis=0))
            count[:, todo] += n - head[0][:, todo]
            head[0][:, todo], head[1][:, todo] = n, state
            some = todo[anew]
            n, state = self.parse(np.ascontiguousarray(grid[OPENING:, some]), rest[anew], head[1][:, some])
            count[:, some], last[:, some] = head[0][:, some] + n, state
            before = np.concatenate((begin[:, :1], last[:, :-1]), axis=1)
            todo = np.flatnonzero(follows & (before != begin).any(axis=0))
            begin[:, todo] = before[:, todo]
        final = ends[pieces > 0] - 1
        count[:, final] += last[:, final] != self.starts[:, None]  # the phrase that is open at the end
        out = np.stack([np.bincount(owner, c, len(texts)) for c in count], 1)
        return out * np.array(self.bits) / np.maximum(lengths, 1)[:, None]


@lru_cache(2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def bit_limits(samples: dict[str, str], piece: int = PIECE) -> dict[str, float]:
    """Bits a symbol beyond which a text is not of the language: half way from those of labelled pieces
    parsed against the language's other pieces to those of the same pieces with their symbols shuffled.
    A language of fewer than 4 pieces, or whose pieces differ too little from shuffled ones, has none."""
    cut = {k: [t[a : a + piece] for a in range(0, len(t), piece)] for k, t in samples.items()}
    out, rng = {}, np.random.default_rng(20240510)
    for name, pieces in cut.items():
        if len(pieces) < 4:
            continue
        p = Parser(((name, " ".join(pieces[::2])),))
        tried = [x for x in (p.symbols(code_points(t.lower())) for t in pieces[1::2]) if len(x)]
        if not tried:
            continue
        high = float(p.phrases(tried).max())
        noise = float(np.median(p.phrases([rng.permutation(x) for x in tried])))
        if noise > high:
            out[name] = (high + noise) / 2
    return out


def predict(texts: list[str | None], samples: tuple[tuple[str, str], ...], limits: dict[str, float] | None = None) -> tuple[list[str], list[float]]:
    """Language and score of each text: 1 less the best over the second best entropy. A text of TELLING
    symbols or more whose bits are beyond the limit of its best language has none."""
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not samples:
        return names, scores
    p, held, at, room = parser(samples), [], [], 0

    def flush() -> None:
        bits = p.phrases(held)
        order = np.argsort(bits, axis=1, kind="stable")
        best = np.take_along_axis(bits, order[:, :2], 1)
        for i, o, b, x in zip(at, order[:, 0].tolist(), best.tolist(), held):
            if limits and len(x) >= TELLING and b[0] > limits.get(p.names[o], np.inf):
                continue
            names[i] = p.names[o]
            scores[i] = 1.0 if len(b) < 2 else float(min(1.0, max(0.0, 1 - b[0] / b[1])))

    for i, t in enumerate(texts):
        if not t:
            continue
        points = code_points(t.lower())
        if not letters()[points].any():
            continue
        held.append(p.symbols(points))
        at.append(i)
        room += len(points)
        if room > 1_000_000:
            flush()
            held, at, room = [], [], 0
    if held:
        flush()
    return names, scores


def identify(docs: DataFrame, samples: dict[str, str], name: str = "lang_pred", score: str = "score", limits: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1, from the text alone.

    ``und`` with score 0: a text that is null or has no letter, or no language was learned, or a
    text beyond the ``limits`` of :func:`bit_limits`, if given. Equal
    entropies go to the smaller name. Columns named like the two added ones are replaced.
    """
    docs = docs.drop(name, score)
    at, fixed = docs.columns.index("text"), tuple(samples.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = predict(b.column(at).to_pylist(), fixed, limits)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, name, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from (a null doc_id is never held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_query(docs: DataFrame) -> DataFrame:
    """``op9_language``."""
    samples = labelled_sample(docs, ~held_out(F.col("doc_id")))
    named = identify(docs.select("doc_id", "text"), samples)
    return named.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, unsure: float = 0.0) -> DataFrame:
    """``docs`` without the texts of no language: no letter, bits beyond the limit learned from the
    labelled texts, or a score under ``unsure``. Short texts often fit two languages, so by default no
    score is too low. Texts with letters stay where nothing can be told: no language was learned, or
    their own label is none of those learned."""
    name, score = fresh(docs, "lang_pred_", "score_")
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    samples = labelled_sample(docs, ~held_out(F.col("doc_id")))
    if not samples:
        return docs.where(letter)
    other = F.coalesce(~F.col("lang").isin(list(samples)), F.lit(False)) & letter
    named = identify(docs, samples, name, score, bit_limits(samples))
    return named.where(other | (F.col(name) != "und") & (F.col(score) >= unsure)).select(*docs.columns)
