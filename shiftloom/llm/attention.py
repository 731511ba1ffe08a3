"""A small causal self-attention language model over subword units, trained and run in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Input positions of a window and how many of them, the last ones, are scored.
LENGTH, STRIDE = 20, 16
DIM = 16
#: Units of a group of the softmax, from the most frequent units on, and how many of such groups; the last size goes on.
#: A target costs its group and one number for each group; in groups of one size that would be a third more.
SIZES = ((8, 8), (16, 6), (32, 4), (64, 4), (128, 0))
#: Windows that attend at once, and states scored at once: few enough to stay in a processor's cache.
TOGETHER, ROWS = 128, 1024


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over sequences laid end to end: (place of each input, valid) of shape (n, LENGTH).

    Windows overlap by LENGTH - STRIDE; each position of a sequence is among the last STRIDE of
    exactly one window.
    """
    count = -(-lengths // STRIDE)
    owner = np.repeat(np.arange(len(lengths)), count)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = (number * STRIDE - (LENGTH - STRIDE))[:, None] + np.arange(LENGTH)
    valid = (place >= 0) & (place < lengths[owner][:, None])
    return np.where(valid, place + first[owner][:, None], 0), valid


def lagged() -> np.ndarray:
    """How far back each key lies from each scored query: (STRIDE, LENGTH), negative for the future."""
    return (np.arange(LENGTH - STRIDE, LENGTH)[:, None] - np.arange(LENGTH)[None, :]).astype(np.int64)


@lru_cache(8)
def bounds(units: int) -> np.ndarray:
    """First unit of each group, and the number of units."""
    first = [0]
    for size, times in SIZES:
        while first[-1] < units and (times or size == SIZES[-1][0]):
            first.append(min(units, first[-1] + size))
            times -= 1
    return np.array(first)


@lru_cache(8)
def groups(units: int) -> np.ndarray:
    """Group of each unit; short numbers are sorted by radix."""
    first = bounds(units)
    return np.repeat(np.arange(len(first) - 1, dtype=np.uint16), np.diff(first))


@dataclass
class Model:
    """One attention layer: h = relu(x + attention), then a softmax over groups of units and one
    within the unit's group; units come in order of their frequency, the groups of the first are small. ``units`` counts the predicted units; two more stand for the beginning
    and for padding on the input side only."""

    units: int
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, counts: np.ndarray, rng: np.random.Generator) -> Model:
        units, first = len(counts), bounds(len(counts))
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        log = np.log(counts + 0.5).astype(np.float32)
        log[counts == 0] -= 3
        p = {k: small(units + 2, 2 * DIM) for k in ("qx", "kv")}  # queries and states, keys and values
        p |= {"lag": np.zeros(LENGTH, np.float32), "wg": small(len(first) - 1, DIM), "bg": np.log(np.add.reduceat(counts, first[:-1]) + 1).astype(np.float32), "wu": small(units, DIM), "bu": log}
        return cls(units, p)

    @property
    def begin(self) -> int:
        return self.units

    @property
    def pad(self) -> int:
        return self.units + 1

    def mask(self) -> np.ndarray:
        back = lagged()
        return np.where(back >= 0, self.p["lag"][np.maximum(back, 0)], np.float32(-1e9)).astype(np.float32)

    def steep(self) -> bool:
        """Whether exponents of the attention may be beyond 40."""
        p = self.p
        return longest(p["qx"][:, :DIM]) * longest(p["kv"][:, :DIM]) + p["lag"].max() > 40

    def attend(self, ids: np.ndarray, valid: np.ndarray, mask: np.ndarray, clip: bool = True):
        """(queries, keys, values, attention weights, attended values, state) of the scored positions."""
        p = self.p
        qx, kv = p["qx"].take(ids[:, -STRIDE:], 0), p["kv"].take(ids, 0)
        q, x, k, v = qx[..., :DIM], qx[..., DIM:], kv[..., :DIM], kv[..., DIM:]
        s = q @ k.transpose(0, 2, 1)
        s += mask
        part = np.flatnonzero(~(valid[:, 0] & valid[:, -1]))  # the first and last windows of a text, few; only their ends are empty
        s[part] += np.where(valid[part], np.float32(0), np.float32(-1e9))[:, None, :]
        if clip:
            np.minimum(s, 40, out=s)
        np.exp(s, out=s)
        s *= 1 / (row_sums(s) + np.float32(1e-30))[..., None]
        o = s @ v
        h = o + x
        return q, k, v, s, o, np.maximum(h, 0, out=h)

    def heads(self) -> list[np.ndarray]:
        """For each group, the weights of the groups and of its units, the biases as last column."""
        p, first = self.p, bounds(self.units)
        top, unit = (np.concatenate((p[k], p[b][:, None]), 1) for k, b in (("wg", "bg"), ("wu", "bu")))
        return [np.concatenate((top, unit[a:b])) for a, b in zip(first[:-1], first[1:])]

    def unit_logs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each target given its state."""
        w, group = self.heads(), groups(self.units).take(target)
        order = np.argsort(group, kind="stable")
        logs, out = np.empty(len(h), h.dtype), np.empty(len(h), h.dtype)
        for _ in softmaxes(w, with_one(h, order), target.take(order), group.take(order), logs):
            pass
        out[order] = logs
        return out

    def log10_probability(self, units: np.ndarray, lengths: np.ndarray, block: int = 1024) -> np.ndarray:
        """log10 probability of each unit of the sequences laid end to end in ``units``."""
        if not len(units):
            return np.zeros(0)
        before = preceding(self, units, lengths)
        place, valid = windows(lengths)
        logs, mask, clip = np.zeros(len(units), np.float32), self.mask(), self.steep()
        for a in range(0, len(place), block):
            at, ok = place[a : a + block], valid[a : a + block]
            ids, h = np.where(ok, before.take(at), self.pad), np.empty((len(at), STRIDE, DIM), np.float32)
            for i in range(0, len(at), TOGETHER):
                h[i : i + TOGETHER] = self.attend(ids[i : i + TOGETHER], ok[i : i + TOGETHER], mask, clip)[-1]
            scored = np.flatnonzero(ok[:, -STRIDE:])
            where = at[:, -STRIDE:].ravel().take(scored)
            logs[where] = self.unit_logs(h.reshape(-1, DIM).take(scored, 0), units.take(where))
        return logs / np.log(10)


def row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, which is short: a product is quicker than a reduction."""
    return x @ np.ones(x.shape[-1], x.dtype)


def longest(x: np.ndarray) -> float:
    """Length of the longest row."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


def with_one(h: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Those rows of the states, and a column of ones, which takes the biases."""
    out = np.ones((len(which), DIM + 1), h.dtype)
    out[:, :DIM] = h.take(which, 0)
    return out


def softmaxes(w: list[np.ndarray], h: np.ndarray, target: np.ndarray, group: np.ndarray, logs: np.ndarray, most: int = ROWS) -> Iterator[tuple]:
    """For states (with ones) and their targets sorted by group of units, runs of one group and at most ``most`` rows, which stay in the
    processor's cache: (group, first and last row, place of the targets in the flat next one, both softmaxes unscaled with a column
    for each row, sums of both). ``logs`` gets the natural log of each target's probability; the softmaxes are the caller's until the next run."""
    n, widest = len(w), max(map(len, w))
    line = np.arange(min(most, len(h)))
    cuts, first = np.searchsorted(group, np.arange(n + 1)).tolist(), np.cumsum([0] + [len(x) - n for x in w])
    within = target - first.take(group) + n
    room, sums = np.empty(len(line) * widest, h.dtype), np.empty((2, len(h)), h.dtype)
    for j in range(n):
        for a in range(cuts[j], cuts[j + 1], most):
            b = min(a + most, cuts[j + 1])
            flat, total = room[: len(w[j]) * (b - a)], sums[:, a:b]
            y, at = flat.reshape(-1, b - a), within[a:b] * (b - a) + line[: b - a]
            np.matmul(w[j], h[a:b].T, out=y)
            np.add(y[j], flat.take(at), out=logs[a:b])
            if flat.max() > 80:
                np.minimum(y, 80, out=y)
            np.exp(y, out=y)
            np.add.reduce(y[:n], 0, out=total[0])
            np.add.reduce(y[n:], 0, out=total[1])
            yield j, a, b, at, y, total
    logs -= np.log(sums).sum(0)


def add_rows(sums: np.ndarray, cells: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of ``values`` to the row of ``sums`` that ``ids`` names. Two neighbours of a row are added at once, as a complex
    number: that is quicker here than sorting rows and adding up runs. ``cells``: the places of each row in the sums laid flat."""
    kind = np.result_type(sums, np.complex64)
    np.add.at(sums.view(kind).ravel(), cells.take(ids.ravel(), 0).ravel(), values.view(kind).ravel())


def gradients(m: Model, ids: np.ndarray, valid: np.ndarray, target: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of a batch of windows and its gradients."""
    clip = m.steep()
    cuts = [slice(a, a + TOGETHER) for a in range(0, len(ids), TOGETHER)]
    attended = [m.attend(ids[c], valid[c], mask, clip) for c in cuts]
    h = np.concatenate([x[-1] for x in attended])
    w, live = m.heads(), valid[:, -STRIDE:].ravel()
    scored = np.flatnonzero(live)
    t = target.ravel()[scored]
    group = groups(m.units).take(t)
    order = np.argsort(group, kind="stable")
    scored, t, group = scored[order], t[order], group[order]
    n, size, first = len(w), len(t), bounds(m.units)
    hs, logs, dh = with_one(h.reshape(-1, DIM), scored), np.empty(size, h.dtype), np.zeros((size + 1, DIM), h.dtype)
    d_top, d_unit = np.zeros((n, DIM + 1), h.dtype), np.zeros((m.units, DIM + 1), h.dtype)
    for j, a, b, at, y, total in softmaxes(w, hs, t, group, logs):
        total = 1 / total
        y[:n] *= total[0]
        y[n:] *= total[1]
        y[j] -= 1
        y.ravel()[at] -= 1
        dw = y @ hs[a:b]
        d_top += dw[:n]
        d_unit[first[j] : first[j + 1]] += dw[n:]
        np.matmul(y.T, w[j][:, :DIM], out=dh[a:b])
    grads = {"wg": d_top[:, :DIM], "bg": d_top[:, DIM], "wu": d_unit[:, :DIM], "bu": d_unit[:, DIM]}
    row = np.full(len(live), size)  # of each position in dh, whose last row is zero
    row[scored] = np.arange(size)
    d = dh.take(row, 0).reshape(h.shape)
    d *= h > 0
    back, lags = lagged(), np.zeros((STRIDE, LENGTH), h.dtype)
    grads |= {key: np.zeros_like(m.p[key]) for key in ("qx", "kv")}
    cells = np.arange(grads["qx"].size // 2).reshape(-1, DIM)
    for c, (q, k, v, s, o, _) in zip(cuts, attended):
        ds = d[c] @ v.transpose(0, 2, 1)
        ds -= row_sums(d[c] * o)[..., None]
        ds *= s
        lags += ds.sum(0)
        dqx, dkv = np.empty((len(s), STRIDE, 2 * DIM), h.dtype), np.empty((len(s), LENGTH, 2 * DIM), h.dtype)
        dqx[..., DIM:] = d[c]
        np.matmul(ds, k, out=dqx[..., :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :DIM])
        np.matmul(s.transpose(0, 2, 1), d[c], out=dkv[..., DIM:])
        add_rows(grads["qx"], cells, ids[c, -STRIDE:], dqx)
        add_rows(grads["kv"], cells, ids[c], dkv)
    grads["lag"] = np.bincount(back[back >= 0], lags[back >= 0], LENGTH).astype(np.float32)
    return -float(logs.sum()) / size, {key: np.divide(x, size, out=np.empty(x.shape, x.dtype)) for key, x in grads.items()}


def preceding(m: Model, units: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The unit before each unit of the sequences laid end to end."""
    before = np.empty_like(units)
    before[1:] = units[:-1]
    before[np.concatenate(([0], np.cumsum(lengths)[:-1]))[lengths > 0]] = m.begin
    return before


class Adam:
    """Moments of the gradients of one model."""

    def __init__(self, m: Model):
        self.one = {k: np.zeros_like(x) for k, x in m.p.items()}
        self.two = {k: np.zeros_like(x) for k, x in m.p.items()}
        self.steps = 0

    def step(self, m: Model, grads: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        first, second = float(rate / (1 - 0.9**self.steps)), float(1 / (1 - 0.99**self.steps))
        for k, g in grads.items():
            one, two, t = self.one[k], self.two[k], g - self.one[k]
            t *= 0.1
            one += t
            np.multiply(g, g, out=t)
            t -= two
            t *= 0.01
            two += t
            np.multiply(two, second, out=t)
            np.sqrt(t, out=t)
            t += 1e-8
            np.divide(one, t, out=t)
            t *= first
            m.p[k] -= t


def train(m: Model, units: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, steps: int = 1200, batch: int = 128, rate: float = 6e-3) -> float:
    """Adam over random windows; returns the mean loss of the last steps (natural log per unit)."""
    before, adam = preceding(m, units, lengths), Adam(m)
    place, valid = windows(lengths)
    recent: list[float] = []
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(place), batch)
        at, ok = place[pick], valid[pick]
        loss, grads = gradients(m, np.where(ok, before[at], m.pad), ok, units[at[:, -STRIDE:]], m.mask())
        recent.append(loss)
        adam.step(m, grads, rate * min(1, step / 50) * 0.5 * (1 + np.cos(np.pi * step / steps)) + 1e-5)
    return float(np.mean(recent[-100:]))


def train_once(m: Model, adam: Adam, units: np.ndarray, lengths: np.ndarray, rng: np.random.Generator, rate: float, batch: int = 512) -> None:
    """Steps over every window of the sequences, each once, in random order."""
    before = preceding(m, units, lengths)
    place, valid = windows(lengths)
    order = rng.permutation(len(place))
    for a in range(0, len(order), batch):
        at, ok = place.take(order[a : a + batch], 0), valid.take(order[a : a + batch], 0)
        _, grads = gradients(m, np.where(ok, before.take(at), m.pad), ok, units.take(at[:, -STRIDE:]), m.mask())
        # The first steps of fresh moments are of full size whatever the gradient.
        adam.step(m, grads, rate * min(1, (adam.steps + 1) / 20))
