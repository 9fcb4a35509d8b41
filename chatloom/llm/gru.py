"""A gated recurrent language model in numpy, with a class-factored output.

Every word of a bounded vocabulary belongs to a class. P(word | state) = P(class | state) * P(word | class, state) for the most
frequent words, and P(class | state) * P(word | class) by counts for the others; the last class stands for all rarer words.
The output starts as the class unigram model and the network learns what the state adds to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
# Tokens per step of truncated backpropagation, and texts side by side in training and in scoring.
WINDOW = 16
TRAIN_LANES = 256
SCORE_LANES = 512
# Tokens of all lanes together in a window of scoring.
SCORE_TOKENS = 16_384
# Few texts are dealt to fewer lanes, so that they give about this many gradients.
LEAST_UPDATES, LEAST_LANES = 150, 4
RATE = 0.015
CLIP = 5.0
# Adam's shares of the old mean and of the old mean square, and what its divisor has at least.
KEEP_MEAN, KEEP_SQUARE, SMALLEST = 0.9, 0.999, 1e-8
# Rows of scores and weights worked on at once, so that they stay in the processor's cache.
ROWS, PIECE = 512, 16_384
# Scores of the output are bounded so that their exponentials fit.
LARGEST = 60.0


@dataclass(frozen=True)
class Layout:
    """Per vocabulary word (the last entry stands for all rarer words): what it is read as and how it is predicted."""

    read_as: np.ndarray  # row of the input table; the row behind all others begins a text
    word_class: np.ndarray
    place: np.ndarray  # place inside a learnt class, -1 in classes by counts
    within: np.ndarray  # log P(word | class) by counts; 0 in learnt classes
    learnt: int  # number of learnt classes, which come first
    width: int  # words of a learnt class
    class_bias: np.ndarray
    word_bias: np.ndarray  # (learnt, width)

    @property
    def begin(self) -> int:
        return int(self.read_as.max()) + 1


def initial(layout: Layout, seed: int = 1) -> dict[str, np.ndarray]:
    """The last row of each table of the output is its bias."""
    rng = np.random.default_rng(seed)
    f = np.float32

    def table(bias: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bias), HIDDEN + 1, bias.shape[1]), f)
        out[:, -1] = bias
        return out

    return {
        "inputs": rng.normal(0, 0.1, (layout.begin + 1, 3 * HIDDEN)).astype(f),
        "state": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)).astype(f),
        "classes": table(layout.class_bias[None]),
        "words": table(layout.word_bias),
    }


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The tables that lie in `flat` as `pack` puts them."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float32) for k, v in views(flat, like).items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def lanes_of(texts: list[np.ndarray], lanes: int, layout: Layout) -> tuple[np.ndarray, ...]:
    """Texts dealt to lanes, long ones first: inputs, targets (-1: none), text begins (steps x lanes), the lanes' lengths in
    descending order and the texts' places.

    No more lanes are used than the longest text fills twice over, so that the tables stay in proportion to the tokens.
    """
    longest, tokens = max(map(len, texts), default=1), sum(map(len, texts))
    used = np.zeros(max(1, min(lanes, len(texts), -(-2 * tokens // max(longest, 1)))), np.int64)
    places = [(0, 0)] * len(texts)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        lane = int(used.argmin())
        places[i] = (lane, int(used[lane]))
        used[lane] += len(texts[i])
    order = np.argsort(-used, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    used, places = used[order], [(int(rank[lane]), at) for lane, at in places]
    steps = int(used[0])
    inputs = np.full((len(used), steps), layout.begin, np.int32)
    targets = np.full((len(used), steps), -1, np.int32)
    begins = np.zeros((len(used), steps), bool)
    for (lane, at), t in zip(places, texts):
        inputs[lane, at + 1 : at + len(t)] = layout.read_as[t[:-1]]
        targets[lane, at : at + len(t)] = t
        begins[lane, at] = True
    return inputs.T, targets.T, begins.T, used, places


def forward(p: dict, x: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool):
    """States behind each step of a window; `keep` also returns what the way back needs.

    Inside, a step's lanes stand side by side, so that each gate lies in one piece.
    """
    n, steps, lanes = HIDDEN, *x.shape
    gates = np.ascontiguousarray(p["inputs"][x].transpose(0, 2, 1))
    out = np.empty((steps, n, lanes), np.float32)
    state, h = np.ascontiguousarray(p["state"].T), np.ascontiguousarray(h.T)
    kept = []
    with np.errstate(over="ignore"):  # a gate beyond the range is 0
        for t, begin in enumerate(begins.any(1).tolist()):
            if begin:
                h = h * ~begins[t]
            u = state @ h
            zr = gates[t, : 2 * n]
            zr += u[: 2 * n]
            sigmoid(zr)
            z, r = zr[:n], zr[n:]
            c = r * u[2 * n :]
            c += gates[t, 2 * n :]
            np.tanh(c, out=c)
            if keep:
                kept.append((h, z, r, c, u[2 * n :]))
            h = h - c
            h *= z
            h += c
            out[t] = h
    return np.ascontiguousarray(out.transpose(0, 2, 1)), h.T, kept


def member_logs(weights: np.ndarray, h: np.ndarray, groups: list[tuple[int, int, int]], hit: np.ndarray, grad=None, dh=None) -> np.ndarray:
    """log P of each row's member `hit` of its group. groups: each with its first row and the row behind its last one; `h` ends in
    a column of ones. With `grad` and `dh`, adds the gradients of the weights and of the states."""
    s = np.empty((len(hit), weights.shape[2]), np.result_type(h, weights))
    for k, a, b in groups:
        np.matmul(h[a:b], weights[k], out=s[a:b])
    logs, ones = np.empty(len(s), s.dtype), np.ones(s.shape[1], s.dtype)
    for a in range(0, len(s), ROWS):
        part, own = s[a : a + ROWS], hit[a : a + ROWS]
        rows = np.arange(len(part))
        np.minimum(part, LARGEST, out=part)
        found = part[rows, own]
        np.exp(part, out=part)
        total = part @ ones
        logs[a : a + ROWS] = found - np.log(total)
        if grad is not None:
            part *= (1 / total)[:, None]
            part[rows, own] -= 1
    if grad is not None:
        back = np.empty((len(s), HIDDEN), s.dtype)
        for k, a, b in groups:
            d = s[a:b]
            grad[k] += h[a:b].T @ d
            np.matmul(d, weights[k, :-1].T, out=back[a:b])
        dh[: len(back)] += back
    return logs


def output_logs(p: dict, layout: Layout, h: np.ndarray, targets: np.ndarray, grad: dict | None = None):
    """log P of each target given its state; with `grad` also adds the gradients of the output and returns that of the states.

    Targets are sorted by class: what is done for each score is done for all rows at once, and only the products with a group's
    own weights are taken group by group.
    """
    if not len(targets):
        return np.zeros(0), np.zeros_like(h)
    wanted = layout.word_class[targets].astype(np.min_scalar_type(len(layout.class_bias)))
    order = np.argsort(wanted, kind="stable")
    wanted, targets = wanted[order].astype(np.int64), targets[order]
    states = np.ones((len(h), HIDDEN + 1), h.dtype)
    states[:, :-1] = h[order]
    logs = layout.within[targets]
    dh = np.zeros(h.shape, np.result_type(h, p["classes"])) if grad is not None else None
    for a in range(0, len(wanted), ROWS):
        b = min(a + ROWS, len(wanted))
        logs[a:b] += member_logs(p["classes"], states[a:b], [(0, 0, b - a)], wanted[a:b], grad and grad["classes"], grad and dh[a:b])
    own = wanted[: np.searchsorted(wanted, layout.learnt)]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    groups = list(zip(own[first].tolist(), first.tolist(), [*first[1:].tolist(), len(own)]))
    logs[: len(own)] += member_logs(p["words"], states, groups, layout.place[targets[: len(own)]], grad and grad["words"], dh)
    at = np.empty_like(order)
    at[order] = np.arange(len(order))
    return logs[at], dh[at] if grad is not None else None


def backward(p: dict, x: np.ndarray, begins: np.ndarray, kept: list, dh_out: np.ndarray, grad: dict) -> None:
    """Through one window; the gradient ends where it or a text begins."""
    n, steps, lanes = HIDDEN, *x.shape
    dg = np.empty((steps, 3 * n, lanes), np.float32)
    back = np.zeros((n, lanes), np.float32)
    dh_out = np.ascontiguousarray(dh_out.transpose(0, 2, 1))
    begun = begins.any(1).tolist()
    du = np.empty((3 * n, lanes), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, u = kept[t]
        d = back
        d += dh_out[t]
        own = dg[t]
        rest = 1 - z
        dc = np.multiply(c, c, out=own[2 * n :])
        np.subtract(1, dc, out=dc)
        dc *= rest
        dc *= d
        dz = np.subtract(h, c, out=own[:n])
        dz *= d
        dz *= z
        dz *= rest
        np.subtract(1, r, out=rest)
        rest *= r
        rest *= u
        np.multiply(dc, rest, out=own[n : 2 * n])
        du[:] = own
        du[2 * n :] *= r
        grad["state"] += h @ du.T
        back = p["state"] @ du
        d *= z
        back += d
        if begun[t]:
            back *= ~begins[t]
    flat, rows = x.ravel().astype(np.min_scalar_type(len(p["inputs"]))), dg.transpose(0, 2, 1).reshape(-1, 3 * n)
    order = np.argsort(flat, kind="stable")
    flat = flat[order].astype(np.int64)
    first = np.flatnonzero(np.diff(flat, prepend=-1))
    grad["inputs"][flat[first]] += np.add.reduceat(rows[order], first)


class Rows:
    """Adam over a table of which a window touches few rows.

    A row that has no gradient for some updates goes on by its momentum alone; that way is a sum over the updates, which is made
    up when the row is needed again. (Adam's smallest divisor shrinks on it like the root of the squares.)
    """

    def __init__(self, table: np.ndarray):
        self.p = table
        self.grad, self.mean, self.square = np.zeros_like(table), np.zeros_like(table), np.zeros_like(table)
        self.at = np.zeros(len(table), np.int64)  # the update up to which a row is made up; 0: it never had a gradient
        self.touched = np.zeros(len(table), bool)
        self.way = np.zeros(1)  # by update, how far a momentum of 1 over a root of 1 has gone since

    def need(self, rows: np.ndarray) -> None:
        """They will be read and get gradients."""
        new = np.zeros(len(self.p), bool)
        new[rows] = True
        self.make_up(np.flatnonzero(new & ~self.touched))
        self.touched |= new

    def make_up(self, rows: np.ndarray) -> None:
        now, since = len(self.way) - 1, self.at[rows]
        late = np.flatnonzero((since < now) & (since > 0))
        if not len(late):
            return
        rows, since = rows[late], since[late]
        m, v = self.mean[rows], self.square[rows]
        to = np.sqrt(v)
        to += SMALLEST
        np.divide(m, to, out=to)
        to *= self.way[since].astype(to.dtype)[:, None]
        self.p[rows] -= to
        m *= (KEEP_MEAN ** (now - since)).astype(m.dtype)[:, None]
        v *= (KEEP_SQUARE ** (now - since)).astype(v.dtype)[:, None]
        self.mean[rows], self.square[rows], self.at[rows] = m, v, now

    def squares(self) -> float:
        g = self.grad[np.flatnonzero(self.touched)].ravel()
        return float(g @ g)

    def update(self, scale: float, step: float) -> None:
        rows = np.flatnonzero(self.touched)
        self.touched[:] = False
        g, m, v = self.grad[rows], self.mean[rows], self.square[rows]
        self.grad[rows] = 0
        self.p[rows] -= adam(g, m, v, scale, step)
        self.mean[rows], self.square[rows] = m, v
        self.way += step * (KEEP_MEAN / math.sqrt(KEEP_SQUARE)) ** np.arange(len(self.way), 0, -1)
        self.way = np.append(self.way, 0.0)
        self.at[rows] = len(self.way) - 1


class Whole:
    """Adam over tables that lie in one piece, block by block."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.flat = pack(tables)
        self.grad, self.mean, self.square = np.zeros_like(self.flat), np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.room = np.empty(min(PIECE, len(self.flat)), self.flat.dtype)

    def squares(self) -> float:
        return float(self.grad @ self.grad)

    def update(self, scale: float, step: float) -> None:
        for a in range(0, len(self.flat), PIECE):
            part = slice(a, a + PIECE)
            g = self.grad[part]
            self.flat[part] -= adam(g, self.mean[part], self.square[part], scale, step, self.room[: len(g)])
        self.grad[:] = 0


def adam(g: np.ndarray, m: np.ndarray, v: np.ndarray, scale: float, step: float, room: np.ndarray | None = None) -> np.ndarray:
    """The way of one update; all three are changed."""
    g *= scale
    m *= KEEP_MEAN
    v *= KEEP_SQUARE
    m += np.multiply(g, 1 - KEEP_MEAN, out=room)
    g *= g
    g *= 1 - KEEP_SQUARE
    v += g
    np.sqrt(v, out=g)
    g += SMALLEST
    np.divide(m, g, out=g)
    g *= step
    return g


class Trainer:
    """Adam over the windows of texts; `weight` counts the targets that gave a gradient."""

    def __init__(self, params: dict[str, np.ndarray], layout: Layout, rate: float = RATE):
        self.layout, self.rate, self.weight, self.updates = layout, rate, 0, 0
        self.held = 0
        rest = {k: v for k, v in params.items() if k != "inputs"}
        self.inputs, self.rest = Rows(params["inputs"].copy()), Whole(rest)
        self.p = {"inputs": self.inputs.p} | views(self.rest.flat, rest)
        self.grad = {"inputs": self.inputs.grad} | views(self.rest.grad, rest)

    def learn(self, texts: list[np.ndarray]) -> None:
        if not texts:
            return
        lanes = sum(map(len, texts)) // (WINDOW * LEAST_UPDATES)
        inputs, targets, begins, used, _ = lanes_of(texts, min(max(lanes, LEAST_LANES), TRAIN_LANES), self.layout)
        h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for a in range(0, len(inputs), WINDOW):
            part = slice(a, a + WINDOW), slice(0, int((used > a).sum()))  # lanes that go on
            x, b = inputs[part], begins[part]
            self.inputs.need(x)
            out, h, kept = forward(self.p, x, b, h[part[1]], True)
            self._gather(x, b, targets[part], out, kept)
            if self.held >= WINDOW * inputs.shape[1] // 2:  # a few long texts that go on alone share an update
                self._update()
        self._update()
        self.inputs.make_up(np.arange(len(self.inputs.p)))

    def _gather(self, x, begins, targets, out, kept) -> None:
        real = targets >= 0
        n = int(real.sum())
        if not n:
            return
        _, dh = output_logs(self.p, self.layout, out[real], targets[real], self.grad)
        dh_out = np.zeros_like(out)
        dh_out[real] = dh
        backward(self.p, x, begins, kept, dh_out, self.grad)
        self.held += n

    def _update(self) -> None:
        n = self.held
        if not n:
            return
        self.held = 0
        self.weight += n
        self.updates += 1
        norm = math.sqrt(self.inputs.squares() + self.rest.squares()) / n
        scale = min(1.0, CLIP / max(norm, 1e-12)) / n
        warm = min(1.0, self.updates / 20)
        step = warm * self.rate * math.sqrt(1 - KEEP_SQUARE**self.updates) / (1 - KEEP_MEAN**self.updates)
        self.inputs.update(scale, step)
        self.rest.update(scale, step)


def score(params: dict, layout: Layout, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole text, the state being carried from window to window."""
    if not texts:
        return np.zeros(0)
    inputs, targets, begins, used, places = lanes_of(texts, SCORE_LANES, layout)
    logs = np.zeros(inputs.shape, np.float64)
    h = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    a = 0
    while a < len(inputs):
        lanes = int((used > a).sum())  # those that go on
        part = slice(a, a + max(WINDOW, SCORE_TOKENS // lanes)), slice(0, lanes)
        out, h, _ = forward(params, inputs[part], begins[part], h[part[1]], False)
        real = targets[part] >= 0
        logs[part][real] = output_logs(params, layout, out[real], targets[part][real])[0]
        a += len(out)
    return np.array([logs[at : at + len(t), lane].sum() for (lane, at), t in zip(places, texts)])
