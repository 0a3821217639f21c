"""A small causal self-attention language model in numpy, over subword ids.

One layer: the state of a position is its token's own vector plus attention over the tokens before it (itself
included) within overlapping windows of two blocks. As queries, keys and values depend on the token alone, they are
one table after training. The state gives a softmax over classes of tokens; inside a class tokens follow their share of
the text to learn from. Frequent tokens are classes of their own; the others are grouped by what stands before them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import as_strided

from .common import runs

#: Vector length, positions in a block (a window has two), single-token classes, grouped classes.
D, BLOCK, SINGLE, GROUPED = 16, 16, 96, 32
STEPS, BATCH, RATE = 2_500, 96, 0.01
#: Tokens of a round: its scores and states stay in a core's cache.
ROUND = BLOCK * 128
#: Exponents above this count as this, so that sums of exponentials stay finite.
MOST = np.float32(60)
#: In training windows: beyond the text.
OUTSIDE = -1
#: Blocks to learn in a row of a whole text; what is added to a token's count for its share.
LEARNT, UNSEEN = 4, 0.05


@dataclass
class Model:
    table: np.ndarray  # of each token: its state before attention, query, key, value and a one
    out: np.ndarray  # states to classes
    bias: np.ndarray
    near: np.ndarray  # added to the attention by distance, BLOCK x 2 BLOCK
    cls: np.ndarray  # class of each token
    share: np.ndarray  # natural log of the token's share of its class

    def log_prob(self, inputs: np.ndarray, targets: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Natural log probability of each target given the inputs up to its position, in the same text."""
        n = len(inputs)
        out = self.share[targets]
        cls = self.cls[targets]
        before, after = np.zeros(BLOCK, np.int64), np.zeros(-n % BLOCK, np.int64)
        x, whose = np.concatenate([before, inputs, after]), np.concatenate([before - 1, text, after - 1])
        for at in range(0, n, ROUND):  # each round sees one block before its own
            to = min(n, at + ROUND)
            end = to + BLOCK - to % -BLOCK
            out[at:to] += self._blocks(x[at:end], cls[at:to], whose[at:end])
        return out

    def _blocks(self, x: np.ndarray, cls: np.ndarray, text: np.ndarray) -> np.ndarray:
        n = len(cls)
        rows = self.table[x]
        blocks = len(x) // BLOCK - 1
        row, one = rows.strides
        q = as_strided(rows[BLOCK:, D:], (blocks, BLOCK, D), (BLOCK * row, row, one))
        keys = as_strided(rows[:, 2 * D :], (blocks, 2 * BLOCK, D), (BLOCK * row, row, one))
        values = as_strided(rows[:, 3 * D :], (blocks, 2 * BLOCK, D + 1), (BLOCK * row, row, one))
        score = q @ keys.transpose(0, 2, 1)
        score += self.near
        starts = np.flatnonzero(text[: -BLOCK : BLOCK] != text[2 * BLOCK - 1 :: BLOCK])  # only here does a window span texts
        if len(starts):
            own = starts[:, None] * BLOCK + np.arange(2 * BLOCK)
            score[starts] += np.where(text[own[:, BLOCK:]][:, :, None] == text[own][:, None, :], np.float32(0), np.float32(-1e9))
        np.minimum(score, MOST, out=score)
        np.exp(score, out=score)
        both = (score @ values).reshape(-1, D + 1)[:n]  # the last column is the sum of the weights
        state = both[:, :D] / (both[:, D:] + np.float32(1e-30))
        state += rows[BLOCK : BLOCK + n, :D]
        np.tanh(state, out=state)
        logits = state @ self.out
        logits += self.bias
        if _most(self.out, self.bias) > MOST:
            np.minimum(logits, MOST, out=logits)
        picked = logits[np.arange(len(cls)), cls]
        np.exp(logits, out=logits)
        return picked - np.log(logits @ np.ones(logits.shape[1], np.float32))


def _most(out: np.ndarray, bias: np.ndarray) -> float:
    """What no class's logit exceeds, as states lie between -1 and 1."""
    return (np.abs(out).sum(0) + bias).max()


def classes(before: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of `size` tokens, and the log of its share there; before: the token ahead of each of ids."""
    count = np.bincount(ids, minlength=size) + UNSEEN
    order = np.argsort(-count, kind="stable")
    cls = np.empty(size, np.int64)
    single, rest = order[:SINGLE], order[SINGLE:]
    cls[single] = np.arange(len(single))
    # the others by the single-token class before them (its share of their occurrences), k-means on the seen ones
    where = np.full(size, SINGLE)
    where[single] = np.arange(len(single))
    ahead = np.bincount(ids * (SINGLE + 1) + where[before], minlength=size * (SINGLE + 1)).reshape(size, SINGLE + 1).astype(float)
    seen = rest[ahead[rest].sum(1) >= 3]
    cls[rest] = SINGLE + np.arange(len(rest)) % GROUPED
    if len(seen) >= GROUPED:
        x = np.sqrt(ahead[seen] / ahead[seen].sum(1, keepdims=True))
        centre = x[np.linspace(0, len(x) - 1, GROUPED).astype(int)]
        for _ in range(8):
            near = (x @ centre.T * 2 - (centre**2).sum(1)).argmax(1)
            for c in range(GROUPED):
                if (near == c).any():
                    centre[c] = x[near == c].mean(0)
        cls[seen] = SINGLE + near
    return cls, shares(cls, count)


def shares(cls: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural log of each token's share of its class."""
    whole = np.bincount(cls, weights=count, minlength=SINGLE + GROUPED)
    return np.log(count / whole[cls]).astype(np.float32)


@dataclass
class State:
    """What a fit carries: the parameters, each token's class, and the log of its share there."""

    p: dict[str, np.ndarray]
    cls: np.ndarray
    share: np.ndarray

    def rows(self) -> np.ndarray:
        """All parameters as one matrix of D columns; the vectors of the tokens come first."""
        return np.concatenate([self.p[k].reshape(-1, D) for k in ORDER])

    def of_rows(self, rows: np.ndarray) -> State:
        """The same classes with the parameters that rows() would give."""
        at = np.cumsum([self.p[k].size // D for k in ORDER])
        parts = np.split(np.asarray(rows, np.float32), at[:-1])
        return State({k: part.reshape(self.p[k].shape).copy() for k, part in zip(ORDER, parts, strict=True)}, self.cls, self.share)

    def model(self) -> Model:
        p = self.p | {"bias": self.p["bias"].copy()}
        p["bias"][np.bincount(self.cls, minlength=SINGLE + GROUPED) == 0] = -1e9  # classes of a small vocabulary that hold no token
        near = np.where(CAUSAL, p["dist"][GAP], np.float32(-1e9)).astype(np.float32)
        e = p["e"]
        table = np.concatenate([e @ p["own"], e @ p["q"], e @ p["k"], e @ p["v"], np.ones((len(e), 1), np.float32)], axis=1)
        return Model(np.ascontiguousarray(table, np.float32), p["out"].astype(np.float32), p["bias"].astype(np.float32), near, self.cls, self.share)


#: The parameters in the order of State.rows().
ORDER = ("e", "own", "q", "k", "v", "out", "bias", "dist")
#: Those that a token's vector is multiplied by.
TABLE = ("k", "v", "q", "own")
_DISTANCE = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
CAUSAL = _DISTANCE >= 0
GAP = np.where(CAUSAL, _DISTANCE, 0)


def start(windows: np.ndarray, size: int, rng: np.random.Generator) -> State:
    """Classes and shares from the windows, parameters drawn."""
    y, ahead = windows[:, BLOCK + 1 :], windows[:, BLOCK:-1]
    there = (y != OUTSIDE) & (ahead != OUTSIDE)
    cls, share = classes(ahead[there], y[there], size)
    n_classes = SINGLE + GROUPED
    p = {
        "e": rng.normal(0, 0.3, (size, D)),
        "own": np.eye(D) * 1.0,
        "q": rng.normal(0, 0.25, (D, D)),
        "k": rng.normal(0, 0.25, (D, D)),
        "v": rng.normal(0, 0.25, (D, D)),
        "out": rng.normal(0, 0.1, (D, n_classes)),
        "bias": np.log(np.bincount(cls[y[there]], minlength=n_classes) + 0.5),
        "dist": np.zeros(2 * BLOCK),
    }
    p = {k: a.astype(np.float32) for k, a in p.items()}
    p["bias"] -= p["bias"].mean()
    return State(p, cls, share)


class Adam:
    """Adam over the parameters of a state, which it changes; seen: how often each token's vector took part."""

    def __init__(self, state: State) -> None:
        self.state, self.step, self.windows = state, 0, 0
        self.m1, self.m2 = ({k: np.zeros_like(a) for k, a in state.p.items()} for _ in range(2))
        self.seen = np.zeros(len(state.cls), np.int64)
        self.place = np.zeros(len(state.cls), np.int64)  # of each token among the different ones of a batch

    def update(self, windows: np.ndarray, rate: float) -> None:
        """One step on a batch of windows: rows of a block, any number of blocks to learn, and one id more (see fitted)."""
        p, m1, m2, cls = self.state.p, self.m1, self.m2, self.state.cls
        n, blocks = len(windows), windows.shape[1] // BLOCK - 1
        self.step, self.windows = self.step + 1, self.windows + n
        wx, ty = windows[:, :-1], windows[:, BLOCK + 1 :]
        inside = wx != OUTSIDE
        valid = ((ty != OUTSIDE) & inside[:, BLOCK:]).ravel().astype(np.float32)
        valid /= max(np.float32(1), valid.sum())
        wx, ty = np.maximum(wx, 0), np.maximum(ty, 0)
        # queries, keys and values depend on the token alone: they are computed once for each different one
        there = np.zeros(len(cls), bool)
        there[wx] = True
        rows = np.flatnonzero(there)
        self.place[rows] = np.arange(len(rows))
        back = self.place[wx]
        self.seen[rows] += np.bincount(back[inside], minlength=len(rows))
        e = p["e"][rows]
        table = (e @ np.concatenate([p[name] for name in TABLE], axis=1)).take(back, axis=0)
        row, pos, one = table.strides
        k, v = (as_strided(table[:, :, i:], (n, blocks, 2 * BLOCK, D), (row, BLOCK * pos, pos, one)) for i in (0, D))
        q = table[:, BLOCK:, 2 * D : 3 * D].reshape(n, blocks, BLOCK, D)
        a = q @ k.swapaxes(2, 3)
        a += p["dist"][GAP]
        np.minimum(a, MOST, out=a)
        np.exp(a, out=a)
        a *= CAUSAL
        part = np.flatnonzero(~inside.all(1))
        a[part] *= as_strided(inside[part], (len(part), blocks, 1, 2 * BLOCK), (inside.shape[1], BLOCK, 0, 1))
        a /= a @ np.ones((2 * BLOCK, 1), np.float32) + np.float32(1e-30)
        both = a @ v
        h = np.tanh(table[:, BLOCK:, 3 * D :] + both.reshape(n, -1, D)).reshape(-1, D)
        g = h @ p["out"]
        g += p["bias"]
        if _most(p["out"], p["bias"]) > MOST:
            np.minimum(g, MOST, out=g)
        np.exp(g, out=g)
        g *= (valid / (g @ np.ones(g.shape[1], np.float32)))[:, None]
        g[np.arange(len(g)), cls[ty].ravel()] -= valid
        grad = {"out": h.T @ g, "bias": np.ones(len(g), np.float32) @ g}
        gz = ((g @ p["out"].T) * (1 - h * h)).reshape(n, blocks, BLOCK, D)
        gs = gz @ v.swapaxes(2, 3)
        gs -= (gz * both) @ np.ones((D, 1), np.float32)
        gs *= a
        grad["dist"] = np.bincount(GAP.ravel(), weights=gs.sum((0, 1)).ravel(), minlength=2 * BLOCK)
        moved = np.zeros((n, blocks + 1, BLOCK, 4 * D), np.float32)
        for i, part in ((0, gs.swapaxes(2, 3) @ q), (D, a.swapaxes(2, 3) @ gz)):
            moved[:, :-1, :, i : i + D] += part[:, :, :BLOCK]
            moved[:, 1:, :, i : i + D] += part[:, :, BLOCK:]
        moved[:, 1:, :, 2 * D : 3 * D] = gs @ k
        moved[:, 1:, :, 3 * D :] = gz
        place = back.ravel().astype(np.uint16 if len(rows) <= 1 << 16 else np.int64)
        sizes = np.bincount(place)
        moved, own = moved.reshape(-1, 4 * D), e.take(back.ravel(), axis=0)
        grad |= dict(zip(TABLE, np.split(own.T @ moved, len(TABLE), axis=1), strict=True))
        moved = moved @ np.concatenate([p[name].T for name in TABLE])  # before it is summed by token, as that has fewer columns
        grad["e"] = np.add.reduceat(moved.take(np.argsort(place, kind="stable"), axis=0), np.cumsum(sizes) - sizes, axis=0)
        for name, d in grad.items():
            part = rows if name == "e" else slice(None)
            first = m1[name][part] = 0.9 * m1[name][part] + 0.1 * d
            second = m2[name][part] = 0.99 * m2[name][part] + 0.01 * d * d
            p[name][part] -= rate * (first / (1 - 0.9**self.step)) / (np.sqrt(second / (1 - 0.99**self.step)) + 1e-8)


def fitted(windows: np.ndarray, size: int, steps: int | None = None, seed: int = 7) -> State:
    """Fit by Adam on windows: rows of 2 BLOCK + 1 ids below `size`, of which the last BLOCK are predicted from those before; OUTSIDE: beyond the text."""
    steps = STEPS if steps is None else steps
    rng = np.random.default_rng(seed)
    windows = np.asarray(windows, np.int64).reshape(-1, 2 * BLOCK + 1)
    adam = Adam(start(windows, size, rng))
    for step in range(1, steps + 1 if len(windows) else 1):
        adam.update(windows[rng.integers(0, len(windows), BATCH)], RATE * min(1, step / 50) * (1 - 0.9 * step / steps))
    return adam.state


def covered(ids: np.ndarray, per: np.ndarray, first: int, last: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Batches of windows in drawn order that learn every token of all texts once, and the `last` after each text: `per` ids a text, and `first` before them."""
    span = LEARNT * BLOCK
    rows = per // span + 1  # per + 1 tokens to learn
    length = BLOCK + span * rows + 1
    base = np.cumsum(length) - length
    flat = np.full(int(length.sum()), OUTSIDE, np.int32)
    flat[base + BLOCK], flat[base + BLOCK + 1 + per], flat[runs(base + BLOCK + 1, per)] = first, last, ids
    begins = rng.permutation(np.repeat(base, rows) + span * runs(np.zeros(len(rows), np.int64), rows))
    for i in range(0, len(begins), ROUND // span):
        yield flat[begins[i : i + ROUND // span, None] + np.arange(BLOCK + span + 1)].astype(np.int64)


def train(windows: np.ndarray, size: int, steps: int | None = None, seed: int = 7) -> Model:
    """The model that fitted() gives."""
    return fitted(windows, size, steps, seed).model()


def moved(state: State, batches: Iterator[np.ndarray], rate: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One pass over batches of windows from a copy of the state: (rows of State.rows(), how much each counts, its change), or nothing without windows."""
    adam = Adam(state.of_rows(state.rows()))
    for windows in batches:
        adam.update(windows, rate)
    if adam.windows:
        old, new = state.rows(), adam.state.rows()
        weight = np.full(len(old), adam.windows, np.int64)
        weight[: len(adam.seen)] = adam.seen
        at = np.flatnonzero(weight)
        yield at, weight[at], new[at] - old[at]
