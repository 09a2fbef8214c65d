"""A linear-chain conditional random field over two labels, with all sequences of a batch in flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

STEPS = 64
#: Positions that training holds sums of at once: whole sequences, and so many besides at most.
PART = 100_000
_CLIP = 20.0


def scan(n0: np.ndarray, n1: np.ndarray, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
    """r[t] = (n0[t] + n1[t] r[t-1]) / (d0[t] + d1[t] r[t-1]), exactly, from r[-1] = 1. Blocks of STEPS terms are
    first composed into one map each, so that numpy steps through all blocks at once."""
    size = len(n0)
    blocks = -(-size // STEPS)
    shaped = []
    for x, pad in ((n0, 0.0), (n1, 1.0), (d0, 1.0), (d1, 0.0)):
        full = np.full(blocks * STEPS, pad)
        full[:size] = x
        shaped.append(np.ascontiguousarray(full.reshape(blocks, STEPS).T))
    a, b, c, d = shaped
    up = [np.zeros(blocks), np.ones(blocks)]  # numerator: constant, factor of r
    down = [np.ones(blocks), np.zeros(blocks)]
    for t in range(STEPS):
        top = [a[t] * down[k] + b[t] * up[k] for k in (0, 1)]
        low = [c[t] * down[k] + d[t] * up[k] for k in (0, 1)]
        norm = 1.0 / (low[0] + low[1])
        up, down = [x * norm for x in top], [x * norm for x in low]
    first, r = [], 1.0
    for u0, u1, v0, v1 in zip(*(x.tolist() for x in (*up, *down)), strict=True):
        first.append(r)
        r = (u0 + u1 * r) / (v0 + v1 * r)
    r, out = np.array(first), np.empty((STEPS, blocks))
    for t in range(STEPS):
        r = (a[t] + b[t] * r) / (c[t] + d[t] * r)
        out[t] = r
    return out.T.ravel()[:size]


@dataclass
class Chain:
    """move: log potentials (from, to) of neighbours; start: log odds of label 1 at a sequence's start."""

    move: np.ndarray
    start: float

    def ratios(self, odds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(odds), and label 1 against label 0 in the forward and in the backward sums, of every position."""
        x, m = np.exp(np.clip(odds, -_CLIP, _CLIP)), np.exp(self.move)
        forward = scan(x * np.where(first, np.exp(self.start), m[0, 1]), x * np.where(first, 0.0, m[1, 1]), np.where(first, 1.0, m[0, 0]), np.where(first, 0.0, m[1, 0]))
        last = np.append(first[1:], True)[::-1]
        after = np.append(x[1:], 1.0)[::-1]
        backward = scan(np.where(last, 1.0, m[1, 0]), np.where(last, 0.0, m[1, 1] * after), np.where(last, 1.0, m[0, 0]), np.where(last, 0.0, m[0, 1] * after))[::-1]
        return x, forward, backward

    def marginals(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of label 1 at every position. odds: what its features say; first: starts of sequences."""
        if not len(odds):
            return np.zeros(0)
        _, forward, backward = self.ratios(odds, first)
        return 1.0 - 1.0 / (1.0 + forward * backward)

    def viterbi(self, odds: list[float]) -> list[int]:
        """The likeliest labels of one sequence."""
        if not odds:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        zero, one, back = 0.0, self.start + odds[0], []
        for x in odds[1:]:
            back.append((int(one + m10 > zero + m00), int(one + m11 > zero + m01)))
            zero, one = max(zero + m00, one + m10), x + max(zero + m01, one + m11)
        labels = [int(one > zero)]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def numbered(features: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, column, row) for train() of the features of each kind."""
    names = {f: k for k, f in enumerate(dict.fromkeys(f for fs in features for f in fs))}
    column = np.fromiter((names[f] for fs in features for f in fs), np.int64)
    return list(names), column, np.repeat(np.arange(len(features)), [len(fs) for fs in features])


@dataclass
class Model:
    chain: Chain
    bias: float
    weights: dict[str, float]

    def odds(self, features: Iterable[str]) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features)


def train(names: list[str], column: np.ndarray, row: np.ndarray, kind: np.ndarray, label: np.ndarray, first: np.ndarray, rounds: int = 40, rate: float = 0.3, decay: float = 1e-6, least: float = 0.02) -> Model:
    """Maximum likelihood by full-batch Adam. names: of the features; column, row: which feature each kind of position
    has; kind: that of every position; label: 0 or 1; first: starts of sequences. Weights below `least` are dropped."""
    size = int(kind.max()) + 1
    at = len(names)
    # weights, then the bias, the start and the four moves
    w, m, v = np.zeros(at + 6), np.zeros(at + 6), np.zeros(at + 6)
    w[at] = -1.0
    total = max(1, len(kind))
    starts = np.append(np.flatnonzero(first), len(kind))
    cuts = [0, *(int(starts[np.searchsorted(starts, at)]) for at in range(PART, len(kind), PART)), len(kind)]
    parts = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    seen = np.zeros(4)
    for part in parts:
        seen += np.bincount((label[part][:-1] * 2 + label[part][1:])[~first[part][1:]], minlength=4)
    for step in range(1, rounds + 1):
        chain = Chain(w[at + 2 :].reshape(2, 2), w[at + 1])
        score = w[at] + np.bincount(row, w[column], size)
        by_kind, grad, mm = np.zeros(size), np.zeros_like(w), np.exp(chain.move)
        grad[at + 2 :] = seen
        for part in parts:
            x, forward, backward = chain.ratios(score[kind[part]], first[part])
            off = label[part] - 1.0 + 1.0 / (1.0 + forward * backward)
            by_kind += np.bincount(kind[part], off, size)
            grad[at] += off.sum()
            grad[at + 1] += off[first[part]].sum()
            inner = ~first[part][1:]
            f, g = forward[:-1][inner], (x * backward)[1:][inner]
            norm = 1.0 / (mm[0, 0] + mm[0, 1] * g + mm[1, 0] * f + mm[1, 1] * f * g)
            grad[at + 2 :] -= [mm[0, 0] * norm.sum(), mm[0, 1] * (g @ norm), mm[1, 0] * (f @ norm), mm[1, 1] * ((f * g) @ norm)]
        grad[:at] = np.bincount(column, by_kind[row], at)
        grad = grad / total - decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    kept = {names[k]: float(w[k]) for k in np.flatnonzero(np.abs(w[:at]) >= least).tolist()}
    return Model(Chain(w[at + 2 :].reshape(2, 2).copy(), float(w[at + 1])), float(w[at]), kept)
