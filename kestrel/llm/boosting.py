"""Gradient-boosted trees with logistic loss on a small feature matrix (driver side, bounded sample)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEPTH, ROUNDS, RATE, BINS, LEAST = 3, 80, 0.2, 16, 5


@dataclass
class Boosted:
    base: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)   # per tree, inner nodes in heap order
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2 ** DEPTH - 1)]
        return out


def _split(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The (feature, cut) with the largest gain; a cut of +inf sends every row left."""
    best, at = 1e-6, (0, np.inf)
    total = g.sum() ** 2 / (h.sum() + 1)
    for f, values in enumerate(cuts):
        for c in values:
            left = x[:, f] <= c
            n = left.sum()
            if LEAST <= n <= len(x) - LEAST:
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - total
                if gain > best:
                    best, at = gain, (f, float(c))
    return at


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Boosted:
    """Fit trees of depth ``DEPTH`` one after another to the gradient of the logistic loss."""
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))))
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        values = values if len(values) <= BINS else np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS))
        cuts.append(values[:-1] if len(values) > 1 else values[:0])
    score = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        if np.abs(g).max() < 0.01:
            break
        feature, cut = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, np.inf)
        node = np.zeros(len(y), int)
        for n in range(2 ** DEPTH - 1):
            rows = np.flatnonzero(node == n)
            if len(rows) >= 2 * LEAST:
                feature[n], cut[n] = _split(x[rows], cuts, g[rows], h[rows])
            node[rows] = 2 * n + 1 + (x[rows, feature[n]] > cut[n])
        leaf = node - (2 ** DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1)
        score += value[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
    return model


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a raw + b))) is calibrated, by Newton steps with smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (t - p))
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
