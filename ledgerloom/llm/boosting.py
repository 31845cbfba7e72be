"""Gradient-boosted trees for binary labels in numpy: histogram splits, logistic loss, Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees in arrays: feature and threshold of each inner node, value of each leaf."""

    depth: int = 4
    rounds: int = 40
    rate: float = 0.25
    bins: int = 32
    l2: float = 2.0
    least: float = 8.0
    features: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    leaves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    base: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
        rate0 = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate0 / (1 - rate0)))
        score, inner, ends = np.full(n, self.base), 2**self.depth - 1, 2**self.depth
        fs, ts, vs = [], [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p) + 1e-9
            node, f_of, t_of = np.zeros(n, np.int64), np.full(inner, -1, np.int32), np.full(inner, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = node - first
                best = np.full(count, 1e-6)
                total_g, total_h = np.bincount(at, g, count), np.bincount(at, h, count)
                for f in range(width):
                    size = len(edges[f]) + 1
                    if size < 2:
                        continue
                    code = at * size + binned[:, f]
                    gl = np.bincount(code, g, count * size).reshape(count, size).cumsum(1)[:, :-1]
                    hl = np.bincount(code, h, count * size).reshape(count, size).cumsum(1)[:, :-1]
                    gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (total_g**2 / (total_h + self.l2))[:, None]
                    gain = np.where((hl * 4 < self.least / 4) | (hr * 4 < self.least / 4), 0, gain)
                    k = gain.argmax(1)
                    top = gain[np.arange(count), k]
                    better = top > best
                    best = np.where(better, top, best)
                    ids = np.nonzero(better)[0]
                    f_of[first + ids], t_of[first + ids] = f, edges[f][k[ids]]
                go = np.where(f_of[node] < 0, 0, x[np.arange(n), np.maximum(f_of[node], 0)] > t_of[node]).astype(np.int64)
                node = 2 * node + 1 + go
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, ends) / (np.bincount(leaf, h, ends) + self.l2)
            score += value[leaf]
            fs.append(f_of), ts.append(t_of), vs.append(value)
        self.features, self.thresholds, self.leaves = np.array(fs), np.array(ts), np.array(vs)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, score = len(x), np.full(len(x), self.base)
        rows = np.arange(n)
        for f_of, t_of, value in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(n, np.int64)
            for _ in range(self.depth):
                f = f_of[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > t_of[node]))
            score += value[node - (2**self.depth - 1)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Platt scaling on held-out rows, then the threshold with the best F1 on them."""
        s, a, b = self.raw(x), 1.0, 0.0
        for _ in range(50):  # Newton steps on (a, b), with a weak pull toward (1, 0)
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            w = p * (1 - p)
            grad = np.array([((p - y) * s).sum() + (a - 1), (p - y).sum() + b])
            hess = np.array([[(w * s * s).sum() + 1, (w * s).sum()], [(w * s).sum(), w.sum() + 1]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale = (float(a), float(b))
        p = self.predict(x)
        cuts = np.linspace(0.05, 0.95, 91)
        f1 = [2 * (y * (p >= c)).sum() / max(1, (p >= c).sum() + y.sum()) for c in cuts]
        best = np.nonzero(np.array(f1) >= max(f1) - 1e-9)[0]
        self.threshold = float(cuts[best].mean())
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))
