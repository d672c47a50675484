"""Gradient-boosted trees for a yes-or-no label, on binned features."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Trees of one depth as complete arrays: a split's feature and bin by place in the tree, a value by leaf."""

    def __init__(self, cuts: list[np.ndarray], base: float, depth: int):
        self.cuts, self.base, self.depth = cuts, base, depth
        self.features: list[np.ndarray] = []
        self.bins: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1).astype(np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in zip(self.features, self.bins, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, least: float = 4.0) -> Boosted:
    """Newton boosting of the logistic loss; a split needs a gain and `least` curvature on either side."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1], method="nearest")) for i in range(x.shape[1])]
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(cuts, float(np.log(mean / (1 - mean))), depth)
    b, n_features, z = model.binned(x), x.shape[1], np.full(len(x), float(np.log(mean / (1 - mean))))
    inner, flat = 2**depth - 1, np.arange(n_features) * (BINS + 1)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(len(x), np.int64)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if len(rows):
                    key = (b[rows] + flat).ravel()
                    sums = [np.bincount(key, np.repeat(v[rows], n_features), n_features * (BINS + 1)).reshape(n_features, -1).cumsum(axis=1) for v in (g, h)]
                    (gl, hl), (gt, ht) = sums, (g[rows].sum(), h[rows].sum())
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < least) | (ht - hl < least)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[node], cut[node] = divmod(best, BINS + 1)
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        z += value[leaf]
        model.features.append(feature)
        model.bins.append(cut)
        model.values.append(value)
    return model
