"""Gradient-boosted trees for yes-or-no labels: binned features, depth-wise growth, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Trees:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values; heap order
    depth: int = 3

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, split, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    m = Trees(edges, float(np.log(p / (1 - p))), [], depth)
    b = m.binned(x)
    n, f = b.shape
    logit = np.full(n, m.base)
    cells = b + np.arange(f)[None, :] * BINS
    for _ in range(trees):
        q = 1 / (1 + np.exp(-logit))
        g, h = y - q, q * (1 - q) + 1e-9
        feature, split = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            lo = 2**level - 1
            width = f * BINS
            at = ((node - lo)[:, None] * width + cells).ravel()
            hg = np.bincount(at, np.repeat(g, f), 2**level * width).reshape(-1, f, BINS).cumsum(axis=2)
            hh = np.bincount(at, np.repeat(h, f), 2**level * width).reshape(-1, f, BINS).cumsum(axis=2)
            tg, th = hg[:, :, -1:], hh[:, :, -1:]
            gain = hg**2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg**2 / (th + ridge)
            best = gain.reshape(len(gain), -1).argmax(axis=1)
            ok = gain.reshape(len(gain), -1)[np.arange(len(gain)), best] > 1e-6
            feature[lo : lo + len(gain)] = best // BINS
            split[lo : lo + len(gain)] = np.where(ok, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > split[node])
        leaf_of = node - (2**depth - 1)
        leaf = rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + ridge)
        m.trees.append((feature, split, leaf))
        logit += leaf[leaf_of]
    return m
