"""Gradient-boosted regression trees for the logistic loss, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 48


@dataclass
class Trees:
    """Complete binary trees of one depth: at each inner node a feature and a threshold, at each leaf a value."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, least: float = 1.0) -> Trees:
    """Second-order boosting; ``least`` is added to the curvature of each leaf."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = np.log(share / (1 - share))
    score = np.full(len(x), base)
    inner = 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            own = at - first
            best, spot = np.full(width, 1e-6), np.zeros(width, dtype=np.int64)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = own * (BINS + 1) + binned[:, f], width * (BINS + 1)
                g = np.cumsum(np.bincount(key, gradient, size).reshape(width, -1), axis=1)
                h = np.cumsum(np.bincount(key, curve, size).reshape(width, -1), axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = (g**2 / (h + least) + (total_g - g) ** 2 / (total_h - h + least) - total_g**2 / (total_h + least))[:, : len(c)]
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + width][better] = f
                threshold[first : first + width][better] = c[top[better]]
                spot[better] = top[better]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > threshold[at])
        leaf_of = at - inner
        g, h = np.bincount(leaf_of, gradient, 2**depth), np.bincount(leaf_of, curve, 2**depth)
        leaf = -rate * g / (h + least)
        score += leaf[leaf_of]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(float(base), np.array(features), np.array(thresholds), np.array(leaves))
