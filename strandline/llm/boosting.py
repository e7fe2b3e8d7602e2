"""Gradient-boosted decision trees for two classes, in numpy.

Features are cut into at most ``BINS`` quantile bins; each tree grows level by
level from histograms of gradients and hessians of the logistic loss.  Fitting
is deterministic: no sampling, ties go to the lower feature and bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Boosted:
    """Complete binary trees: feature and threshold by node, value by leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (len(v) - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row; none for no rows."""
        return 1 / (1 + np.exp(-self.margin(np.asarray(x, float)))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least_hessian: float = 1.0) -> Boosted:
    """Fit on rows ``x`` with classes ``y`` (0 or 1); one class alone gives a constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    mean = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(mean / (1 - mean)))
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        f_tree, t_tree = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best_gain, best_f, best_c = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, -1)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = len(cuts[j]) + 1
                key = at * k + bins[:, j]
                gs = np.bincount(key, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(key, h, width * k).reshape(width, k).cumsum(1)
                gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least_hessian) | (ht - hl < least_hessian)] = -1
                c = gain.argmax(1)
                top = gain[np.arange(width), c]
                better = top > best_gain + 1e-12
                best_gain[better], best_f[better], best_c[better] = top[better], j, c[better]
            split = best_c >= 0
            for w in np.flatnonzero(split):
                f_tree[first + w], t_tree[first + w] = best_f[w], cuts[best_f[w]][best_c[w]]
            right = split[at] & (bins[np.arange(n), best_f[at]] > best_c[at])
            node = 2 * node + 1 + right
        leaf = node - (2**depth - 1)
        v = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + l2)
        score += v[leaf]
        features.append(f_tree)
        thresholds.append(t_tree)
        values.append(v)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(values))
