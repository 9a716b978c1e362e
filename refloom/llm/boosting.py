"""Gradient-boosted trees with monotonic constraints, fitted and scored in numpy.

Trees are complete binary trees of one depth, kept as flat node arrays: children of node i are 2i+1 and 2i+2, a row
goes right where its feature is above the threshold.  Scoring moves all rows one level per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: int = 5) -> Forest:
    """Logistic boosting.  monotone[f] is -1, 0 or 1: the sign that the score's change with feature f may have.

    Without rows of both labels the forest has no trees and returns the mean label (0.5 without rows).
    """
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    start, inner, leaves = float(np.log(mean / (1 - mean))), 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    total = np.full(len(y), start)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        feature, threshold, value, node = _tree(codes, edges, y - p, p * (1 - p), monotone, depth, ridge, least)
        value *= rate
        total += value[node]
        found.append((feature, threshold, value))
    return Forest(*(np.stack(part) for part in zip(*found)), start)


def _tree(codes, edges, grad, hess, monotone, depth, ridge, least):
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
    low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
    node = np.zeros(len(grad), np.int64)
    for at in range(inner):
        low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
        own = np.flatnonzero(node == at)
        split = _best(codes[:, own], edges, grad[own], hess[own], monotone, low[at], high[at], ridge, least) if len(own) >= 2 * least else None
        if split is None:  # all rows go left
            node[own] = 2 * at + 1
            continue
        feature[at], cut, left, right = split
        threshold[at] = edges[feature[at]][cut]
        sign, middle = monotone[feature[at]], (left + right) / 2
        if sign > 0:
            high[2 * at + 1], low[2 * at + 2] = middle, middle
        elif sign < 0:
            low[2 * at + 1], high[2 * at + 2] = middle, middle
        node[own] = 2 * at + 1 + (codes[feature[at], own] > cut)
    leaf = node - inner
    g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return feature, threshold, np.clip(g / (h + ridge), low[inner:], high[inner:]), leaf


def _best(codes, edges, grad, hess, monotone, low, high, ridge, least):
    g, h = grad.sum(), hess.sum()
    best, most = None, g * g / (h + ridge) + 1e-9
    for f in range(len(codes)):
        bins = len(edges[f]) + 1
        if bins < 2:
            continue
        gl, hl, nl = (np.cumsum(np.bincount(codes[f], w, bins))[:-1] for w in (grad, hess, None))
        left, right = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
        gain = 2 * gl * left - (hl + ridge) * left**2 + 2 * (g - gl) * right - (h - hl + ridge) * right**2
        gain[(nl < least) | (len(grad) - nl < least) | ((right - left) * monotone[f] < 0)] = -np.inf
        cut = int(np.argmax(gain))
        if gain[cut] > most:
            best, most = (f, cut, left[cut], right[cut]), gain[cut]
    return best
