"""A binary decision tree grown on a small table by Gini impurity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    """A split (feature, threshold, low, high), or a leaf with the share of positives."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    share = float(y.mean())
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return Node(share)
    best = (2 * share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        cost = 2 * n * a * (1 - a) + 2 * (len(y) - n) * b * (1 - b)
        cost[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        if (i := int(np.argmin(cost))) >= 0 and cost[i] < best[0]:
            best = (float(cost[i]), f, float(v[i] + v[i + 1]) / 2)
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def predict(node: Node, row) -> float:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.threshold else node.high
    return node.share
