"""Gradient-boosted trees for two classes in numpy: logistic loss, histogram splits, depth-limited trees.

A model is plain lists: a bias, and trees as lists of nodes ``[feature, threshold, left, right, value]`` with feature -1 for a leaf; a row goes
left when its feature is at most the threshold. So a model can be sent anywhere, or written out as column expressions.
"""

from __future__ import annotations

import numpy as np

BINS = 32
COLUMNS = 32  # features of two values that are summed at a time


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def edges_of(column: np.ndarray) -> np.ndarray:
    """Thresholds to try: midpoints between distinct values, at most BINS - 1 of them by quantile."""
    values = np.unique(column)
    middles = (values[1:] + values[:-1]) / 2
    if len(middles) >= BINS:
        middles = middles[np.linspace(0, len(middles) - 1, BINS - 1).astype(int)]
    return middles


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: float, l2: float, rate: float) -> list[list]:
    nodes: list[list] = []
    two = np.array([f for f, cuts in enumerate(edges) if len(cuts) == 1], dtype=np.int64)  # features of two values are summed as matrices
    more = [f for f, cuts in enumerate(edges) if len(cuts) > 1]

    def add(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, -1, -1, float(rate * g / (h + l2))])
        if level == depth or h < 2 * least:
            return at
        best = (1e-9, -1, -1)

        def gains(gs: np.ndarray, hs: np.ndarray) -> np.ndarray:
            gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
            gain[(hs < least) | (h - hs < least)] = -1
            return gain

        own_grad, own_hess = grad[rows], hess[rows]
        found = {}
        both = np.stack([own_grad, own_hess])
        for k in range(0, len(two), COLUMNS):
            some = two[k : k + COLUMNS]
            sums = both @ binned[np.ix_(rows, some)].astype(float)
            found |= {f: (gain, 0) for f, gain in zip(some.tolist(), gains(g - sums[0], h - sums[1]).tolist(), strict=True)}
        for f in more:
            gs, hs = (np.cumsum(np.bincount(binned[rows, f], weights=w, minlength=len(edges[f]) + 1))[:-1] for w in (own_grad, own_hess))
            gain = gains(gs, hs)
            k = int(gain.argmax())
            found[f] = (float(gain[k]), k)
        for f in sorted(found):
            if found[f][0] > best[0] + 1e-9 * abs(best[0]):  # but for rounding
                best = (found[f][0], f, found[f][1])
        if best[1] >= 0:
            _, f, k = best
            left = binned[rows, f] <= k
            nodes[at][:2] = [f, float(edges[f][k])]
            nodes[at][2] = add(rows[left], level + 1)
            nodes[at][3] = add(rows[~left], level + 1)
        return at

    add(np.arange(len(grad)), 0)
    return nodes


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, least: float = 1.0, l2: float = 1.0) -> dict:
    """Ties between splits go to the first feature and the lowest threshold, so a fit has one result."""
    x, y = np.asarray(x), np.asarray(y, dtype=float)
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    edges = [edges_of(x[:, f]) for f in range(x.shape[1])] if len(x) else []
    binned = np.zeros(x.shape, dtype=np.uint8)
    for f, cuts in enumerate(edges):
        binned[:, f] = np.searchsorted(cuts, x[:, f], side="left")
    score, made = np.full(len(y), bias), []
    for _ in range(trees if len(x) else 0):
        p = sigmoid(score)
        tree = grow(binned, edges, y - p, p * (1 - p), depth, least, l2, rate)
        made.append(tree)
        score += values(tree, x)
    return {"bias": bias, "trees": made}


def values(tree: list[list], x: np.ndarray) -> np.ndarray:
    feature, cut = np.array([n[0] for n in tree]), np.array([n[1] for n in tree])
    left, right, value = np.array([n[2] for n in tree]), np.array([n[3] for n in tree]), np.array([n[4] for n in tree])
    at = np.zeros(len(x), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(feature[at] >= 0)
        if not len(open_):
            return value[at]
        here = at[open_]
        at[open_] = np.where(x[open_, feature[here]] <= cut[here], left[here], right[here])


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Log-odds of class 1."""
    out = np.full(len(x), model["bias"])
    for tree in model["trees"]:
        out += values(tree, x)
    return out
