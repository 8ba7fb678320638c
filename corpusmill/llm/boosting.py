"""Gradient-boosted trees, grown with numpy on a bounded sample and compiled into Spark expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf's value, or (feature, bound, tree where feature <= bound, tree elsewhere).
Tree = float | tuple


@dataclass
class Boosted:
    """A sum of trees on the logit scale."""

    base: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:
            total += _values(t, x)
        return 1 / (1 + np.exp(-total))

    def column(self, feature: Callable[[int], Column]) -> Column:
        """The probability as an expression; ``feature`` gives the column of a feature's number."""
        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + _compiled(t, feature)
        return 1.0 / (1.0 + F.exp(-total))


def _values(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, bound, low, high = tree
    return np.where(x[:, f] <= bound, _values(low, x), _values(high, x))


def _compiled(tree: Tree, feature: Callable[[int], Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, bound, low, high = tree
    return F.when(feature(f) <= F.lit(float(bound)), _compiled(low, feature)).otherwise(_compiled(high, feature))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Tree:
    total_g, total_h = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, -1)
    if depth and len(rows) >= 2 * least:
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            n_low = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            g_low = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            h_low = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            gain = g_low**2 / (h_low + ridge) + (total_g - g_low) ** 2 / (total_h - h_low + ridge) - total_g**2 / (total_h + ridge)
            gain = np.where((n_low >= least) & (len(rows) - n_low >= least), gain, 0)
            if gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    _, f, k = best
    if f < 0:
        return float(rate * total_g / (total_h + ridge))
    low = binned[rows, f] <= k
    part = lambda r: _grow(binned, edges, g, h, r, depth - 1, least, ridge, rate)
    return f, float(edges[f][k]), part(rows[low]), part(rows[~low])


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Logistic boosting by second-order histogram trees; the result depends on the rows alone, in their order."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * least or y.min() == y.max():
        return Boosted(base, [])
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        edges.append((values[:-1] + values[1:]) / 2 if len(values) <= bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    score, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = _grow(binned, edges, y - p, p * (1 - p), np.arange(len(y)), depth, least, ridge, rate)
        grown.append(t)
        score += _values(t, x)
    return Boosted(base, grown)


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float | None:
    """The least probability from which on at least ``precision`` of the rows are positive; None if there is none."""
    if not len(p):
        return None
    rank = np.argsort(-p, kind="stable")
    right = np.cumsum(y[rank]) / np.arange(1, len(p) + 1)
    last_of_tie = np.append(p[rank][1:] != p[rank][:-1], True)
    good = np.flatnonzero((right >= precision) & last_of_tie)
    return float(p[rank][good[-1]]) if len(good) else None
