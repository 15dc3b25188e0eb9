"""Small boosted trees and a lasso, fitted on the driver over bounded samples, and their Spark column forms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A leaf is a float; an inner node is (feature, threshold, low, high), where low takes values <= threshold.
Tree = float | tuple


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, ridge: float = 1.0) -> Tree:
    leaf = float(-g.sum() / (h.sum() + ridge))
    if depth == 0 or len(x) < 2 * least:
        return leaf
    best, gain = None, 1e-6
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        gl, hl = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        score = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
        score[v[1:] == v[:-1]] = -1
        score[: least - 1] = -1
        score[len(score) - least + 1 :] = -1
        k = int(np.argmax(score))
        if score[k] > gain:
            best, gain = (f, float((v[k] + v[k + 1]) / 2)), score[k]
    if best is None:
        return leaf
    low = x[:, best[0]] <= best[1]
    return (*best, grow(x[low], g[low], h[low], depth - 1, least, ridge), grow(x[~low], g[~low], h[~low], depth - 1, least, ridge))


def predict(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, predict(low, x), predict(high, x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int, depth: int = 3, rate: float = 0.3, least: int = 10) -> tuple[float, list[Tree]]:
    """Logistic boosting: the start value and trees whose values add up to the log-odds."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = sigmoid(z)
        tree = scaled(grow(x, p - y, p * (1 - p), depth, least), rate)
        z += predict(tree, x)
        out.append(tree)
    return start, out


def scaled(tree: Tree, by: float) -> Tree:
    return (*tree[:2], scaled(tree[2], by), scaled(tree[3], by)) if isinstance(tree, tuple) else tree * by


def column(tree: Tree, features: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, t, low, high = tree
    return F.when(features[f] <= F.lit(t), column(low, features)).otherwise(column(high, features))


Rule = tuple[tuple[int, bool, float], ...]


def rules(tree: Tree, path: Rule = ()) -> Iterator[Rule]:
    """The conditions (feature, at most, threshold) on the way to each node but the root."""
    if path:
        yield path
    if isinstance(tree, tuple):
        f, t, low, high = tree
        yield from rules(low, (*path, (f, True, t)))
        yield from rules(high, (*path, (f, False, t)))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, low, t in rule:
        out &= (x[:, f] <= t) == low
    return out


def lasso(r: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept (FISTA)."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(k + 1)
    v, t = w.copy(), 1.0
    for _ in range(steps):
        new = v - step * (a.T @ (sigmoid(a @ v) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * strength, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]
