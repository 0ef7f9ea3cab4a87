"""Penalised logistic regression of few samples on few columns, its inner search, and averaged curves.

The tables here have a row per sample and a column per cluster, bounded by the model's size.
Every fit of a sweep is a row of a table of jobs, so fits are dealt over the cluster's tasks.
Larger tables go to Spark ML (``stats.logistic``).
"""

from __future__ import annotations

import math

import numpy as np

#: Penalties that the search tries: even steps of the logarithm.
PENALTIES = tuple(10 ** (-4 + 8 * k / 9) for k in range(10))


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights by which both classes count alike."""
    n, p = len(y), y.sum()
    return np.where(y, n / (2 * max(p, 1)), n / (2 * max(n - p, 1)))


def fit(x: np.ndarray, y: np.ndarray, c: float, l1: float = 1.0, start: np.ndarray | None = None, most: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coefficients and intercept (last, without penalty) that minimise the penalty plus ``c`` times the balanced log loss.

    Proximal gradient steps with momentum, restarted when they climb.
    """
    weights = c * balanced(y)
    a = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (np.linalg.norm(a * np.sqrt(weights)[:, None] / 2, 2) ** 2 + (1 - l1) + 1e-12)
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    shrink = np.append(np.full(x.shape[1], step * l1), 0.0)
    ridge = np.append(np.full(x.shape[1], 1 - l1), 0.0)
    for _ in range(most):
        p = 1 / (1 + np.exp(-np.clip(a @ ahead, -500, 500)))
        moved = ahead - step * (a.T @ (weights * (p - y)) + ridge * ahead)
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        if (ahead - new) @ (new - w) > 0:
            ahead, t = w.copy(), 1.0
            continue
        nxt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nxt * (new - w)
        done = np.abs(new - w).max() <= tol * max(1.0, np.abs(new).max())
        w, t = new, nxt
        if done:
            break
    return w


def scores(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))


def stratified(y: np.ndarray, k: int) -> np.ndarray:
    """Fold of each row: unshuffled, class sizes by dealing the sorted labels round-robin."""
    fold = np.zeros(len(y), int)
    dealt = np.sort(y.astype(int))
    for c in (0, 1):
        sizes = np.bincount(np.flatnonzero(dealt == c) % k, minlength=k)
        fold[np.flatnonzero(y.astype(int) == c)] = np.repeat(np.arange(k), sizes)
    return fold


def repeated(n: int, k: int, seed: int) -> np.ndarray:
    """Fold of each row: shuffled, without regard to labels; the first folds have a row more."""
    fold = np.empty(n, int)
    fold[np.random.default_rng(seed).permutation(n)] = np.repeat(np.arange(k), [n // k + (f < n % k) for f in range(k)])
    return fold


def search(x: np.ndarray, y: np.ndarray, folds: int, penalties: tuple[float, ...] = PENALTIES, l1: float = 1.0) -> tuple[np.ndarray, float]:
    """The fit on all rows by the penalty of the best mean accuracy over inner folds (the first of equals), and that penalty."""
    fold = stratified(y, folds)
    right = np.zeros(len(penalties))
    for f in range(folds):
        w = None
        for k, c in enumerate(penalties):
            w = fit(x[fold != f], y[fold != f], c, l1, w)
            right[k] += ((scores(w, x[fold == f]) > 0.5) == y[fold == f]).mean() if (fold == f).any() else 0
    best = penalties[int(right.argmax())]
    return fit(x, y, best, l1), best


def curve(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """False and true positive rates after each distinct score, descending, from (0, 0)."""
    order = np.argsort(-score, kind="stable")
    last = np.append(np.flatnonzero(np.diff(score[order])), len(y) - 1)
    tp, n = np.cumsum(y[order])[last], last + 1
    return np.append(0, (n - tp) / max(1, (~y).sum())), np.append(0, tp / max(1, y.sum()))


def on_grid(fpr: np.ndarray, tpr: np.ndarray, grid: int = 100) -> np.ndarray:
    """True positive rates on an even grid, from 0."""
    out = np.interp(np.linspace(0, 1, grid), fpr, tpr)
    out[0] = 0
    return out


def area(curves: np.ndarray) -> float:
    """The area under the mean of curves on a grid; it ends in 1."""
    mean = curves.mean(axis=0)
    mean[-1] = 1
    return float(((mean[1:] + mean[:-1]) / 2).sum() / (len(mean) - 1))
