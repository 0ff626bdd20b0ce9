"""Linear models with a logistic link over dense or sparse rows, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients, the last for the constant, by Newton's method; y may be probabilities."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.ones(len(x)) if weight is None else weight
    b = np.zeros(x.shape[1])
    r = np.full(len(b), ridge)
    r[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ b)
        g = x.T @ (w * (p - y)) + r * b
        h = (x * (w * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(r)
        step = np.linalg.solve(h, g)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


class Rows:
    """Sparse rows: row i has value[k] in column index[k] for start[i] <= k < start[i + 1], and dense columns beside them."""

    def __init__(self, start: np.ndarray, index: np.ndarray, value: np.ndarray, dense: np.ndarray):
        self.start, self.index, self.value, self.dense = start, index, value, dense
        self.row = np.repeat(np.arange(len(start) - 1), np.diff(start))

    def dot(self, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, b[self.index] * self.value, len(self.start) - 1) + self.dense @ c

    def take(self, at: np.ndarray) -> Rows:
        size = np.diff(self.start)[at]
        start = np.append(0, np.cumsum(size))
        k = np.repeat(self.start[at] - start[:-1], size) + np.arange(start[-1])
        return Rows(start, self.index[k], self.value[k], self.dense[at])

    def beside(self, *columns: np.ndarray) -> Rows:
        """The same rows with more dense columns."""
        return Rows(self.start, self.index, self.value, np.column_stack([self.dense, *columns]))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    return float((a * b).sum())  # without threads


def fit_sparse(x: Rows, y: np.ndarray, width: int, ridge: float = 2.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the sparse columns, of the dense ones), by limited-memory quasi-Newton steps with backtracking."""
    k = x.dense.shape[1]
    positive = max(1.0, y.sum())
    w = np.where(y > 0, max(1.0, (len(y) - positive) / positive) ** 0.5, 1.0)
    penalty = np.append(np.full(width, ridge), np.full(k, 1e-3))

    def value(b: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x.dot(b[:width], b[width:]), -35, 35)
        p = sigmoid(z)
        e = w * (p - y)
        g = np.append(np.bincount(x.index, e[x.row] * x.value, width), (x.dense * e[:, None]).sum(0)) + penalty * b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + (penalty * b * b).sum() / 2), g

    b = np.zeros(width + k)
    f, g = value(b)
    old: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, d in reversed(old):
            a = _dot(s, q) / _dot(s, d)
            alphas.append(a)
            q -= a * d
        if old:
            q *= _dot(*old[-1]) / _dot(old[-1][1], old[-1][1])
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, d), a in zip(old, reversed(alphas)):
            q += s * (a - _dot(d, q) / _dot(s, d))
        step, slope = 1.0, _dot(g, q)
        while step > 1e-6:
            new = b - step * q
            f2, g2 = value(new)
            if f2 <= f - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = new - b, g2 - g
        if _dot(s, d) > 1e-12:
            old = [*old[-7:], (s, d)]
        done = f - f2 < 1e-7 * max(1.0, abs(f))
        b, f, g = new, f2, g2
        if done:
            break
    return b[:width], b[width:]
