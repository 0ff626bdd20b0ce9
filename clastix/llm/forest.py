"""A random forest of binary decision trees, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees; a leaf is its own child. roots: the first node of each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The mean share of positives in the leaves that each row reaches."""
        x = np.asarray(x, float)
        row = np.arange(len(x))
        total = np.zeros(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            while True:
                to = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
                if (to == node).all():
                    break
                node = to
            total += self.value[node]
        return total / max(1, len(self.roots))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 0) -> Forest:
    """Each tree sees a bootstrap sample, each node the square root of the number of features, split by Gini impurity."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    rng = np.random.default_rng(seed)
    some = max(1, int(round(x.shape[1] ** 0.5)))
    nodes: list[list[float]] = []
    roots = []

    def build(at: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([0, 0.0, me, me, float(y[at].mean())])
        if level == depth or len(at) < 2 * least or y[at].min() == y[at].max():
            return me
        best = (1e-12, 0, 0.0)
        n, p = len(at), y[at].sum()
        before = 2 * p * (n - p) / n
        for f in rng.choice(x.shape[1], some, replace=False).tolist():
            v = x[at, f]
            order = np.argsort(v, kind="stable")
            v, s = v[order], np.cumsum(y[at][order])
            k = np.flatnonzero(v[1:] > v[:-1]) + 1
            k = k[(k >= least) & (k <= n - least)]
            if not len(k):
                continue
            a, b = s[k - 1], p - s[k - 1]
            gain = before - 2 * a * (k - a) / k - 2 * b * (n - k - b) / (n - k)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), f, float((v[k[i] - 1] + v[k[i]]) / 2))
        if best[0] <= 1e-12:
            return me
        _, f, c = best
        go = x[at, f] <= c
        nodes[me][:2] = f, c
        nodes[me][2] = build(at[go], level + 1)
        nodes[me][3] = build(at[~go], level + 1)
        return me

    for _ in range(trees):
        roots.append(build(rng.integers(0, len(x), len(x)), 0))
    cols = list(zip(*nodes))
    return Forest(np.array(cols[0], int), np.array(cols[1]), np.array(cols[2], int), np.array(cols[3], int), np.array(cols[4]), np.array(roots))
