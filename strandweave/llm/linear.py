"""Small linear models, fitted in one place from bounded samples.

A matrix may be given in parts, one below the other; none is copied, and the constant
component that gives the offset is never stored.
"""

from __future__ import annotations

import numpy as np

Parts = np.ndarray | list[np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Stacked:
    """Rows of several matrices with a last component 1."""

    def __init__(self, parts: Parts):
        self.parts = [parts] if isinstance(parts, np.ndarray) else parts
        self.ends = np.cumsum([len(p) for p in self.parts])
        self.width, self.dtype = self.parts[0].shape[1] + 1, self.parts[0].dtype

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.concatenate([p @ w[:-1] for p in self.parts]) + w[-1]

    def turned(self, g: np.ndarray) -> np.ndarray:
        """The transposed matrix times g."""
        out = np.zeros(self.width, self.dtype)
        for p, part in zip(self.parts, np.split(g, self.ends[:-1]), strict=True):
            out[:-1] += p.T @ part
        out[-1] = g.sum()
        return out


def _top_eigenvalue(x: Stacked, rounds: int = 12) -> float:
    v = np.random.default_rng(7).standard_normal(x.width).astype(x.dtype)
    size = 1.0
    for _ in range(rounds):
        v = x.turned(x @ v)
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    return size


def fit_svm(parts: Parts, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by accelerated gradient steps; y is -1 or 1."""
    x = Stacked(parts)
    weight = (weight / weight.sum()).astype(x.dtype)
    step = 1.0 / (2.0 * float(weight.max()) * _top_eigenvalue(x) + ridge)
    w = z = np.zeros(x.width, x.dtype)
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - y * (x @ z)).astype(x.dtype)
        gradient = -2.0 * x.turned(weight * y * slack) + ridge * z
        after = z - step * gradient
        z = after + (k / (k + 3.0)) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def fit_logistic(parts: Parts, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; y is a probability from 0 to 1."""
    x = Stacked(parts)
    weight = np.ones(len(y)) if weight is None else weight
    weight = (weight / weight.sum()).astype(x.dtype)
    step = 1.0 / (0.25 * float(weight.max()) * _top_eigenvalue(x) + ridge)
    w = z = np.zeros(x.width, x.dtype)
    for k in range(rounds):
        gradient = x.turned((weight * (sigmoid(x @ z) - y)).astype(x.dtype)) + ridge * z
        after = z - step * gradient
        z = after + (k / (k + 3.0)) * (after - w)
        w = after
    return w[:-1], float(w[-1])


def fit_platt(margin: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities; y is 0 or 1, softened by Platt's targets."""
    pos, neg = float((y > 0.5).sum()), float((y <= 0.5).sum())
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g = np.array([((p - t) * margin).sum() + 1e-3 * (a - 1), (p - t).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -5, 5)), b - float(np.clip(db, -5, 5))
    return max(a, 1e-3), b
