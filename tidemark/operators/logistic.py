"""Logistic regression over blocks of sparse rows: a pass sums loss and gradient, L-BFGS takes the steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .blocks import Block, Passes, Slots

#: Steps that the curvature is taken from, and tries for a step's length.
MEMORY, TRIES = 10, 30
#: The largest slope, and the least share of the loss gained, that steps go on for.
SLOPE, GAINED = 1e-7, 1e-12


@dataclass
class Logistic:
    weights: np.ndarray
    intercept: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(x @ self.weights + self.intercept)))


@dataclass
class Losses:
    """Sums of loss, gradient by feature and by intercept, rows, and rows with label 1."""

    weights: np.ndarray
    idf: np.ndarray
    intercept: float
    base: np.ndarray

    def __call__(self, b: Block) -> np.ndarray:
        ends = b.starts[self.base]
        each = np.repeat(self.weights * self.idf, np.diff(ends)) * b.times
        margin = np.bincount(b.rows, each, len(b.y)) / b.norm + self.intercept
        off = 1 / (1 + np.exp(-margin)) - b.y
        some = np.flatnonzero(np.diff(ends))
        out = np.zeros(len(self.weights) + 4)
        if len(some):
            out[1 + some] = np.add.reduceat((off / b.norm)[b.rows] * b.times, ends[some]) * self.idf[some]
        out[0], out[-3:] = (np.logaddexp(0, margin) - b.y * margin).sum(), (off.sum(), len(b.y), b.y.sum())
        return out


def descend(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS from w; a step's length is halved or grown until loss and slope fall enough (weak Wolfe conditions)."""
    f, g = loss(w)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() <= SLOPE:
            break
        d, kept = -g, []
        for s, y in reversed(moved):
            a = s @ d / (s @ y)
            kept.append(a)
            d = d - a * y
        if moved:
            s, y = moved[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(moved, reversed(kept), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        slope, low, high, t = g @ d, 0.0, np.inf, 1.0 if moved else 1 / np.linalg.norm(g)
        for _ in range(TRIES):
            new_f, new_g = loss(w + t * d)
            if new_f > f + 1e-4 * t * slope:
                high = t
            elif new_g @ d < 0.9 * slope:
                low = t
            else:
                break
            t = (low + high) / 2 if high < np.inf else 2 * t
        if new_f >= f:
            break
        gained = f - new_f
        if (new_g - g) @ d > 0:
            moved = [*moved[-MEMORY + 1 :], (t * d, new_g - g)]
        w, f, g = w + t * d, new_f, new_g
        if gained <= GAINED * max(1.0, abs(f)):
            break
    return w


@dataclass
class Regression:
    """Mean loss plus `penalty` / 2 times the squared weights; the intercept is free."""

    idf: np.ndarray
    penalty: float
    steps: int = 500

    def __call__(self, passes: Passes, slots: Slots) -> Logistic:
        size = len(self.idf)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            got = passes(Losses(w[:-1], self.idf, w[-1], slots.base))
            n = got[-2]
            return got[0] / n + self.penalty / 2 * w[:-1] @ w[:-1], got[1 : size + 2] / n + self.penalty * np.append(w[:-1], 0)

        w = np.zeros(size + 1)
        n, ones = passes(Losses(w[:-1], self.idf, 0.0, slots.base))[-2:]
        if not 0 < ones < n:
            return Logistic(w[:-1], np.inf if ones else -np.inf)
        w[-1] = np.log(ones / (n - ones))
        w = descend(loss, w, self.steps)
        return Logistic(w[:-1], float(w[-1]))
