"""Logistic regression on sparse rows, and calibration of its margins."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Sparse(NamedTuple):
    """Rows in compressed form: row i has columns at[bounds[i]:bounds[i + 1]]."""

    bounds: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def rows(self) -> int:
        return len(self.bounds) - 1


def stacked(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
    sizes = [len(a) for a, _ in rows]
    empty_at, empty_value = np.zeros(0, np.int32), np.zeros(0, np.float32)
    return Sparse(
        np.concatenate(([0], np.cumsum(sizes))).astype(np.int64),
        np.concatenate([a for a, _ in rows] or [empty_at]).astype(np.int32),
        np.concatenate([v for _, v in rows] or [empty_value]).astype(np.float32),
    )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def margins(x: Sparse, w: np.ndarray, bias: float | np.ndarray) -> np.ndarray:
    out = np.zeros(x.rows())
    held = np.flatnonzero(np.diff(x.bounds))
    if len(held):
        product = w.astype(np.float32)[x.at]
        product *= x.value
        out[held] = np.add.reduceat(product, x.bounds[held], dtype=np.float64)
    return out + bias


def fit(
    x: Sparse, y: np.ndarray, width: int, l2: float = 1e-6, rounds: int = 60, rate: float = 0.5
) -> tuple[np.ndarray, float]:
    """Weights and bias of a binary logistic regression, by full-batch Adam steps."""
    n = max(1, x.rows())
    owner = np.repeat(np.arange(x.rows(), dtype=np.int32), np.diff(x.bounds))
    w, bias = np.zeros(width, np.float64), 0.0
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, rounds + 1):
        gap = sigmoid(margins(x, w, bias)) - y
        pull = gap.astype(np.float32)[owner]
        pull *= x.value
        g = np.bincount(x.at, weights=pull, minlength=width) / n + l2 * w
        gb = float(gap.mean()) if len(gap) else 0.0
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.2 * rate * (mb / a) / ((vb / b) ** 0.5 + 1e-8)
    return w.astype(np.float32), bias


def newton(x: np.ndarray, y: np.ndarray, prior: np.ndarray, precision: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a small dense logistic regression, drawn towards ``prior``."""
    w = prior.astype(np.float64).copy()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + precision * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + precision * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        step *= min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibration(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) that turn margins into log odds (Platt scaling with smoothed targets)."""
    if len(z) == 0:
        return 1.0, 0.0
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x = np.stack([z, np.ones_like(z)], axis=1)
    slope, offset = newton(x, target, np.array([1.0, 0.0]), 0.1)
    return max(1e-3, float(slope)), float(offset)
