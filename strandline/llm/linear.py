"""Small linear models fitted on the driver to a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, loss: str, l2: float = 1e-3, rounds: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) of a linear model of labels 0 and 1 by accelerated gradient steps.

    ``loss`` is "hinge" (squared hinge: a support vector machine) or "logistic". Columns are
    centred and scaled first; the returned weights fit the given columns. Labels of one class
    only give a constant model.
    """
    n = len(y)
    share = float(np.mean(y)) if n else 0.5
    if not n or share in (0.0, 1.0):
        return np.zeros(x.shape[1]), float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))
    mean, scale = x.mean(0), x.std(0) + 1e-3 * x.std() + 1e-12
    z = x - mean
    z /= scale
    z = z.astype(np.float32, copy=False)
    weight = (np.ones(n) if weight is None else weight).astype(np.float32)
    weight = weight / weight.mean()
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (weight * (z @ v))
        norm = float(np.linalg.norm(v)) or 1.0
        v /= norm
    curve = {"hinge": 2.0, "logistic": 0.25}[loss]
    step = 1.0 / (1.1 * curve * (norm / n + 1.0) + l2)
    sign = np.where(y > 0, 1.0, -1.0).astype(np.float32)
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    w0, b0 = w, b
    for k in range(rounds):
        m = k / (k + 3.0)
        u, c = w + m * (w - w0), b + m * (b - b0)
        margin = z @ u + c
        slope = -2.0 * sign * np.maximum(0.0, 1.0 - sign * margin) if loss == "hinge" else sigmoid(margin) - (y > 0)
        slope = (weight * slope).astype(np.float32)
        w0, b0 = w, b
        w, b = u - step * (z.T @ slope / n + l2 * u), c - step * float(slope.mean())
    out = w.astype(np.float64) / scale
    return out, float(b - out @ mean)


def calibrated(margin: np.ndarray, y: np.ndarray, rounds: int = 40) -> tuple[float, float]:
    """(slope, offset) such that sigmoid(slope * margin + offset) is the share of label 1 (Platt).

    Labels are smoothed towards one half, so that separable margins give finite slopes.
    """
    n1, n0 = float(np.sum(y > 0)), float(np.sum(y <= 0))
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[np.sum(h * margin**2), np.sum(h * margin)], [np.sum(h * margin), np.sum(h)]]) + 1e-6 * np.eye(2)
        da, db = np.linalg.solve(hess, [np.sum(g * margin), np.sum(g)])
        size = max(1.0, float(np.hypot(da, db)))
        a, b = a - da / size, b - db / size
    return float(a), float(b)
