"""Logistic calibration of a few features by damped Newton steps (numpy)."""

from __future__ import annotations

import numpy as np


def fit(features: np.ndarray, labels: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the intercept last.  Without both classes: the intercept alone,
    set to the observed share (half a row added to each class)."""
    n, d = features.shape
    if n == 0 or labels.min() == labels.max():
        positive = float(labels.sum())
        return np.append(np.zeros(d), np.log((positive + 0.5) / (n - positive + 0.5)))
    centre, scale = features.mean(0), features.std(0)
    scale = np.where(scale > 0, scale, 1.0)
    x = np.column_stack([(features - centre) / scale, np.ones(n)])
    penalty = np.diag(np.append(np.full(d, l2), 1e-6))
    w = np.zeros(d + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + penalty @ w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:d] / scale
    return np.append(weights, w[d] - weights @ centre)


def predict(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
