"""Small dense learners for models that are fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 120) -> np.ndarray:
    """Weights (the last is the intercept, without penalty) by accelerated gradient descent on the mean log loss; without
    rows all are 0."""
    n, m = x.shape
    if not n:
        return np.zeros(m + 1)
    x = np.hstack([x, np.ones((n, 1), x.dtype)]).astype(np.float32)
    y = y.astype(np.float32)
    v = np.ones(m + 1, np.float32)
    for _ in range(8):  # the largest curvature, by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = np.float32(1.0 / (0.25 * np.linalg.norm(x @ v) ** 2 / n + l2 / n))
    penalty = np.full(m + 1, l2 / n, np.float32)
    penalty[-1] = 0
    w = ahead = np.zeros(m + 1, np.float32)
    t = 1.0
    for _ in range(steps):
        g = x.T @ (sigmoid(x @ ahead) - y) / n + penalty * ahead
        new = ahead - step * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - w)
        w, t = new, t_new
    return w.astype(float)
