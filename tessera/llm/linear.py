"""Linear support vector machines on sparse rows, by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, costs: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights w (size + 1, the last for a constant 1) that minimise |w|^2 / 2 + sum of costs * hinge losses.

    ``rows``: (places, values); ``labels``: +1 or -1; ``costs``: one for each row. Each step solves
    one dual variable exactly; the order of rows is drawn anew each epoch.
    """
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    norms = np.array([v @ v + 1.0 for _, v in rows])
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in draw.permutation(len(rows)):
            at, v = rows[k]
            slope = labels[k] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[k] - slope / norms[k], 0.0), costs[k])
            if step := (new - alpha[k]) * labels[k]:
                w[at] += step * v
                w[-1] += step
                alpha[k] = new
                moved = max(moved, abs(step) / costs[k])
        if moved < 1e-3:
            break
    return w


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(a, b): P(positive) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    y = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2), x @ (p - y) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - step
        if abs(step).max() < 1e-6:
            break
    return float(theta[0]), float(theta[1])
