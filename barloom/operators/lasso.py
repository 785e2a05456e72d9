"""Fits from sums of products: a penalised choice of factors, and their weights."""

from __future__ import annotations

import numpy as np


def lasso(gram: np.ndarray, cross: np.ndarray, alpha: float, rounds: int = 1000, close: float = 1e-10) -> np.ndarray:
    """Least squares with a penalty on sizes, on standardised columns: gram = X'X / n, cross = X'y / n."""
    w = np.zeros(len(cross))
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(w)):
            if gram[j, j] <= 0:
                continue
            rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
            new = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[j, j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < close:
            break
    return w


def fit(sums: np.ndarray, p: int, alpha: float, weigher: str) -> dict | None:
    """means, spreads and weights from a symmetric matrix of sums over (1, factors, label)."""
    n = sums[0, 0]
    if n < 10 * p:
        return None
    mean, y = sums[0, 1 : p + 1] / n, sums[0, p + 1] / n
    cov = sums[1 : p + 1, 1 : p + 1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd[sd < 1e-12] = 1.0
    gram, cross = cov / np.outer(sd, sd), (sums[1 : p + 1, p + 1] / n - mean * y) / sd
    chosen = np.abs(lasso(gram, cross, alpha)) > 1e-8
    if not chosen.any():
        chosen[:] = True
    sy = np.sqrt(max(sums[p + 1, p + 1] / n - y * y, 0))
    raw = np.where(chosen, 1.0 if weigher == "equal" or sy < 1e-12 else cross / sy, 0.0)
    total = np.abs(raw).sum()
    return {"mean": mean, "sd": sd, "weight": raw / total if total > 1e-12 else chosen / chosen.sum(), "n": int(n)}
