"""What the trained operators share: bounded samples by hash and an optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed_share(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About most of the rows, or all if there are fewer, chosen by the hash of their key."""
    have = rows.count()
    return rows if have <= most else rows.where(hashed_share(F.col(key), seed) < most / have)


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))
