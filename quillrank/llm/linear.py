"""What the two classifiers share: hashed byte n-grams, bounded labelled samples, linear solvers in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import load8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(flat: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash in [0, 2^bits) of the n bytes (n <= 8, A-Z lowered) from each place on; the last n - 1 places run into zeros."""
    low = np.zeros(len(flat) + 8, np.uint8)
    np.take(_LOWER, flat, out=low[: len(flat)])
    h = load8(low)[: len(flat)] << np.uint64(64 - 8 * n)
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(64 - bits)).astype(np.int32)


def bounded(rows: DataFrame, key: str, group: Column, bound: int, name: str = "group") -> DataFrame:
    """rows with column `group`, at about `bound` rows for each of its values, chosen by a hash of the key; all, where there are no more."""
    rows = rows.withColumn(name, group)
    counts = {r[name]: r["count"] for r in rows.groupBy(name).count().collect()}  # one row a class
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(name).eqNullSafe(F.lit(value)), F.lit(min(1.0, bound / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30) < share)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept of class-balanced logistic regression, by accelerated gradient steps of the largest safe size."""
    n = len(y)
    share = float(y.mean())
    weight = (np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n).astype(np.float32)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest curvature, by power iteration
        top /= max(np.linalg.norm(top), 1e-9)
        top = x.T @ (weight * (x @ top))
    rate = np.float32(1 / (0.3 * float(np.linalg.norm(top)) + 0.3 + l2))
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    for t in range(1, steps + 1):
        err = (1 / (1 + np.exp(-np.clip(x @ v[:-1] + v[-1], -30, 30))) - y).astype(np.float32) * weight
        new = v - rate * np.append(x.T @ err + np.float32(l2) * v[:-1], err.sum()).astype(np.float32)
        v = new + np.float32((t - 1) / (t + 2)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 20, seed: int = 7) -> np.ndarray:
    """Weights, intercept last, of a linear support vector machine with squared hinge loss: dual coordinate descent. y is -1 or 1."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    diag = 0.5 / c
    norm = (x * x).sum(axis=1) + diag
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + diag * a[i]
            if a[i] == 0 and g >= 0:
                continue
            new = max(a[i] - g / norm[i], 0.0)
            w += (new - a[i]) * y[i] * x[i]
            moved = max(moved, abs(new - a[i]))
            a[i] = new
        if moved < 1e-3:
            break
    return w
