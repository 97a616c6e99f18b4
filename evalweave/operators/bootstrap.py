"""Seeded bootstrap intervals of a mean, reproducible to the last bit.

Draws come from the linear congruential generator s' = (A s + C) mod 2**32. Its
k-th state has a closed form, so all draws of an iteration are made at once, and
groups of one size share their index matrix.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_A, _C = np.uint32(1664525), np.uint32(1013904223)
#: Draws made at a time, to bound memory.
_DRAWS = 1 << 22


@lru_cache(maxsize=8)
def _jump(n: int) -> tuple[np.ndarray, np.ndarray]:
    """a**k and the sum of c * a**j for k = 1..n, modulo 2**32."""
    a = np.multiply.accumulate(np.full(n, _A, dtype=np.uint32), dtype=np.uint32)
    below = np.concatenate([np.ones(1, np.uint32), a[:-1]])
    return a, np.add.accumulate(below, dtype=np.uint32) * _C


def sample_means(values: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Means of resamples, in the order of iterations; sums run from left to right."""
    n = len(values)
    state = np.uint32(math.trunc(seed) & 0xFFFFFFFF)
    out = np.empty(iterations)
    step = max(1, _DRAWS // n)
    for lo in range(0, iterations, step):
        rounds = min(step, iterations - lo)
        a, c = _jump(rounds * n)
        states = a * state + c
        index = (states.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)
        out[lo : lo + rounds] = np.cumsum(values[index.astype(np.int64)].reshape(rounds, n), axis=1)[:, -1] / n
        state = states[-1]
    return out


def _rank(sorted_values: np.ndarray, share: float) -> float:
    return float(sorted_values[math.floor(share * (len(sorted_values) - 1) + 0.5)])


def interval(values: np.ndarray, iterations: int = 1000, confidence: float = 0.95, seed: int = 1) -> tuple[float, float]:
    """Percentile interval of the mean."""
    means = np.sort(sample_means(np.asarray(values, dtype=float), iterations, seed))
    alpha = 1 - confidence
    return _rank(means, alpha / 2), _rank(means, 1 - alpha / 2)


def check_options(iterations: int, confidence: float, seed: float) -> list[str]:
    """What is wrong with bootstrap options."""
    bad = []
    if not isinstance(iterations, int) or iterations <= 0:
        bad.append("iterations must be a positive integer")
    if not 0 < confidence < 1:
        bad.append("confidence must lie between 0 and 1")
    if not math.isfinite(seed):
        bad.append("seed must be finite")
    return bad


def mean_intervals(values: DataFrame, keys: list[str], order: str, iterations: int = 1000, confidence: float = 0.95, seed: int = 1) -> DataFrame:
    """keys, n, mean, lower, upper for each group of (keys, value, order); values resampled in that order."""
    if bad := check_options(iterations, confidence, seed):
        raise ValueError("; ".join(bad))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in values.select(*keys).schema)
    sized = values.where("value is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))).alias("x")).select(*keys, F.col("x.v").alias("v"))

    def run(batches):
        for pdf in batches:
            rows = [(len(v), float(np.cumsum(v)[-1] / len(v)), *interval(np.asarray(v, dtype=float), iterations, confidence, seed)) for v in pdf["v"]]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=["n", "mean", "lower", "upper"])], axis=1)

    return sized.mapInPandas(run, f"{fields}, n long, mean double, lower double, upper double")
