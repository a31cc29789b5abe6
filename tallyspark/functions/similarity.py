"""Jaro-Winkler similarity with the prefix bonus at every level, vectorised over Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=200_000)
def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = list(b), []
    taken = [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and free[j] == x:
                taken[j] = True
                left.append(x)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [y for y, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    score = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return score + 0.1 * prefix * (1 - score)


@F.arrow_udf(T.DoubleType())
def _winkler(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([winkler(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


_winkler = _winkler.asNondeterministic()  # run once, also under filters


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity in [0, 1]; null if either text is null."""
    return _winkler(a, b)
