"""Vectors as raw bytes, and which of them take part."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(v: str = "embedding") -> Column:
    """False for null, empty and zero vectors and those with null or non-finite components."""
    x = F.col(v)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & finite & F.exists(x, lambda c: c != 0), F.lit(False))


def scaled(v: str = "embedding") -> Column:
    """A usable vector as doubles times a power of two that brings its largest component near 1; cosines stay the same bits.

    Sums of squares then neither overflow nor vanish, however large or small the components are.
    """
    x = F.transform(F.col(v), lambda c: c.cast("double"))
    largest = F.array_max(F.transform(x, F.abs))
    power = F.pow(F.lit(2.0), -F.greatest(F.least(F.floor(F.log2(largest)), F.lit(1000)), F.lit(-1000)).cast("double"))
    return F.transform(F.arrays_zip(x.alias("c"), F.array_repeat(power, F.size(v)).alias("p")), lambda z: z["c"] * z["p"])


def dot(a: str, b: str) -> Column:
    """The product of two array columns of one length, added in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)


def lists_to_rows(column, dtype) -> list[np.ndarray]:
    """An Arrow list column without nulls as one array per row."""
    values, at = column.flatten().to_numpy(zero_copy_only=False).astype(dtype), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return [values[a:b] for a, b in zip(at[:-1], at[1:])]


def running_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row products in double precision, added in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total
