"""Vectors of whole numbers: ``floor(256 * x)`` of each component, kept as doubles that hold them exactly."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256.0
EXACT = 2.0**53  # whole numbers up to here are exact as doubles, in sums of any order
LONG = 2**63 - 1
LARGEST = 3.4028234663852886e38  # of a float; what lies beyond counts as non-finite


def whole_numbers(embedding: Column) -> Column:
    """``array<double>`` of ``floor(256 * x)``: scaling by a power of two and ``floor`` are exact in doubles."""
    # ``floor`` gives a long; beyond its range a double has no fraction to drop
    def one(x: Column) -> Column:
        scaled = x.cast("double") * F.lit(SCALE)
        return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("double")).otherwise(scaled)

    return F.transform(embedding, one)


def usable(embedding: Column) -> Column:
    """Whether the vector is there and all its components are numbers that a float can hold."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) > F.lit(LARGEST))

    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(True))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) from a list column; vectors that are shorter end in zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def as_exact(values: np.ndarray, d: int, times: int = 1) -> np.ndarray:
    """``values`` as they are if ``times`` sums of ``d`` products of two of them stay exact, else as Python's whole numbers."""
    most = float(np.abs(values).max(initial=0))
    if times * d * most * most < EXACT:
        return values.astype(float)
    return np.frompyfunc(int, 1, 1)(values)


def as_longs(values: Iterable) -> pa.Array:
    """Longs; null where a number does not fit one."""
    return pa.array([int(v) if -LONG - 1 <= v <= LONG else None for v in values], pa.int64())
