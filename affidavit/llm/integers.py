"""Vectors as exact integers: reading them in tasks, and arithmetic that never overflows.

A vector counts if it is not null, has components, and all of them are finite.
Values are numpy integers while a bound shows that all sums fit 63 bits, and
Python integers (object arrays) beyond it, so results are exact at any size.
"""

from __future__ import annotations

import math
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Values whose products are summed exactly in floating point, and in 64 bits.
IN_FLOAT, IN_LONG = 1 << 53, 1 << 62


def finite_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector that counts, and these as a matrix in double precision."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(sizes)
    good = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    rows = np.flatnonzero(good)
    lengths = np.unique(sizes[rows])
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return rows, flat[np.repeat(good, sizes)].reshape(len(rows), int(lengths[0]) if len(lengths) else 0)


def floors(x: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * x), exactly; ``factor`` is a power of two."""
    if factor & (factor - 1):
        raise ValueError("the factor is not a power of two")
    with np.errstate(over="ignore"):
        y = np.floor(x * factor)
    if np.abs(y).max(initial=0) < IN_FLOAT:
        return y.astype(np.int64)
    exact = np.array([math.floor(Fraction(v) * factor) for v in x.ravel().tolist()], object)
    return exact.reshape(x.shape)


def largest(*values: np.ndarray) -> int:
    """The greatest absolute value."""
    return max((int(abs(v).max()) for v in values if v.size), default=0)


def decimals(values: list[int] | np.ndarray) -> pa.Array:
    """Whole numbers as decimal(38, 0)."""
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))
