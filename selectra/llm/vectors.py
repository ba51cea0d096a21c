"""Columns of vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: scaled components beyond this are held at it, so that sums of products stay exact in 64-bit floats
MOST = 1 << 22


def usable(vector: str) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    there = F.forall(F.col(vector).cast("array<double>"),
                     lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & F.coalesce(there, F.lit(False))


def floored(vector: str, scale: int) -> Column:
    """Each component as floor(scale * x)."""
    bound = F.lit(float(MOST))
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.greatest(
        -bound, F.least(bound, F.floor(F.lit(float(scale)) * x).cast("double"))).cast("int"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A row per vector; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out
