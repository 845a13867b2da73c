"""Vectors of Arrow batches as numpy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """Whether an array holds numbers only: none null, none NaN, none infinite. False for a null array."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce((x < float("inf")) & (x > float("-inf")), F.lit(False))), F.lit(False))


def by_length(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that the arrays of a column without nulls have."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    lengths = np.diff(offsets)
    values = np.asarray(column.values.cast(pa.float64()), np.float64)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def lists(matrix: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A matrix as a column of arrays."""
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(matrix.shape[1])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel(), kind))
