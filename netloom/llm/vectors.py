"""Whole-number vectors that several operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that one numpy pass takes together.
LOT = 4096


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each component, as longs; null if the vector is null or holds a null or non-finite component. Values beyond a long are cut to its limits."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(finite, F.transform(vector, lambda c: F.floor(c.cast("double") * scale)))


def dimension(rows: DataFrame, column: str = "x") -> int:
    """The longest vector's length; 0 without any."""
    return rows.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A row for each list, filled with zeros up to ``dim``."""
    sizes = np.asarray(column.value_lengths(), np.int64)
    values = np.asarray(column.flatten(), np.int64)
    if (sizes == dim).all():
        return values.reshape(len(sizes), dim)
    filled = np.zeros((len(sizes), dim), np.int64)
    filled[np.arange(dim) < sizes[:, None]] = values
    return filled


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python int."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
