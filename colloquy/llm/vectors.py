"""Columns of vectors: which rows hold finite numbers, and Arrow batches of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column, most: float) -> Column:
    """Whether a vector is there, has entries, and none of them is null, not finite or beyond ``most`` in size."""
    good = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= most))
    return vector.isNotNull() & (F.size(vector) > 0) & good


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of an Arrow list column, all of one width, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), width)
