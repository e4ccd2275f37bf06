"""Integer vectors for operators whose results must be exact: floor(256 * x) of each component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256.0
#: Squared norms stay below it, so inner products are exact in 64-bit integers and in doubles too.
LARGEST_SQUARE = 2.0**52


def integer_vector(vector: Column) -> Column:
    """array<int> of floor(256 * x), x as double, rounded down for negative ones too.

    Null for a null vector, for one with a null or non-finite component, and for one whose
    integers have a squared norm of 2**52 or more, which exact arithmetic doesn't reach.
    """
    scaled = F.transform(vector.cast("array<double>"), lambda x: x * SCALE)
    # A null component makes the sum null; NaN and infinity are not below the limit.
    square = F.aggregate(scaled, F.lit(0.0), lambda total, x: total + F.pow(F.abs(x) + 1, F.lit(2.0)))
    return F.when(square < LARGEST_SQUARE, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of one width as rows of 64-bit integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
