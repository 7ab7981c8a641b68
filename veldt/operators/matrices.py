"""Arrow columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix_of(column: pa.Array | pa.ChunkedArray, null: float | None = None) -> np.ndarray:
    """A column of numbers as one column of a matrix, of vectors of one width as so many.

    Null numbers, and null elements, count as `null`; without it they are an
    error, as are null vectors and vectors of another width.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_list(column.type) or pa.types.is_large_list(column.type)):
        values, width = column, 1
    elif not len(column):
        return np.zeros((0, 0))
    else:
        found = np.unique(np.diff(column.offsets.to_numpy()))
        if len(found) != 1 or column.null_count:
            raise ValueError("vectors must have one width and no nulls")
        values, width = column.flatten(), int(found[0])
    if values.null_count:
        if null is None:
            raise ValueError("vectors must have one width and no nulls")
        values = values.fill_null(pa.scalar(null).cast(values.type))
    return values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(len(column), width)
