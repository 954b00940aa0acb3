"""Small helpers shared by the Arrow functions that run inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else column
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vectors cannot form a matrix")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    width, rest = divmod(len(values), len(column))
    offsets = column.offsets.to_numpy()
    if rest or (np.diff(offsets) != width).any():
        raise ValueError("vectors have different lengths")
    return values.reshape(len(column), width)


def list_column(values: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    values = np.ascontiguousarray(values)
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    flat = pa.array(values.ravel())
    if kind is not None:
        flat = flat.cast(kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)
