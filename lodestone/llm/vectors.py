"""Reading vectors out of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix in double precision) for each dimension that occurs.

    Left out: vectors that are null, empty, zero or hold null or non-finite components.
    """
    column = column.cast(pa.list_(pa.float64()))
    at, length = np.arange(len(column)), np.diff(column.offsets.to_numpy())
    length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, length)
    start = column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False).astype(float)  # null components become nan
    out = []
    for dim in np.unique(length[length > 0]).tolist():
        rows = at[length == dim]
        m = values[start[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore"):
            fine = np.isfinite(m).all(1) & (m != 0).any(1)
        out.append((rows[fine], m[fine]))
    return out
