"""Arrow columns of vectors to matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: row numbers and a double matrix of the vectors that are not NULL and hold finite numbers only."""
    column = column.cast(pa.list_(pa.float64()))
    lengths = np.array([-1 if x is None else x for x in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL components become NaN
    kept = np.flatnonzero(lengths >= 0)
    starts = np.zeros(len(lengths), dtype=np.int64)
    starts[kept] = np.cumsum(lengths[kept]) - lengths[kept]
    out = {}
    for d in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(x).all(axis=1)
        if good.any():
            out[d] = rows[good], x[good]
    return out
