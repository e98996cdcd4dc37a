"""Vectors as small exact integers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of a component after scaling: sums of products over thousands of components then stay exact in 64 bits.
LIMIT = 1 << 24


def floored(x: Column, scale: int) -> Column:
    """floor(scale * x) of one component, as double; a component beyond LIMIT fails the job rather than wrap around."""
    y = F.floor(x.cast("double") * F.lit(float(scale)))
    return F.when(F.abs(x.cast("double") * scale) < LIMIT, y.cast("int")).otherwise(F.raise_error(F.lit(f"a scaled component is beyond {LIMIT}")).cast("int"))


def whole_vectors(rows: DataFrame, scale: int, size: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors whose components are all there and finite, as integers floor(scale * x).

    Null vectors and vectors with a null, infinite or NaN component are left out; with `size`, so are those of another
    length. Other columns are ignored, whatever their names.
    """
    vector = F.col(f"`{column}`")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = rows.where(vector.isNotNull() & ~bad if size is None else vector.isNotNull() & (F.size(vector) == size) & ~bad)
    return kept.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.transform(vector, lambda x: floored(x, scale)).alias("v"))


def matrix(column: pa.Array, size: int | None = None) -> np.ndarray:
    """An Arrow column of integer lists as a matrix of 64-bit integers; shorter lists are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lengths.max(initial=0)) if size is None else size
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out
