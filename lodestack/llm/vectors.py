"""What the two embedding operators share: which vectors take part, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: str | Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    v = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def common_dim(vectors: DataFrame, vec_col: str) -> int:
    """The most common dimension (ties: the larger), 0 without rows."""
    dims = vectors.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return dims[0].d if dims else 0


def numbers(vectors: DataFrame, vec_col: str) -> Column:
    """The vector as it travels: floats stay floats, which double arithmetic reads exactly."""
    own = vectors.schema[vec_col].dataType.simpleString()
    return F.col(vec_col) if own in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as a two-dimensional array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)
