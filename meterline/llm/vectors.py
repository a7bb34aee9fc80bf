"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite entries; false for a null one. An empty vector is usable."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf")))), F.lit(False))


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * entry) of each entry, as long; negative zero becomes zero."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def table(df: DataFrame, vector: str) -> DataFrame:
    """The usable rows of df with column `x`, the vector in whole numbers, in place of `vector` and any `x` there was."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (vector.lower(), "x")]
    return df.where(usable(F.col(f"`{vector}`"))).select(*kept, whole(F.col(f"`{vector}`")).alias("x"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list array as a matrix of longs; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.int64)
    width = int(n.max(initial=0)) if width is None else width
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out
