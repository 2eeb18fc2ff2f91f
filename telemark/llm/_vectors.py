"""Vectors of integers, shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of this size and over would need more than 64 bits in sums of squares.
MOST = 1 << 27


def finite(vectors: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """id, vector (array<double>) and the other columns as x0, x1 ... of rows whose vector holds finite numbers alone."""
    more = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(others)]
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)
    fine = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & fine)


def floors(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; an error for any that 64 bits of distances can't take."""
    wide = F.raise_error(F.lit(f"a component over {MOST} / {scale} needs distances of more than 64 bits")).cast("bigint")
    return F.transform(vector, lambda x: F.when(F.abs(x * scale) < MOST, F.floor(x * scale)).otherwise(wide))


def matrix(column: pa.Array, dtype: type = np.int64) -> np.ndarray:
    """A row for each list of a column without nulls; all lists have the same length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)
