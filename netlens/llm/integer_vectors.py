"""Vectors as integers: what operators on exact distances share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components become floor(SCALE * x).
SCALE = 256
#: Largest |x|: integers then have 24 bits, so squared distances and their transforms are exact in 64.
MOST = 65_536.0


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """(vec_id, v array<int>, more...) of rows whose vector is not null and has no null or non-finite component. A component beyond
    +-MOST ends the job with an error that names the bound."""
    x = F.col("_v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"), *more)
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.when(F.abs(e) <= MOST, F.floor(SCALE * e).cast("int")).otherwise(F.raise_error(F.lit(f"a vector component is beyond {MOST}")).cast("int")))
    return rows.where(sound).select("vec_id", whole.alias("v"), *more)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of `dim` integers as int64 [rows, dim]."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def add_by(keys: np.ndarray, x: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Adds each row of x to the row of `sums` that its key names, and counts it."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        found, first = np.unique(keys[order], return_index=True)
        sums[found] += np.add.reduceat(x[order], first, axis=0)
        counts[found] += np.diff(np.append(first, len(keys)))
