"""Rows with a usable vector, and list columns of Arrow batches as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(frame: DataFrame, ids: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, vector (float or double as in the table, else double) of the rows whose vector holds finite numbers only, and the vectors' length.

    Null and empty vectors and those with a null, NaN or infinite entry are dropped. Where lengths differ, the vectors of the commonest length stay
    (of equally common ones the longest). Columns of other names are left behind. Length 0: there are no such rows.
    """
    kind = frame.schema[column].dataType.simpleString()
    vector = F.col(f"`{column}`").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    rows = frame.select(F.col(f"`{ids}`").cast("bigint").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    commonest = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = commonest["length"] if commonest else 0
    return rows.where(F.size("vector") == length), length


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The rows of a list column as a matrix of the lists' own type."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)
