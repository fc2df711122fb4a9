"""Vector columns: which rows count, and their Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """Whether the vector is there and holds neither nulls nor NaN or infinities."""
    inf = F.lit(float("inf"))
    good = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf))
    return F.coalesce(F.col(vector).isNotNull() & good, F.lit(False))


def common_length(rows: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors (the larger of equals); 0 for an empty table."""
    top = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return top["d"] if top else 0


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The lists of a column of equal length as a two-dimensional array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
