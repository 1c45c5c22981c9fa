"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    some = F.exists(column, lambda x: x != 0)
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, fine) & some, F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)
