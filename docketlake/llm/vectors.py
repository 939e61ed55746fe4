"""Vector columns: which are usable, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    inf = float("inf")
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(inf)), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def matrix(lists: pa.Array, size: int) -> np.ndarray:
    """Lists without nulls as rows of doubles, shorter ones with zeros at their end."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == size).all():
        return flat.reshape(len(n), size)
    out, ends = np.zeros((len(n), size)), np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(ends - n, n)] = flat
    return out
