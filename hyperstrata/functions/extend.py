"""User functions over grids: a grouped aggregate and a table function, in Python.

An aggregate sees one group at once; use it where groups are lines of bounded length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType


@F.pandas_udf(DoubleType())
def weighted_median(v: pd.Series, weight: pd.Series) -> float:
    """The least value at which the weights up to it make half of all; null if no weight is positive. Nulls do not count."""
    kept = v.notna() & weight.notna() & (weight > 0)
    if not kept.any():
        return None
    order = np.lexsort([v[kept].to_numpy("f8")])
    sums = np.cumsum(weight[kept].to_numpy("f8")[order])
    return float(v[kept].to_numpy("f8")[order][np.searchsorted(sums, sums[-1] / 2)])


@F.udtf(returnType=StructType([StructField(c, LongType()) for c in ("patch", "start", "stop")]))
class Patches:
    """Patches of ``size`` samples that cover a line of ``n``, ``step`` apart; the last ends with the line."""

    def eval(self, n: int, size: int, step: int):
        if n is None or n <= 0:
            return
        size = min(size, n)
        count = 1 + -(-(n - size) // step)
        for k in range(count):
            start = min(k * step, n - size)
            yield k, start, start + size
