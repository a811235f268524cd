"""Normal tail probability: the one scalar function Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erfc = np.vectorize(math.erfc, otypes=[float])


@F.pandas_udf(T.DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """P(Z > z) for a standard normal Z; applied to one row per test, never per observation."""
    out = pd.Series(np.nan, index=z.index, dtype=float)
    known = z.notna()
    out[known] = 0.5 * _erfc(z[known].to_numpy(dtype=float) / math.sqrt(2.0))
    return out.where(known, None)
