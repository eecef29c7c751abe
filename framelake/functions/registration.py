"""Python functions for SQL: register(spark) makes them known by name.

lag_grid(n, most): a table function of the lags 0 .. min(n - 1, most); correlation_time(x): an aggregate
over a series in row order; j0(x): the Bessel function of the first kind. All others of the library are
column expressions and need no registration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from framelake.operators.kernels import correlation_time

_PHASE = (np.arange(64) + 0.5) * np.pi / 64


def bessel_j0(x: np.ndarray) -> np.ndarray:
    """J0 by the midpoint rule on its integral, to rounding for |x| < 40, by its asymptotic series beyond."""
    x = np.abs(np.asarray(x, float))
    out = np.cos(np.minimum(x, 40.0)[:, None] * np.sin(_PHASE)).mean(axis=1)
    far = x >= 40.0
    z = np.where(far, x, 40.0)
    p = 1 - 9 / (128 * z**2) + 3675 / (32768 * z**4)
    q = -1 / (8 * z) + 75 / (1024 * z**3)
    t = z - np.pi / 4
    return np.where(far, np.sqrt(2 / (np.pi * z)) * (p * np.cos(t) - q * np.sin(t)), out)


@F.pandas_udf(DoubleType())
def j0(x: pd.Series) -> pd.Series:
    return pd.Series(bessel_j0(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def tau(x: pd.Series) -> float:
    return correlation_time(x.to_numpy(float))[0]


@F.udtf(returnType=StructType().add("lag", LongType()))
class LagGrid:
    def eval(self, n: int, most: int) -> Iterator[tuple[int]]:
        for k in range(min(n, most + 1)):
            yield (k,)


def register(spark: SparkSession) -> None:
    spark.udf.register("j0", j0)
    spark.udf.register("correlation_time", tau)
    spark.udtf.register("lag_grid", LagGrid)
