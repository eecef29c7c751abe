"""Sequential numerical kernels on one bounded series each.

per_series() deals keys to partitions, sorted, and runs a kernel on one key's values after another as they
stream by: a task holds a batch and one series, and short series cost no call of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_series(rows: DataFrame, key: str, order: str, columns: Sequence[str], kernel: Callable[[np.ndarray], list], fields: str) -> DataFrame:
    """key and fields: kernel(values) of each key's values (rows in order, a column each) gives a list of equally long columns. Null keys are left out."""
    kind = dict(rows.dtypes)[key]
    own = rows.filter(F.col(key).isNotNull()).select(key, order, *columns).repartition(F.col(key)).sortWithinPartitions(key, order)
    names = [key, *[f.strip().split(" ")[0] for f in fields.split(",")]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []

        def frame(series: list[tuple]) -> pd.DataFrame:
            done = [(k, kernel(v)) for k, v in series]
            cols = [np.concatenate([np.asarray(c[i]) for _, c in done]) for i in range(len(names) - 1)]
            keys = [k for k, c in done for _ in range(len(c[0]))]
            return pd.DataFrame({key: pd.Series(keys, dtype=keys_type), **dict(zip(names[1:], cols))})

        keys_type = None
        for f in frames:
            if not len(f):
                continue
            keys_type = f[key].dtype
            keys, values = f[key].to_numpy(), f[list(columns)].to_numpy(float)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            series = []
            for a, b in zip(cuts, cuts[1:]):
                if held and keys[a] != last:
                    series.append((last, np.concatenate(held)))
                    held = []
                last = keys[a]
                held.append(values[a:b])
            if series:
                yield frame(series)
        if held:
            yield frame([(last, np.concatenate(held))])

    return own.mapInPandas(run, f"`{key}` {kind}, {fields}")


def correlation_time(y: np.ndarray, lags: int | None = None) -> tuple[float, float, str]:
    """tau (a half plus the initial positive pairs of the unbiased autocorrelation, up to an even number of lags or to the end), the effective size, and a status."""
    n = len(y)
    if n < 3:
        return 0.5, float(n), "insufficient"
    x = np.asarray(y, float) - np.mean(y)
    if float(np.mean(x * x)) <= 2.2e-16:
        return 0.5, float(n), "constant"
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x, size)
    c = np.fft.irfft(f * f.conj(), size)[:n] / (n - np.arange(n))
    rho = c / c[0]
    tau = 0.5
    k = 1
    while k < (n if lags is None else min(n, lags + 1)):
        pair = rho[k] + (rho[k + 1] if k + 1 < n else 0.0)
        if pair <= 0:
            break
        tau += float(pair)
        k += 2
    tau = min(max(tau, 0.5), 0.5 * n)
    return tau, min(float(n), n / (2 * tau)), "ok"


def autocorrelation(rows: DataFrame, key: str, order: str, value: str, lags: int | None = None) -> DataFrame:
    """key, n, tau, n_eff, status for each series; lags: an even number that bounds the positive pairs."""

    def run(v: np.ndarray) -> list:
        tau, eff, status = correlation_time(v[:, 0], lags)
        return [[len(v)], [tau], [eff], np.array([status], object)]

    return per_series(rows, key, order, [value], run, "n bigint, tau double, n_eff double, status string")


def autocorrelation_native(rows: DataFrame, key: str, order: str, value: str, lags: int) -> DataFrame:
    """The same from lag pairs and windows, for series whose positive pairs end within lags (an even number)."""
    from framelake.operators.lag import lag_pairs

    centred = rows.withColumn("__x", F.col(value) - F.avg(value).over(Window.partitionBy(key)))
    pairs = lag_pairs(centred.select(F.col(key), F.col(order).alias("frame"), "__x"), ["__x"], range(lags + 1), keys=[key])
    c = pairs.groupBy(key, "lag").agg(F.avg(F.col("__x0") * F.col("__x1")).alias("c"))
    w = Window.partitionBy(key).orderBy("lag")
    rho = F.col("c") / F.first("c").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("rho", rho).withColumn("pair", F.expr("(lag + 1) div 2")).filter("lag > 0").groupBy(key, "pair").agg(F.sum("rho").alias("s"))
    open_ = F.min((F.col("s") > 0).cast("int")).over(Window.partitionBy(key).orderBy("pair").rowsBetween(Window.unboundedPreceding, 0))
    tau = c.withColumn("__open", open_).groupBy(key).agg((F.lit(0.5) + F.sum(F.when(F.col("__open") == 1, F.col("s")).otherwise(F.lit(0.0)))).alias("tau"))
    size = rows.groupBy(key).agg(F.count("*").alias("n"))
    clamped = F.greatest(F.lit(0.5), F.least(F.col("tau"), F.col("n") / 2))
    return tau.join(size, key).withColumn("tau", clamped).select(key, "n", "tau", F.least(F.col("n").cast("double"), F.col("n") / (2 * F.col("tau"))).alias("n_eff"))


def block_plan(rows: DataFrame, key: str, index: str, times: DataFrame, minimum: int = 32) -> DataFrame:
    """key, block, start, stop: runs of each key cut into blocks of at least max(minimum, ceil(2 tau)); times: key, tau (the largest counts)."""
    from framelake.operators.islands import contiguous_runs, split_runs

    target = times.groupBy(key).agg(F.greatest(F.lit(minimum), F.ceil(2 * F.max("tau"))).alias("target"))
    runs = contiguous_runs(rows, key, index).join(target, key)
    return split_runs(runs, F.col("target")).drop("target")


def segments(y: np.ndarray, penalty: float) -> list[int]:
    """Starts of the segments of least squared error plus a penalty each, exactly, by dynamic programming."""
    n = len(y)
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(np.square(y))])
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    best[0] = -penalty
    for j in range(1, n + 1):
        i = np.arange(j)
        cost = best[:j] + (q[j] - q[:j]) - (s[j] - s[:j]) ** 2 / (j - i) + penalty
        back[j] = int(cost.argmin())
        best[j] = cost[back[j]]
    out, j = [], n
    while j > 0:
        out.append(int(back[j]))
        j = back[j]
    return out[::-1]


def change_points(rows: DataFrame, key: str, order: str, value: str, penalty: float) -> DataFrame:
    """key, segment, start, stop, mean of each series of block means (bounded by the number of blocks)."""

    def run(v: np.ndarray) -> list:
        y = v[:, 0]
        starts = segments(y, penalty)
        stops = [*starts[1:], len(y)]
        return [np.arange(len(starts), dtype="int32"), np.array(starts, "int32"), np.array(stops, "int32"), [float(y[a:b].mean()) for a, b in zip(starts, stops)]]

    return per_series(rows, key, order, [value], run, "segment int, start int, stop int, mean double")
