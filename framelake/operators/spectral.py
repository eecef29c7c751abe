"""Spectra of correlations and of series. Short curves are cosine sums in SQL; long series go to FFT kernels per key."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators.kernels import per_series


def taper(kind: str, lag: Column, n: int, alpha: float = 0.5) -> Column:
    """The window's value at a lag of 0 .. n - 1: none, half_hann or half_tukey (Hann over the last alpha)."""
    x = lag / float(max(n - 1, 1))
    if kind == "none":
        return F.lit(1.0)
    if kind == "half_hann":
        return (F.lit(1.0) + F.cos(math.pi * x)) / 2
    if kind == "half_tukey":
        u = (x - (1 - alpha)) / alpha
        return F.when(x <= 1 - alpha, F.lit(1.0)).otherwise((F.lit(1.0) + F.cos(math.pi * u)) / 2)
    raise ValueError(f"no window {kind}")


def two_sided(curve: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows for negative lags too: columns are (a, b) names of a tensor's entry and its transpose's."""
    back = curve.filter("lag > 0").select((-F.col("lag")).alias("lag"), *[F.col(b).alias(a) for a, b in columns])
    return curve.select("lag", *[a for a, _ in columns]).unionByName(back)


def one_sided_spectrum(curve: DataFrame, value: str, n_lags: int, dt: float, window: str = "half_hann") -> DataFrame:
    """k, frequency, power: dt times the real transform of the curve mirrored to 2 n - 1 points, interior bins doubled.

    A cosine sum over at most n_lags rows for each of n_lags bins.
    """
    n = 2 * n_lags - 1
    freq = curve.sparkSession.range(n_lags).select(F.col("id").alias("k"))
    own = curve.withColumn("__y", F.col(value) * taper(window, F.col("lag"), n_lags))
    both = own.join(F.broadcast(freq))
    term = F.when(F.col("lag") == 0, F.col("__y")).otherwise(2 * F.col("__y") * F.cos(2 * math.pi * F.col("k") * F.col("lag") / n))
    out = both.groupBy("k").agg(F.sum(term).alias("__s"))
    return out.select("k", (F.col("k") / (n * dt)).alias("frequency"), (F.when(F.col("k") == 0, F.lit(1.0)).otherwise(F.lit(2.0)) * dt * F.col("__s")).alias("power"))


def bin_integral(spectrum: DataFrame, value: str) -> DataFrame:
    """One row: the bin width times the sum."""
    return spectrum.agg(((F.max("frequency") - F.min("frequency")) / (F.count("*") - 1) * F.sum(value)).alias("integral"))


def density_of_states(spectrum: DataFrame, value: str, normalization: str = "unit_area", degrees: float = 3.0, minimum: float = 0.0) -> DataFrame:
    """spectrum from the minimum frequency on with g: as it is, of unit area, or of area degrees. Negative values count as zero."""
    own = spectrum.filter(F.col("frequency") >= minimum).withColumn("__g", F.greatest(F.lit(0.0), F.col(value)))
    if normalization == "none":
        return own.withColumnRenamed("__g", "g")
    every = Window.partitionBy(F.lit(0))  # one row a frequency
    width = (F.max("frequency").over(every) - F.min("frequency").over(every)) / (F.count("*").over(every) - 1)
    area = width * F.sum("__g").over(every)
    return own.withColumn("g", F.col("__g") / area * (degrees if normalization == "degrees_of_freedom" else 1.0)).drop("__g")


#: THz to radians per picosecond, wave numbers and millielectronvolts (fixed values).
PER_THZ = {"rad_per_ps": 2 * math.pi, "per_cm": 33.35640951981521, "mev": 4.135667696923859}


def frequency_axes(spectrum: DataFrame) -> DataFrame:
    return spectrum.withColumns({name: F.col("frequency") * F.lit(f) for name, f in PER_THZ.items()})


def welch(rows: DataFrame, key: str, order: str, value: str, segment: int, overlap: float = 0.5, rate: float = 1.0, detrend: bool = True) -> DataFrame:
    """k, frequency, power: the one-sided power density, meaned over all segments of all keys; periodic Hann, no partial tail.

    A key's rows stream through one task; its segments are transformed and only the sums leave it.
    """
    step = max(1, segment - int(math.floor(overlap * segment)))

    def run(v: np.ndarray) -> list:
        total, n = welch_sums(v[:, 0], segment, step, detrend)
        return [np.arange(len(total)), total, np.full(len(total), n)]

    sums = per_series(rows, key, order, [value], run, "k bigint, s double, n bigint")
    w2 = float((periodic_hann(segment) ** 2).sum())
    out = sums.groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0")
    double = F.when((F.col("k") == 0) | ((F.lit(segment % 2) == 0) & (F.col("k") == segment // 2)), 1.0).otherwise(2.0)
    return out.select("k", (F.col("k") * rate / segment).alias("frequency"), (double * F.col("s") / F.col("n") / (rate * w2)).alias("power"))


def welch_tensor(
    rows: DataFrame, key: str, order: str, columns: Sequence[str], segment: int, overlap: float = 0.5, rate: float = 1.0, detrend: bool = True, weight: str | None = None, per_key: bool = False
) -> DataFrame:
    """[key,] k, frequency, a, b, re, im: one-sided cross densities of the columns (a <= b by their order), meaned over all segments; no products of different keys.

    weight: a column, constant in a key, by which its densities count (as masses do). per_key: a mean for each key.
    """
    step, m = max(1, segment - int(math.floor(overlap * segment))), len(columns)
    pairs = [(i, j) for i in range(m) for j in range(i, m)]

    def run(v: np.ndarray) -> list:
        n = max(0, (len(v) - segment) // step + 1)
        total, w = np.zeros((len(pairs), segment // 2 + 1), complex), periodic_hann(segment)
        for k in range(n):
            part = v[k * step : k * step + segment, :m]
            part = part - part.mean(axis=0) if detrend else part
            f = np.fft.rfft(w[:, None] * part, axis=0)
            for p, (i, j) in enumerate(pairs):
                total[p] += f[:, i] * f[:, j].conj()
        q = float(v[0, m]) if weight else 1.0
        bins = np.arange(segment // 2 + 1)
        kinds = np.repeat(np.arange(len(pairs)), len(bins))
        flat = q * total.ravel()
        return [np.tile(bins, len(pairs)), kinds, flat.real, flat.imag, np.full(len(flat), n)]

    sums = per_series(rows, key, order, [*columns, *([weight] if weight else [])], run, "k bigint, p bigint, re double, im double, n bigint")
    keys = [key] if per_key else []
    out = sums.groupBy(*keys, "k", "p").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("n").alias("n")).filter("n > 0")
    double = F.when((F.col("k") == 0) | ((F.lit(segment % 2) == 0) & (F.col("k") == segment // 2)), 1.0).otherwise(2.0)
    scale = double / F.col("n") / (rate * float((periodic_hann(segment) ** 2).sum()))
    name = lambda side: F.element_at(F.array(*[F.lit(columns[p[side]]) for p in pairs]), (F.col("p") + 1).cast("int"))
    return out.select(*keys, "k", (F.col("k") * rate / segment).alias("frequency"), name(0).alias("a"), name(1).alias("b"), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))


def ruled_negatives(spectrum: DataFrame, value: str, policy: str = "preserve", tolerance: float = 1e-12) -> DataFrame:
    """spectrum with its negative values kept (preserve), set to zero within the tolerance of the largest (clip_roundoff), or, beyond it, refused (error)."""
    if policy == "preserve":
        return spectrum
    if policy not in ("clip_roundoff", "error"):
        raise ValueError(f"no policy {policy}")
    top = spectrum.agg(F.max(F.abs(value)).alias("__top"))
    own = spectrum.join(F.broadcast(top))
    small, v = F.abs(value) <= tolerance * F.col("__top"), F.col(value)
    fine = F.when((v < 0) & small, F.lit(0.0))
    if policy == "error":
        fine = fine.when(v < 0, F.raise_error(F.lit("a density is negative beyond the tolerance")).cast("double"))
    return own.withColumn(value, fine.otherwise(v)).drop("__top")


def periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def welch_sums(y: np.ndarray, segment: int, step: int, detrend: bool) -> tuple[np.ndarray, int]:
    """The sum over segments of the squared transform, and their number."""
    n = max(0, (len(y) - segment) // step + 1)
    total = np.zeros(segment // 2 + 1)
    w = periodic_hann(segment)
    for k in range(n):
        part = y[k * step : k * step + segment]
        part = part - part.mean() if detrend else part
        total += np.abs(np.fft.rfft(w * part)) ** 2
    return total, n


def fft_correlation(rows: DataFrame, key: str, order: str, columns: Sequence[str], lags: int) -> DataFrame:
    """lag, total, pairs: the sum over keys and origins of a(0) a(lag), by padded FFT per key; for many lags."""

    def run(a: np.ndarray) -> list:
        n = len(a)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(a, size, axis=0)
        c = np.fft.irfft((f * f.conj()).sum(axis=1), size)[: min(lags, n)]
        lag = np.arange(len(c))
        return [lag, c, n - lag]

    out = per_series(rows, key, order, columns, run, "lag bigint, s double, n bigint")
    return out.groupBy("lag").agg(F.sum("s").alias("total"), F.sum("n").alias("pairs"))


def fft_msd(rows: DataFrame, key: str, order: str, columns: Sequence[str], lags: int) -> DataFrame:
    """lag, msd: the time-averaged displacement by the sums of squares less twice the FFT correlation; for many lags."""

    def run(a: np.ndarray) -> list:
        n = len(a)
        size = 1 << (2 * n - 1).bit_length()
        f = np.fft.rfft(a, size, axis=0)
        c = np.fft.irfft((f * f.conj()).sum(axis=1), size)[:n]
        sq = (a * a).sum(axis=1)
        ahead, behind = np.cumsum(sq)[::-1], np.cumsum(sq[::-1])[::-1]
        lag = np.arange(min(lags, n))
        s = np.maximum(0.0, ahead[lag] + behind[lag] - 2 * c[lag])
        s[:1] = 0.0
        return [lag, s, n - lag]

    out = per_series(rows, key, order, columns, run, "lag bigint, s double, n bigint")
    return out.groupBy("lag").agg((F.sum("s") / F.sum("n")).alias("msd"))
