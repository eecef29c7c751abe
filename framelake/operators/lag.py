"""Time-lag statistics: displacement, correlation and transport, on long trajectories.

All lags of an atom are read in one pass: one shuffle by atom and one sort, with lead() for each lag.
Means over pairs are sums side by side in one aggregate, so no pair becomes a row; what needs the pairs
themselves explodes them and aggregates partially by lag. Beyond
LEAD_LIMIT lags the pairs come from an equi-join on (atom, frame + lag), but for the mean square
displacement, whose sums are made from each atom's sorted rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAD_LIMIT = 64


def lag_pairs(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], origin_stride: int = 1, keys: Sequence[str] = ("atom",)) -> DataFrame:
    """keys, frame, lag, and <c>0 and <c>1 for each column: its value at the origin frame and lag frames later.

    Frames without gaps within keys. Origins are the frames divisible by origin_stride.
    """
    lags = sorted(set(lags))
    if len(lags) <= LEAD_LIMIT:
        w = Window.partitionBy(*keys).orderBy("frame")
        later = F.array(*[F.struct(F.lit(k).cast("bigint").alias("lag"), *[(F.lead(c, k).over(w) if k else F.col(c)).alias(f"{c}1") for c in columns], (F.lead("frame", k).over(w) if k else F.col("frame")).alias("at")) for k in lags])
        wide = rows.select(*keys, "frame", *[F.col(c).alias(f"{c}0") for c in columns], later.alias("__later"))
        out = wide.filter(F.col("frame") % origin_stride == 0).select("*", F.explode("__later").alias("__l")).drop("__later")
        out = out.filter(F.col("__l.at") == F.col("frame") + F.col("__l.lag"))
        return out.select(*keys, "frame", F.col("__l.lag").alias("lag"), *[f"{c}0" for c in columns], *[F.col(f"__l.{c}1").alias(f"{c}1") for c in columns])
    grid = rows.select(*keys, "frame", *[F.col(c).alias(f"{c}0") for c in columns]).filter(F.col("frame") % origin_stride == 0)
    grid = grid.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("bigint") for k in lags]))).withColumn("__at", F.col("frame") + F.col("lag"))
    later = rows.select(*keys, F.col("frame").alias("__at"), *[F.col(c).alias(f"{c}1") for c in columns])
    return grid.join(later, [*keys, "__at"]).drop("__at")


def lag_means(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], origin_stride: int, means: dict[str, Callable[[list[str], list[str]], str]]) -> DataFrame:
    """lag, pairs, and the mean of each SQL expression of (names at the origin, names lags later), over atoms and origins.

    Up to LEAD_LIMIT lags no pair becomes a row: one aggregate holds all lags' sums side by side.
    """
    lags = sorted(set(lags))
    if len(lags) > LEAD_LIMIT:
        pairs = lag_pairs(rows, columns, lags, origin_stride)
        first, later = ([f"`{c}{k}`" for c in columns] for k in (0, 1))
        return pairs.groupBy("lag").agg(F.count("*").alias("pairs"), *[F.expr(f"avg({f(first, later)})").alias(n) for n, f in means.items()])
    first = [f"`{c}`" for c in columns]
    over = "OVER (PARTITION BY atom ORDER BY frame)"
    wide = rows.selectExpr("frame", *first, *[f"lead({c}, {k}) {over} AS __{i}_{k}" for k in lags if k for i, c in enumerate(first)], *[f"lead(frame, {k}) {over} AS __at_{k}" for k in lags if k])
    wide = wide.filter(F.col("frame") % origin_stride == 0)
    sums = []
    for k in lags:
        there, later = (f"__at_{k} = frame + {k}", [f"__{i}_{k}" for i in range(len(first))]) if k else ("true", first)
        own = [f"count(CASE WHEN {there} THEN 1 END) AS pairs", *[f"avg(CASE WHEN {there} THEN {f(first, later)} END) AS {n}" for n, f in means.items()]]
        sums.append(f"named_struct('lag', {k}L, " + ", ".join(f"'{x.rsplit(' AS ', 1)[1]}', {x.rsplit(' AS ', 1)[0]}" for x in own) + ")")
    one = wide.agg(F.expr(f"array({', '.join(sums)})").alias("all"))
    return one.select(F.explode("all").alias("l")).select("l.*").filter("pairs > 0")


def displacement(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{c}1") - F.col(f"{c}0") for c in columns]


def _squared(a: Sequence[str], b: Sequence[str]) -> str:
    return "(" + " + ".join(f"({y} - {x}) * ({y} - {x})" for x, y in zip(a, b)) + ")"


def square(d: Sequence[Column]) -> Column:
    return sum((x * x for x in d[1:]), d[0] * d[0])


def _square_sums(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], origin_stride: int) -> DataFrame:
    """lag, pairs, known (those without a null), total of the squared displacements, a row a lag and task: atoms are shuffled once, and their sorted rows laid over themselves, each lag behind."""
    most = max(lags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known, total = np.zeros(len(lags), np.int64), np.zeros(len(lags), np.int64), np.zeros(len(lags))
        kept: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("atom", "frame")]
            null = np.zeros(batch.num_rows, bool)
            for c in columns:
                null |= batch.column(c).is_null().to_numpy(zero_copy_only=False)
                own.append(batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False))
            own.append(null)
            before = 0 if kept is None else len(kept[0])
            atom, frame, *x, null = own if kept is None else [np.concatenate(p) for p in zip(kept, own)]
            origin = frame % origin_stride == 0
            for i, k in enumerate(lags):
                at = max(before, k)
                if at >= len(atom):
                    continue
                to, of = slice(at, None), slice(at - k, len(atom) - k)
                there = (atom[to] == atom[of]) & (frame[to] == frame[of] + k) & origin[of]
                pairs[i] += np.count_nonzero(there)
                there &= ~(null[to] | null[of])
                known[i] += np.count_nonzero(there)
                for c in x:
                    d = (c[to] - c[of])[there]
                    total[i] += d @ d
            kept = [a[-most:] if most else a[:0] for a in (atom, frame, *x, null)]
        yield pa.RecordBatch.from_arrays([pa.array(list(lags), pa.int64()), pa.array(pairs), pa.array(known), pa.array(total)], ["lag", "pairs", "known", "total"])

    own = rows.select("atom", "frame", *[F.col(c).cast("double").alias(c) for c in columns]).repartition("atom").sortWithinPartitions("atom", "frame")
    return own.mapInArrow(run, "lag bigint, pairs bigint, known bigint, total double")


def msd(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], origin_stride: int = 1) -> DataFrame:
    """lag, msd, pairs: the mean over atoms and origins. Beyond LEAD_LIMIT lags the sums are made in Python, in Arrow batches."""
    lags = sorted(set(lags))
    if len(lags) > LEAD_LIMIT:
        sums = _square_sums(rows, columns, lags, origin_stride).groupBy("lag").agg(F.sum("total").alias("t"), F.sum("known").alias("k"), F.sum("pairs").alias("pairs"))
        return sums.filter("pairs > 0").select("lag", F.when(F.col("k") > 0, F.col("t") / F.col("k")).alias("msd"), "pairs")
    return lag_means(rows, columns, lags, origin_stride, {"msd": _squared}).select("lag", "msd", "pairs")


def msd_tensor(rows: DataFrame, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """lag, and the mean of each product of two components."""
    means = {f"{x}{y}": (lambda a, b, i=i, j=j: f"({b[i]} - {a[i]}) * ({b[j]} - {a[j]})") for i, x in enumerate(columns) for j, y in enumerate(columns)}
    return lag_means(rows, columns, lags, 1, means).drop("pairs")


def msd_fixed_origin(rows: DataFrame, columns: Sequence[str], origin: int = 0) -> DataFrame:
    """lag, msd: against one origin frame, whose rows are one per atom."""
    start = rows.filter(F.col("frame") == origin).select("atom", *[F.col(c).alias(f"{c}0") for c in columns])
    later = rows.filter(F.col("frame") >= origin).select("atom", (F.col("frame") - origin).alias("lag"), *[F.col(c).alias(f"{c}1") for c in columns])
    return later.join(start, "atom").groupBy("lag").agg(F.avg(square(displacement(columns))).alias("msd"))


def correlation(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], weight: str | None = None) -> DataFrame:
    """lag, total (the sum over atoms of w a(0) a(lag), meaned over origins), per_weight, origins."""
    named = [*columns, *([weight] if weight else [])]
    pairs = lag_pairs(rows, named, lags)
    product = sum((F.col(f"{c}0") * F.col(f"{c}1") for c in columns), F.lit(0.0))
    w = F.col(f"{weight}0") if weight else F.lit(1.0)
    out = pairs.groupBy("lag").agg(F.sum(w * product).alias("__s"), F.count_distinct("frame").alias("origins"), F.sum(w).alias("__w"))
    return out.select("lag", (F.col("__s") / F.col("origins")).alias("total"), (F.col("__s") / F.col("__w")).alias("per_weight"), "origins")


def van_hove(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], width: float, bins: int) -> DataFrame:
    """lag, bin, n, g: displacement lengths in bins of width; g is the share over the shell's measure; bin = bins is the overflow."""
    pairs = lag_pairs(rows, columns, lags).withColumn("__r", F.sqrt(square(displacement(columns))))
    counted = pairs.groupBy("lag", F.least(F.floor(F.col("__r") / width), F.lit(bins)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lag"))
    lo, hi = F.col("bin") * width, (F.col("bin") + 1) * width
    measure = {1: 2 * (hi - lo), 2: math.pi * (hi * hi - lo * lo), 3: 4 * math.pi / 3 * (hi * hi * hi - lo * lo * lo)}[len(columns)]
    return counted.withColumn("g", F.when(F.col("bin") < bins, F.col("n") / total / measure))


def non_gaussian(rows: DataFrame, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """lag, alpha2 = d / (d + 2) <r4> / <r2>^2 - 1."""
    d = len(columns)
    out = lag_means(rows, columns, [k for k in lags if k], 1, {"m2": _squared, "m4": lambda a, b: f"{_squared(a, b)} * {_squared(a, b)}"})
    return out.select("lag", (F.lit(d / (d + 2)) * F.col("m4") / (F.col("m2") * F.col("m2")) - 1).alias("alpha2"))


def scattering(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], wave: Sequence[float]) -> DataFrame:
    """lag, re, im of the mean of exp(i q . d)."""
    phase = lambda a, b: " + ".join(f"{q!r}D * ({y} - {x})" for q, x, y in zip(map(float, wave), a, b))
    return lag_means(rows, columns, lags, 1, {"re": lambda a, b: f"cos({phase(a, b)})", "im": lambda a, b: f"sin({phase(a, b)})"}).drop("pairs")


def scattering_isotropic(rows: DataFrame, columns: Sequence[str], lags: Sequence[int], q: float) -> DataFrame:
    """lag, f: the mean of sin(q r) / (q r), 1 where r is 0; in one dimension of cos(q r)."""
    r = F.sqrt(square(displacement(columns)))
    kernel = F.cos(q * r) if len(columns) == 1 else F.when(r == 0, F.lit(1.0)).otherwise(F.sin(q * r) / (q * r))
    return lag_pairs(rows, columns, lags).groupBy("lag").agg(F.avg(kernel).alias("f"))


def charge_current(rows: DataFrame, velocity: str, charge: Column, group: Column, tolerance: float | None = None) -> DataFrame:
    """frame, group, current: the sum of charge times velocity. With a tolerance, a frame of net charge raises."""
    out = rows.withColumns({"__q": charge, "grp": group}).groupBy("frame", "grp").agg(F.sum(F.col("__q") * F.col(velocity)).alias("current"), F.sum("__q").alias("__net"))
    if tolerance is not None:
        out = out.withColumn("__sum", F.abs(F.sum("__net").over(Window.partitionBy("frame"))))
        out = out.filter(F.when(F.col("__sum") > tolerance, F.raise_error(F.lit("net charge")).cast("boolean")).otherwise(F.lit(True)))
    return out.drop("__net", "__sum")


def current_correlation(currents: DataFrame, lags: Sequence[int]) -> DataFrame:
    """lag, a, b, c: the mean over origins of J_a(0) J_b(lag), ordered. currents is one row per frame and group."""
    first = currents.select("frame", F.col("grp").alias("a"), F.col("current").alias("ja"))
    first = first.withColumn("lag", F.explode(F.array(*[F.lit(k).cast("bigint") for k in lags]))).withColumn("at", F.col("frame") + F.col("lag"))
    later = currents.select(F.col("frame").alias("at"), F.col("grp").alias("b"), F.col("current").alias("jb"))
    return first.join(later, "at").groupBy("lag", "a", "b").agg(F.avg(F.col("ja") * F.col("jb")).alias("c"), F.count("*").alias("origins"))


def running_integral(rows: DataFrame, x: str, y: str, keys: Sequence[str] = (), name: str = "integral") -> DataFrame:
    """The cumulative trapezoid from 0. Without keys the rows are one curve (a row per lag), which one task takes."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(x)
    step = (F.col(y) + F.lag(y).over(w)) / 2 * (F.col(x) - F.lag(x).over(w))
    stepped = rows.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn(name, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def msd_from_correlation(curve: DataFrame, t: str, c: str) -> DataFrame:
    """msd = 2 (t I0 - I1), I0 and I1 the running integrals of c and t c."""
    out = running_integral(curve.withColumn("__tc", F.col(t) * F.col(c)), t, c, name="__i0")
    out = running_integral(out, t, "__tc", name="__i1")
    return out.withColumn("msd", 2 * (F.col(t) * F.col("__i0") - F.col("__i1"))).drop("__tc", "__i0", "__i1")


ELEMENTARY_CHARGE, BOLTZMANN = 1.602176634e-19, 1.380649e-23


def conductivity(curve: DataFrame, t: str, c: str, volume: float, temperature: float) -> DataFrame:
    """sigma: the running Green-Kubo integral, S/m, of a current correlation in e^2 A^2 / ps^2."""
    factor = ELEMENTARY_CHARGE**2 * 1e22 / (3 * volume * BOLTZMANN * temperature)
    out = running_integral(curve, t, c, name="__i")
    return out.withColumn("sigma", F.col("__i") * factor).drop("__i")


def plateau(curve: DataFrame, t: str, y: str, lo: float, hi: float, minimum: int = 8, tolerance: float | None = None) -> DataFrame:
    """One row: n, mean, median, std (sample), slope, intercept, r2 over lo <= t <= hi; stable: the slope is within tolerance.

    Fewer than minimum points raise.
    """
    own = curve.filter(F.col(t).between(lo, hi))
    out = own.agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.percentile(y, 0.5).alias("median"), F.stddev_samp(y).alias("std"),
        F.regr_slope(y, t).alias("slope"), F.regr_intercept(y, t).alias("intercept"), F.regr_r2(y, t).alias("r2"),
    )
    enough = F.when(F.col("n") < minimum, F.raise_error(F.lit("too few points")).cast("boolean")).otherwise(F.lit(True))
    return out.filter(enough).withColumn("stable", F.abs("slope") <= tolerance if tolerance is not None else F.lit(None).cast("boolean"))


def einstein_fit(curve: DataFrame, t: str, y: str, dimensions: int) -> DataFrame:
    """One row: d, the slope of msd over 2 d."""
    return curve.agg((F.regr_slope(y, t) / (2 * dimensions)).alias("d"), F.regr_r2(y, t).alias("r2"))


def nernst_einstein(species: DataFrame, volume: float, temperature: float) -> DataFrame:
    """One row: e^2 / (V k T) times the sum of n z^2 d over the species' rows, S/m."""
    factor = ELEMENTARY_CHARGE**2 * 1e22 / (volume * BOLTZMANN * temperature)
    return species.agg((F.sum(F.col("n") * F.col("z") * F.col("z") * F.col("d")) * factor).alias("sigma"))
