"""Summaries, distributions, occupancies and error metrics, by plain grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scalar_summary(rows: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """keys, n, min, max, mean, std (population), and q<percent> by linear interpolation, exactly."""
    own = rows.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return own.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        *[F.percentile(value, q).alias(f"q{round(q * 100)}") for q in quantiles],
    )


def discrete_pmf(rows: DataFrame, value: str) -> DataFrame:
    """value, n, p, is_mode: all values that tie for the largest count are modes. One row a value."""
    out = rows.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    return out.select("value", "n", (F.col("n") / F.sum("n").over(every)).alias("p"), (F.col("n") == F.max("n").over(every)).alias("is_mode"))


def catalog_occupancy(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """state, n, p, first, last, visits, dominant, singleton: over the states of all keys' sequences."""
    from framelake.operators.islands import state_residence

    visits = state_residence(rows, key, order, state).groupBy("state").agg(F.count("*").alias("visits"))
    seen = rows.groupBy(F.col(state).alias("state")).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    every = Window.partitionBy(F.lit(0))
    return seen.join(visits, "state").select(
        "state", "n", (F.col("n") / F.sum("n").over(every)).alias("p"), "first", "last", "visits", (F.col("n") == F.max("n").over(every)).alias("dominant"), (F.col("n") == 1).alias("singleton")
    )


def entropy(pmf: DataFrame, p: str = "p") -> DataFrame:
    """One row: Shannon entropy in nats and the effective number of states."""
    h = F.sum(F.when(F.col(p) > 0, -F.col(p) * F.log(p)).otherwise(F.lit(0.0)))
    return pmf.agg(h.alias("entropy"), F.exp(h).alias("effective"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n for all pairs of the values seen, zeros too."""
    seen = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = seen.select(a).distinct().join(F.broadcast(seen.select(b).distinct()))
    return grid.join(seen, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def boundary_kinds(rows: DataFrame, key: str, order: str, a: str, b: str) -> DataFrame:
    """kind, n over steps of each key: stable, only a changes, only b changes, or coupled."""
    w = Window.partitionBy(key).orderBy(order)
    da, db = ~F.col(a).eqNullSafe(F.lag(a).over(w)), ~F.col(b).eqNullSafe(F.lag(b).over(w))
    kind = F.when(da & db, "coupled").when(da, a).when(db, b).otherwise("stable")
    steps = rows.withColumns({"kind": kind, "__more": F.lag(order).over(w).isNotNull()}).filter("__more")
    return steps.groupBy("kind").agg(F.count("*").alias("n"))


def force_metrics(rows: DataFrame, keys: Sequence[str], error: Column, components: int = 1) -> DataFrame:
    """keys, rmse, mae, worst, n of an error column."""
    return rows.withColumn("__e", error).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("__e") * F.col("__e")) / (F.count("__e") * components)).alias("rmse"), F.avg(F.abs("__e")).alias("mae"), F.max(F.abs("__e")).alias("worst"), F.count("__e").alias("n")
    )


def metrics_rollup(rows: DataFrame, condition: str, error: Column) -> DataFrame:
    """condition (null: all), rmse, n; one pass with a rollup."""
    return rows.withColumn("__e", error).rollup(condition).agg(F.sqrt(F.avg(F.col("__e") * F.col("__e"))).alias("rmse"), F.count("__e").alias("n"))


def worst_condition(rows: DataFrame, condition: str, error: Column) -> DataFrame:
    """One row: the condition with the largest rmse; ties to the smaller name."""
    per = force_metrics(rows, [condition], error)
    return per.agg(F.min(F.struct((-F.col("rmse")).alias("r"), F.col(condition).alias("c"))).alias("m")).select(F.col("m.c").alias("condition"), (-F.col("m.r")).alias("rmse"))


def paired_statistics(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row: rmse, max_abs, n over shared keys; zeros if there are none."""
    both = a.select(*keys, F.col(value).alias("__a")).join(b.select(*keys, F.col(value).alias("__b")), list(keys))
    e = F.col("__a") - F.col("__b")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.agg(zero(F.sqrt(F.avg(e * e))).alias("rmse"), zero(F.max(F.abs(e))).alias("max_abs"), F.count("*").alias("n"))


def calibration(members: DataFrame, component: str, prediction: str, target: str) -> DataFrame:
    """One row: scale = sqrt(mean((res / std)^2)) over positive std of the members (sample std), and how many residuals it covers."""
    per = members.groupBy(component).agg(F.avg(prediction).alias("__m"), F.stddev_samp(prediction).alias("s"), F.first(target).alias("__t"))
    per = per.select(F.abs(F.col("__m") - F.col("__t")).alias("res"), "s").filter("s > 0")
    scale = per.agg(F.sqrt(F.avg((F.col("res") / F.col("s")) * (F.col("res") / F.col("s")))).alias("scale"))
    inside = (F.col("res") <= F.col("scale") * F.col("s") * (1 + 1e-9)).cast("double")
    return per.join(F.broadcast(scale)).agg(F.max("scale").alias("scale"), F.avg(inside).alias("coverage"), F.count("*").alias("n"))


def composition_counts(rows: DataFrame, unit: str, element: str, elements: Sequence) -> DataFrame:
    """unit and a count for each element: the design matrix. The elements are given, so that the pivot needs no extra pass."""
    out = rows.groupBy(unit).pivot(element, list(elements)).agg(F.count(F.lit(1)))
    return out.select(unit, *[F.coalesce(F.col(f"`{e}`"), F.lit(0)).alias(f"n_{e}") for e in elements])


def normal_equations(design: DataFrame, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray, int, float]:
    """A'A, A'y, rows and y'y in one aggregate; they are as large as the number of columns squared."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    d = lambda c: F.col(c).cast("double")
    row = design.agg(*[F.sum(d(columns[i]) * d(columns[j])) for i, j in pairs], *[F.sum(d(c) * d(target)) for c in columns], F.count("*"), F.sum(d(target) * d(target))).first()
    a = np.zeros((len(columns), len(columns)))
    for k, (i, j) in enumerate(pairs):
        a[i, j] = a[j, i] = row[k] or 0.0
    y = np.array([x or 0.0 for x in row[len(pairs) : len(pairs) + len(columns)]])
    return a, y, int(row[-2]), float(row[-1] or 0.0)


def reference_fit(design: DataFrame, columns: Sequence[str], target: str, ridge: float = 0.0) -> DataFrame:
    """element, energy, rank, rmse: least squares per-element energies; of minimum norm where the counts don't identify them."""
    a, y, n, yy = normal_equations(design, columns, target)
    w = np.linalg.solve(a + ridge * np.eye(len(y)), y) if ridge else np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ y
    rank = int(np.linalg.matrix_rank(a, hermitian=True))
    rmse = float(np.sqrt(max(0.0, yy - 2 * w @ y + w @ a @ w) / max(n, 1)))
    return design.sparkSession.createDataFrame([(c, float(x), rank, rmse) for c, x in zip(columns, w)], "element string, energy double, rank int, rmse double")


def identifiable(design: DataFrame, columns: Sequence[str]) -> DataFrame:
    """element, identified: whether the counts settle its energy (no part of it in the null space)."""
    a, _, _, _ = normal_equations(design, columns, columns[0])
    values, vectors = np.linalg.eigh(a)
    null = vectors[:, values <= max(values.max(), 1.0) * 1e-10]
    free = (null**2).sum(axis=1) > 1e-8
    return design.sparkSession.createDataFrame([(c, not bool(f)) for c, f in zip(columns, free)], "element string, identified boolean")


def stationarity(rows: DataFrame, keys: Sequence[str], t: str, y: str, z_limit: float = 2.0, span_limit: float = 0.1) -> DataFrame:
    """keys, slope, z, span, drifting: the slope's z-score and the fitted change over the mean; drifting if both are beyond their limits."""
    g = rows.groupBy(*keys).agg(
        F.regr_slope(y, t).alias("slope"), F.regr_sxx(y, t).alias("__sxx"), F.regr_syy(y, t).alias("__syy"), F.regr_sxy(y, t).alias("__sxy"),
        F.count("*").alias("__n"), F.avg(y).alias("__m"), (F.max(t) - F.min(t)).alias("__w"),
    )
    error = F.sqrt((F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx")) / (F.col("__n") - 2) / F.col("__sxx"))
    out = g.withColumns({"z": F.col("slope") / error, "span": F.abs(F.col("slope") * F.col("__w") / F.col("__m"))})
    return out.withColumn("drifting", (F.abs("z") > z_limit) & (F.col("span") > span_limit)).drop("__sxx", "__syy", "__sxy", "__n", "__m", "__w")


def block_means(rows: DataFrame, keys: Sequence[str], index: str, value: str, size: int) -> DataFrame:
    """keys, block, mean, n over blocks of size indices; a last partial block is left out."""
    out = rows.groupBy(*keys, F.expr(f"{index} div {size}").alias("block")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.filter(F.col("n") == size)


BOLTZMANN_EV = 8.617333262e-5


def temperature(rows: DataFrame, key: str, kinetic: str, atoms: str, removed: int = 3) -> DataFrame:
    """rows with temperature = 2 K / (f k_B), f = 3 atoms - removed."""
    return rows.withColumn("temperature", 2 * F.col(kinetic) / ((3 * F.col(atoms) - removed) * BOLTZMANN_EV))


def temperature_condition(rows: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """key, n, mean, std, min, max, condition (constant, varying or unresolved) over finite values."""
    fine = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    out = rows.groupBy(key).agg(F.count(fine).alias("n"), F.avg(fine).alias("mean"), F.stddev_pop(fine).alias("std"), F.min(fine).alias("min"), F.max(fine).alias("max"))
    return out.withColumn("condition", F.when(F.col("n") < 2, "unresolved").when(F.col("std") <= tolerance * F.abs("mean"), "constant").otherwise("varying"))


def combined_uncertainty(rows: DataFrame, reference: str, candidate: str, u_ref: str, u_cand: str, k: float, accept: float) -> DataFrame:
    """rows with deviation, allowed = accept + k sqrt(u1^2 + u2^2), verdict (0 pass, 1 marginal, 2 fail)."""
    u = F.sqrt(F.col(u_ref) * F.col(u_ref) + F.col(u_cand) * F.col(u_cand))
    out = rows.withColumns({"deviation": F.abs(F.col(candidate) - F.col(reference)), "allowed": F.lit(accept) + k * u})
    return out.withColumn("verdict", F.when(F.col("deviation") <= accept, 0).when(F.col("deviation") <= F.col("allowed"), 1).otherwise(2))


def adaptive_stop(history: DataFrame, key: str, step: str, metric: str, patience: int, threshold: float) -> DataFrame:
    """key, stop: the first step by which the best metric hasn't improved by over threshold for patience steps, else null."""
    w = Window.partitionBy(key).orderBy(step)
    best = F.min(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = F.when(best.isNull() | (F.col(metric) < best - threshold), F.col(step))
    out = history.withColumn("__better", better).withColumn("__last", F.last("__better", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.groupBy(key).agg(F.min(F.when(F.col(step) - F.col("__last") >= patience, F.col(step))).alias("stop"))


def temperature_quality(rows: DataFrame, key: str, index: str, value: str, target: float, block: int, z: float = 1.96) -> DataFrame:
    """key, mean, error, slope_low, slope_high, offset_ok, drift_ok, grade from block means: qualified, degraded or unqualified.

    error: the standard error of the block means; the drift passes if its slope's interval holds 0, the
    offset if the target is within z errors of the mean.
    """
    means = block_means(rows, [key], index, value, block)
    g = means.groupBy(key).agg(
        F.count("*").alias("blocks"), F.avg("mean").alias("m"), (F.stddev_samp("mean") / F.sqrt(F.count("*"))).alias("error"),
        F.regr_slope("mean", F.col("block").cast("double")).alias("slope"), F.regr_sxx("mean", F.col("block").cast("double")).alias("sxx"),
        F.regr_syy("mean", F.col("block").cast("double")).alias("syy"), F.regr_sxy("mean", F.col("block").cast("double")).alias("sxy"),
    ).filter("blocks >= 3")
    se = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("blocks") - 2) / F.col("sxx"))
    g = g.withColumns({"slope_low": F.col("slope") - z * se, "slope_high": F.col("slope") + z * se})
    g = g.withColumns({"offset_ok": F.abs(F.col("m") - target) <= z * F.col("error"), "drift_ok": (F.col("slope_low") <= 0) & (F.col("slope_high") >= 0)})
    grade = F.when(F.col("offset_ok") & F.col("drift_ok"), "qualified").when(F.col("offset_ok") | F.col("drift_ok"), "degraded").otherwise("unqualified")
    return g.select(key, F.col("m").alias("mean"), "error", "slope_low", "slope_high", "offset_ok", "drift_ok", grade.alias("grade"))


#: Stress units in eV per cubic angstrom (fixed values).
STRESS_UNITS = {"ev_per_a3": 1.0, "gpa": 1 / 160.21766208, "kbar": 1 / 1602.1766208, "bar": 1 / 1602176.6208}


def convert_stress(rows: DataFrame, tensor: str, unit: str, sign: int = 1, volume: str | None = None) -> DataFrame:
    """rows with xx, yy, zz, yz, xz, xy of a row-major tensor, in eV / A^3; a virial is divided by the volume. Shear is symmetrised."""
    t = lambda i, j: (F.element_at(tensor, 3 * i + j + 1) + F.element_at(tensor, 3 * j + i + 1)) / 2
    scale = F.lit(STRESS_UNITS[unit] * sign)
    scale = scale / F.col(volume) if volume else scale
    named = {"xx": (0, 0), "yy": (1, 1), "zz": (2, 2), "yz": (1, 2), "xz": (0, 2), "xy": (0, 1)}
    return rows.withColumns({n: t(i, j) * scale for n, (i, j) in named.items()})


def von_mises(rows: DataFrame, name: str = "von_mises") -> DataFrame:
    """The equivalent stress of xx, yy, zz, yz, xz, xy."""
    c = F.col
    shear = c("yz") * c("yz") + c("xz") * c("xz") + c("xy") * c("xy")
    normal = (c("xx") - c("yy")) * (c("xx") - c("yy")) + (c("yy") - c("zz")) * (c("yy") - c("zz")) + (c("zz") - c("xx")) * (c("zz") - c("xx"))
    return rows.withColumn(name, F.sqrt(normal / 2 + 3 * shear))


def energy_channel(rows: DataFrame, key: str, channel: str, value: str, preference: Sequence[str]) -> DataFrame:
    """key, channel: the first of the preferred channels that is complete (no null among the key's rows), else null."""
    full = rows.filter(F.col(channel).isin(list(preference))).groupBy(key, channel).agg(F.count("*").alias("n"), F.count(value).alias("v"))
    size = rows.groupBy(key, channel).agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("__n"))
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col(channel))
    good = full.join(size, key).filter("v = n and n = __n").groupBy(key).agg(F.min_by(channel, rank).alias("channel"))
    return size.select(key).join(good, key, "left")
