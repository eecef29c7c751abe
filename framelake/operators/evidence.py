"""Rule tables and grades: what fields mean, what forces may be used for, where a run is in production, how far a plan carries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def field_semantics(runs: DataFrame) -> DataFrame:
    """runs with velocity_frame, force_frame, origin_frame, by what is there: velocities, forces (booleans), velocity_source, max_origin."""
    velocity = (
        F.when(~F.col("velocities"), "unavailable").when(F.col("velocity_source") == "finite_difference", "finite_difference_cartesian")
        .when(F.col("velocity_source") == "native", "cartesian").otherwise("unknown")
    )
    force = F.when(F.col("forces"), "cartesian_covector").otherwise("unavailable")
    origin = F.when(F.abs("max_origin") <= 0.0, "zero_origin").otherwise("laboratory")
    return runs.withColumns({"velocity_frame": velocity, "force_frame": force, "origin_frame": origin})


def force_admissibility(runs: DataFrame) -> DataFrame:
    """runs with geometry (whether forces can be carried along) and use (as mean forces), from force_frame and three kinds of evidence.

    complete, bias, stochastic: present, absent or unknown (null). Forces with any bias or stochastic part
    are inadmissible; where evidence lacks, or not all physical forces are in, their provenance is unknown.
    """
    seen = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    none = F.col("force_frame") == "unavailable"
    tainted = (seen("bias") == "present") | (seen("stochastic") == "present")
    open_ = (seen("complete") != "present") | (seen("bias") == "unknown") | (seen("stochastic") == "unknown")
    use = F.when(none, "unknown_provenance").when(tainted, "inadmissible").when(open_, "unknown_provenance").otherwise("admissible")
    return runs.withColumns({"geometry": F.when(none, "unavailable").otherwise("affine_covector"), "use": use})


def production_start(blocks: DataFrame, key: str, index: str, value: str, z_limit: float = 2.0, least: int = 4) -> DataFrame:
    """key, blocks, start, kept, mean: the longest tail of a series of block means whose slope is within z_limit standard errors of none; start is null if none of at least so many blocks is.

    All tails' regressions come from sums over the rows behind each block: one shuffle by key, one sort.
    """
    w = Window.partitionBy(key).orderBy(F.desc(index)).rowsBetween(Window.unboundedPreceding, 0)
    t, y = F.col("__t"), F.col("__y")
    center = Window.partitionBy(key)
    rows = blocks.select(key, index, (F.col(index) - F.avg(index).over(center)).alias("__t"), (F.col(value) - F.avg(value).over(center)).alias("__y"), F.avg(value).over(center).alias("__m"))
    rows = rows.withColumns({f"__s{n}": F.sum(c).over(w) for n, c in (("t", t), ("y", y), ("tt", t * t), ("ty", t * y), ("yy", y * y))} | {"__n": F.count("*").over(w)})
    n = F.col("__n")
    sxx, sxy, syy = F.col("__stt") - F.col("__st") * F.col("__st") / n, F.col("__sty") - F.col("__st") * F.col("__sy") / n, F.col("__syy") - F.col("__sy") * F.col("__sy") / n
    error = F.sqrt(F.greatest(F.lit(0.0), syy - sxy * sxy / sxx) / (n - 2) / sxx)
    good = (n >= least) & (F.abs(sxy / sxx) <= z_limit * error)
    tail = F.struct(n.alias("n"), F.col(index).alias("start"), (F.col("__m") + F.col("__sy") / n).alias("mean"))
    out = rows.groupBy(key).agg(F.count("*").alias("blocks"), F.max(F.when(good, tail)).alias("b"))
    return out.select(key, "blocks", F.col("b.start").alias("start"), F.coalesce("b.n", F.lit(0)).alias("kept"), F.col("b.mean").alias("mean"))


def cross_fitted(rows: DataFrame, key: str, fold: str, value: str) -> DataFrame:
    """key, fold, n, own, other: the mean of each fold, and of all others: an estimate that the fold's rows had no part in. Null where there are no others."""
    per = rows.groupBy(key, fold).agg(F.count(value).alias("n"), F.sum(value).alias("__s"))
    all_ = Window.partitionBy(key)
    rest = F.sum("n").over(all_) - F.col("n")
    other = F.when(rest > 0, (F.sum("__s").over(all_) - F.col("__s")) / rest)
    return per.select(key, fold, "n", (F.col("__s") / F.col("n")).alias("own"), other.alias("other"))


def admissibility(runs: DataFrame) -> DataFrame:
    """runs with admission: what a run's mean force or free energy may be used for, from ensemble, grade, kept (production blocks) and use (of its forces)."""
    equilibrium = F.coalesce(F.col("ensemble").isin("nvt", "npt", "nve"), F.lit(False))
    admission = (
        F.when(~equilibrium | (F.coalesce("kept", F.lit(0)) == 0) | (F.coalesce("grade", F.lit("unqualified")) == "unqualified"), "inadmissible")
        .when((F.col("grade") == "qualified") & (F.col("use") == "admissible"), "admissible").when(F.col("use") == "inadmissible", "positions_only").otherwise("provisional")
    )
    return runs.withColumn("admission", admission)


def plan_feasibility(units: DataFrame, condition: str, roles: Sequence[str] = ("monitor", "calibration", "locked")) -> DataFrame:
    """condition, units, a count per role, feasible (each role has a unit and some are left to learn from), independence: strong from 20 units on, weak from 10, else none."""
    counts = [F.sum((F.col("role") == r).cast("bigint")).alias(r) for r in (*roles, "development")]
    out = units.groupBy(condition).agg(F.count("*").alias("units"), *counts)
    feasible = F.col("development") > 0
    for r in roles:
        feasible &= F.col(r) > 0
    grade = F.when(F.col("units") >= 20, "strong").when(F.col("units") >= 10, "weak").otherwise("none")
    return out.withColumns({"feasible": feasible, "independence": grade})


def witness_weights(witnesses: DataFrame, unit: str, witness: str) -> DataFrame:
    """unit, witness, w: every correlation unit weighs alike, and so do its witnesses."""
    per = witnesses.select(unit, witness).distinct()
    inside = per.groupBy(unit).agg(F.count("*").alias("__n"))
    units = inside.agg(F.count("*").alias("__u"))
    return per.join(inside, unit).join(F.broadcast(units)).select(unit, witness, (1 / (F.col("__n") * F.col("__u"))).alias("w"))


def feature_extents(rows: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """feature, low, high, width: exact quantiles of each column, in one aggregate."""
    one = rows.agg(*[F.percentile(F.col(c), F.array(F.lit(low), F.lit(high))).alias(c) for c in columns])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)[0].alias("low"), F.col(c)[1].alias("high")) for c in columns])
    return one.select(F.explode(each).alias("e")).select("e.*").withColumn("width", F.col("high") - F.col("low"))


def observed(recipes: dict, names: Sequence[str], *args) -> DataFrame:
    """observable, value: the named recipes of a registry, each a function that gives one row with a value."""
    if unknown := [n for n in names if n not in recipes]:
        raise KeyError(f"no observable {unknown}")
    out = None
    for name in names:
        row = recipes[name](*args).select(F.lit(name).alias("observable"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out

