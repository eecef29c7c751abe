"""Densities on periodic grids as sparse voxel tables (ix, iy, iz, mass)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.durable import discard, kept
from framelake.functions.columns import wrap

AXES = ("x", "y", "z")
VOXEL = ("ix", "iy", "iz")
Shape = tuple[int, int, int]


def grid_shape(edges: Sequence[float], spacing: float) -> Shape:
    """The fewest voxels along each edge that are at most spacing wide."""
    return tuple(max(1, math.ceil(e / spacing - 1e-12)) for e in edges)


def shape_ladder(edges: Sequence[float], spacing: float, limit: int) -> list[Shape]:
    """Shapes from the spacing up by halves, as long as a grid's voxels stay within the limit."""
    out = []
    while math.prod(shape := grid_shape(edges, spacing)) <= limit:
        out.append(shape)
        spacing /= 2
    return out


def cloud_in_cell(points: DataFrame, box: Sequence[float], shape: Shape, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ix, iy, iz, mass: each point is shared by the 8 nodes around it, trilinearly; all mass is kept."""
    at = points
    for a, edge, n in zip(AXES, box, shape):
        u = wrap(F.col(a) / edge) * n
        at = at.withColumns({f"__i{a}": F.floor(u), f"__d{a}": u - F.floor(u)})
    corners = []
    for o in itertools.product((0, 1), repeat=3):
        w = F.lit(1.0)
        for a, side in zip(AXES, o):
            w = w * (F.col(f"__d{a}") if side else 1 - F.col(f"__d{a}"))
        corners.append(F.struct(*[F.pmod(F.col(f"__i{a}") + side, F.lit(n)).cast("int").alias(v) for a, side, n, v in zip(AXES, o, shape, VOXEL)], w.alias("mass")))
    out = at.select(*keys, F.explode(F.array(*corners)).alias("c")).select(*keys, "c.*")
    return out.groupBy(*keys, *VOXEL).agg(F.sum("mass").alias("mass"))


def registered_density(rows: DataFrame, axes: Sequence[str], group: Column, chosen: Column, shape: Shape, sigma: float | None = None, reference: int = 0) -> DataFrame:
    """ix, iy, iz, mass of the chosen atoms over all frames, after the group's drift from the reference frame is taken off their fractions; smoothed if sigma (in cell edges) is given."""
    from framelake.operators.normalize import register_frames

    own = register_frames(rows, axes, group, reference).filter(chosen)
    own = own.select(*[F.col(f"r_{a}").alias(n) for a, n in zip(axes, AXES)])
    voxels = cloud_in_cell(own, (1.0, 1.0, 1.0), shape)
    return voxels if sigma is None else kernel_density(voxels, (1.0, 1.0, 1.0), shape, sigma)


def gaussian_stencil(box: Sequence[float], shape: Shape, sigma: float, cutoff: float = 4.0) -> list[tuple[int, int, int, float]]:
    """(dx, dy, dz, weight) within cutoff sigmas, weights summing to one. As large as the cutoff's sphere in voxels."""
    h = [e / n for e, n in zip(box, shape)]
    reach = [math.ceil(cutoff * sigma / x) for x in h]
    if any(2 * r + 1 > n for r, n in zip(reach, shape)):
        raise ValueError("the stencil is wider than the grid")
    out = []
    for o in itertools.product(*[range(-r, r + 1) for r in reach]):
        r2 = sum((k * x) ** 2 for k, x in zip(o, h))
        if r2 <= (cutoff * sigma) ** 2 * (1 + 1e-12):
            out.append((*o, math.exp(-r2 / (2 * sigma * sigma))))
    total = sum(w for *_, w in out)
    return [(*o, w / total) for *o, w in out]


def stencil_moments(stencil: Sequence[tuple[int, int, int, float]], box: Sequence[float], shape: Shape) -> tuple[float, np.ndarray, np.ndarray]:
    """Mass, mean and covariance of a stencil (driver side)."""
    s = np.array(stencil)
    v, w = s[:, :3] * np.array([e / n for e, n in zip(box, shape)]), s[:, 3]
    mean = w @ v / w.sum()
    return float(w.sum()), mean, (v - mean).T @ ((v - mean) * w[:, None]) / w.sum()


def kernel_density(voxels: DataFrame, box: Sequence[float], shape: Shape, sigma: float, cutoff: float = 4.0) -> DataFrame:
    """voxels spread by a truncated periodic Gaussian; the mass is kept. The stencil is broadcast; its size depends on the grid alone."""
    spark = voxels.sparkSession
    stencil = spark.createDataFrame(gaussian_stencil(box, shape, sigma, cutoff), "dx int, dy int, dz int, w double")
    moved = voxels.join(F.broadcast(stencil))
    named = [F.pmod(F.col(v) + F.col(f"d{a}"), F.lit(n)).cast("int").alias(v) for v, a, n in zip(VOXEL, AXES, shape)]
    return moved.select(*named, (F.col("mass") * F.col("w")).alias("mass")).groupBy(*VOXEL).agg(F.sum("mass").alias("mass"))


def hdr_threshold(voxels: DataFrame, fraction: float, levels: int = 4096) -> DataFrame:
    """One row: the largest mass value such that voxels of at least it hold the fraction of the mass.

    Sums by distinct value; they are ranked in levels of the value, of which one holds the threshold, so
    only that level's values are ordered in one place.
    """
    total = voxels.agg(F.sum("mass").alias("total"), F.max("mass").alias("top"), F.min("mass").alias("low"))
    by = voxels.join(F.broadcast(total)).withColumn("level", F.least(F.floor((F.col("mass") - F.col("low")) / F.greatest(F.col("top") - F.col("low"), F.lit(1e-300)) * levels), F.lit(levels - 1)))
    sums = by.groupBy("level").agg(F.sum("mass").alias("m"), F.max("total").alias("total"))
    above = F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = sums.withColumn("above", above).filter(F.col("above") < fraction * F.col("total")).orderBy("level").limit(1)
    own = by.drop("total").join(F.broadcast(sums.select("level", "above", "total")), "level")
    values = own.groupBy("mass", "above", "total").agg(F.sum("mass").alias("m"))
    run = F.col("above") + F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("mass")))
    return values.withColumn("run", run).filter(F.col("run") >= fraction * F.col("total") * (1 - 1e-12)).agg(F.max("mass").alias("threshold"))


def ascent_pointers(voxels: DataFrame, shape: Shape) -> DataFrame:
    """id, up: each voxel's heaviest neighbour of 26, or itself; ties to the smaller id."""
    ids = voxels.select(*VOXEL, "mass", voxel_id(shape).alias("id"))
    around = [o for o in itertools.product((-1, 0, 1), repeat=3)]
    offers = ids.select("id", "mass", *VOXEL, F.explode(F.array(*[F.struct(*[F.lit(k).alias(a) for k, a in zip(o, AXES)]) for o in around])).alias("o"))
    offers = offers.select(F.struct((-F.col("mass")).alias("m"), F.col("id").alias("id")).alias("offer"), *[F.pmod(F.col(v) + F.col(f"o.{a}"), F.lit(n)).alias(v) for v, a, n in zip(VOXEL, AXES, shape)])
    best = offers.groupBy(*VOXEL).agg(F.min("offer").alias("best"))
    return ids.join(best, list(VOXEL)).select("id", F.col("best.id").alias("up"), "mass")


def voxel_id(shape: Shape):
    return (F.col("ix").cast("bigint") * shape[1] + F.col("iy")) * shape[2] + F.col("iz")


def basins(voxels: DataFrame, shape: Shape) -> DataFrame:
    """id, basin, mass: the mode that steepest ascent ends at, by pointer jumping (each round doubles the path)."""
    held = kept(ascent_pointers(voxels, shape))
    now = held.select("id", "up", "mass")
    while True:
        up = now.select(F.col("id").alias("up"), F.col("up").alias("next"))
        fresh = kept(now.join(up, "up").select("id", F.col("next").alias("up"), F.col("up").alias("old"), "mass"))
        moved = fresh.filter("up <> old").limit(1).count()
        discard(held)
        held, now = fresh, fresh.select("id", "up", "mass")
        if not moved:
            return now.select("id", F.col("up").alias("basin"), "mass")


def weighted_moments(points: DataFrame, weight: str, axes: Sequence[str] = AXES) -> DataFrame:
    """One row: weighted means and covariances (population) of the axes, in one aggregate."""
    w = F.col(weight)
    first = points.agg(F.sum(w).alias("w"), *[F.sum(w * F.col(a)).alias(f"s_{a}") for a in axes], *[F.sum(w * F.col(a) * F.col(b)).alias(f"p_{a}{b}") for a, b in itertools.combinations_with_replacement(axes, 2)])
    means = [(F.col(f"s_{a}") / F.col("w")).alias(f"mean_{a}") for a in axes]
    covs = [(F.col(f"p_{a}{b}") / F.col("w") - F.col(f"s_{a}") * F.col(f"s_{b}") / (F.col("w") * F.col("w"))).alias(f"cov_{a}{b}") for a, b in itertools.combinations_with_replacement(axes, 2)]
    return first.select(*means, *covs)


def local_force(points: DataFrame, box: Sequence[float], shape: Shape, forces: Sequence[str], weight: str) -> DataFrame:
    """ix, iy, iz, weight, mean_<f>: the weighted mean force of the points whose voxel it is."""
    at = points.withColumns({v: F.least(F.floor(wrap(F.col(a) / e) * n), F.lit(n - 1)).cast("int") for v, a, e, n in zip(VOXEL, AXES, box, shape)})
    return at.groupBy(*VOXEL).agg(F.sum(weight).alias("weight"), *[(F.sum(F.col(weight) * F.col(f)) / F.sum(weight)).alias(f"mean_{f}") for f in forces])


def circular_mean(rows: DataFrame, keys: Sequence[str], angle: str) -> DataFrame:
    """keys, direction (radians), resultant (0 to 1)."""
    c, s = F.avg(F.cos(angle)), F.avg(F.sin(angle))
    return rows.groupBy(*keys).agg(F.atan2(s, c).alias("direction"), F.sqrt(c * c + s * s).alias("resultant"))
