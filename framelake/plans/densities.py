"""Queries of the density operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.operators import density as D
from framelake.plans.catalog import query
from framelake.sources.tables import BOX, POINTS, points, read

CUBE = (BOX, BOX, BOX)
SHAPE = (12, 10, 8)
CIC = f"""
    WITH {POINTS}, u AS (SELECT atom, (x / 10 - floor(x / 10)) * 12 AS a, (y / 10 - floor(y / 10)) * 10 AS b, (z / 10 - floor(z / 10)) * 8 AS c FROM pts),
    o AS (SELECT i, j, k FROM range(2) t(i), range(2) t2(j), range(2) t3(k)),
    w AS (SELECT CAST((floor(a) + i) % 12 AS INTEGER) AS ix, CAST((floor(b) + j) % 10 AS INTEGER) AS iy, CAST((floor(c) + k) % 8 AS INTEGER) AS iz,
                 (CASE WHEN i = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE WHEN j = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) * (CASE WHEN k = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS m FROM u, o),
    v AS (SELECT ix, iy, iz, sum(m) AS mass FROM w GROUP BY ALL)
"""


@query(CIC + "SELECT ix, iy, iz, round(mass, 9) AS mass FROM v")
def cic_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cloud_in_cell(points(spark, sf_dir), CUBE, SHAPE).select("ix", "iy", "iz", F.round("mass", 9).alias("mass"))


SIGMA = 0.9


@query(CIC + f""", s AS (SELECT dx, dy, dz, exp(-((dx * 10 / 12.0::DOUBLE) ** 2 + (dy * 1.0) ** 2 + (dz * 1.25) ** 2) / (2 * {SIGMA} * {SIGMA})) AS w FROM range(-5, 6) t(dx), range(-5, 6) t2(dy), range(-5, 6) t3(dz)
      WHERE (dx * 10 / 12.0::DOUBLE) ** 2 + (dy * 1.0) ** 2 + (dz * 1.25) ** 2 <= (3 * {SIGMA}) ** 2 * (1 + 1e-12)), n AS (SELECT sum(w) AS t FROM s)
    SELECT CAST(((ix + dx) % 12 + 12) % 12 AS INTEGER) AS ix, CAST(((iy + dy) % 10 + 10) % 10 AS INTEGER) AS iy, CAST(((iz + dz) % 8 + 8) % 8 AS INTEGER) AS iz, round(sum(mass * w / t), 9) AS mass FROM v, s, n GROUP BY 1, 2, 3""")
def kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    voxels = D.cloud_in_cell(points(spark, sf_dir), CUBE, SHAPE)
    return D.kernel_density(voxels, CUBE, SHAPE, SIGMA, 3.0).select("ix", "iy", "iz", F.round("mass", 9).alias("mass"))


@query(CIC + ", r AS (SELECT mass, sum(mass) OVER (ORDER BY mass DESC RANGE UNBOUNDED PRECEDING) AS run, sum(mass) OVER () AS total FROM v) SELECT round(max(mass), 9) AS threshold FROM r WHERE run >= 0.7 * total")
def hdr_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hdr_threshold(D.cloud_in_cell(points(spark, sf_dir), CUBE, SHAPE), 0.7).select(F.round("threshold", 9).alias("threshold"))


POINTERS = CIC + """, q AS (SELECT (ix * 10 + iy) * 8 + iz AS id, ix, iy, iz, round(mass, 9) AS mass FROM v), near AS (SELECT a, b, c FROM range(-1, 2) t(a), range(-1, 2) t2(b), range(-1, 2) t3(c)),
    n AS (SELECT p.id, min(struct_pack(m := -w.mass, id := w.id)) AS best FROM q p, near JOIN q w ON w.ix = (p.ix + a + 12) % 12 AND w.iy = (p.iy + b + 10) % 10 AND w.iz = (p.iz + c + 8) % 8 GROUP BY p.id),
    ptr AS (SELECT CAST(id AS BIGINT) AS id, CAST(best.id AS BIGINT) AS up FROM n)"""


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cloud_in_cell(points(spark, sf_dir), CUBE, SHAPE).withColumn("mass", F.round("mass", 9))


@query(POINTERS + " SELECT id, up FROM ptr")
def ascent_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.ascent_pointers(_voxels(spark, sf_dir), SHAPE).select("id", "up")


@query(POINTERS.replace("WITH", "WITH RECURSIVE", 1) + ", walk AS (SELECT id, up FROM ptr UNION SELECT walk.id, ptr.up FROM walk JOIN ptr ON ptr.id = walk.up) SELECT walk.id, walk.up AS basin FROM walk JOIN ptr ON ptr.id = walk.up AND ptr.up = ptr.id")
def basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.basins(_voxels(spark, sf_dir), SHAPE).select("id", "basin")


@query(f"""
    WITH {POINTS}, w AS (SELECT *, 1.0 + atom % 3 AS w FROM pts), m AS (SELECT sum(w) AS t, sum(w*x) AS x, sum(w*y) AS y, sum(w*z) AS z, sum(w*x*x) AS xx, sum(w*x*y) AS xy, sum(w*z*z) AS zz FROM w)
    SELECT round(x / t, 6) AS mean_x, round(y / t, 6) AS mean_y, round(z / t, 6) AS mean_z, round(xx / t - x * x / (t * t), 5) AS cov_xx, round(xy / t - x * y / (t * t), 5) + 0.0 AS cov_xy, round(zz / t - z * z / (t * t), 5) AS cov_zz FROM m
""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.weighted_moments(points(spark, sf_dir).withColumn("w", (1 + F.col("atom") % 3).cast("double")), "w")
    return out.select(*[rounded(F.col(f"mean_{a}")).alias(f"mean_{a}") for a in "xyz"], *[rounded(F.col(c), 5).alias(c) for c in ("cov_xx", "cov_xy", "cov_zz")])


@query(f"""
    WITH {POINTS} SELECT CAST(floor(x / 10 * 4) AS INTEGER) AS ix, CAST(floor(y / 10 * 4) AS INTEGER) AS iy, CAST(floor(z / 10 * 4) AS INTEGER) AS iz, CAST(sum(1 + atom % 3) AS DOUBLE) AS weight,
      round(sum((1 + atom % 3) * (x - y)) / sum(1 + atom % 3), 6) + 0.0 AS mean_f FROM pts GROUP BY 1, 2, 3
""")
def local_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).withColumns({"f": F.col("x") - F.col("y"), "w": (1 + F.col("atom") % 3).cast("double")})
    return D.local_force(p, CUBE, (4, 4, 4), ["f"], "w").select("ix", "iy", "iz", "weight", rounded(F.col("mean_f")).alias("mean_f"))


@query("SELECT event_type, round(atan2(avg(sin(value)), avg(cos(value))), 6) + 0.0 AS direction, round(sqrt(avg(cos(value)) ** 2 + avg(sin(value)) ** 2), 6) AS resultant FROM events GROUP BY event_type")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.circular_mean(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", rounded(F.col("direction")).alias("direction"), rounded(F.col("resultant")).alias("resultant"))
