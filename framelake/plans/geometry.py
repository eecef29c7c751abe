"""Queries of the normalisation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import determinant, rounded
from framelake.operators import normalize as N
from framelake.plans.catalog import query
from framelake.sources.tables import POINTS, TRAJ, points, read, trajectories

CELL = (10.0, 0.0, 0.0, 2.0, 9.0, 0.0, 1.0, -1.0, 8.0)
AXES = ("x", "y", "z")


@query(f"WITH {POINTS} SELECT atom, frame, x, y, z FROM pts WHERE species IN (1, 3)")
def select_atoms_by_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.select_atoms(points(spark, sf_dir), species=[1, 3]).select("atom", "frame", "x", "y", "z")


@query(f"WITH {POINTS} SELECT atom, frame, species FROM pts WHERE atom IN (SELECT l_suppkey FROM lineitem)")
def select_atoms_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("atom")).distinct()
    return N.select_atoms(points(spark, sf_dir), atoms=ids).select("atom", "frame", "species")


@query(f"WITH {TRAJ} SELECT atom, CAST((frame - 2) // 3 AS BIGINT) AS frame, x FROM traj WHERE frame >= 2 AND frame < 40 AND (frame - 2) % 3 = 0")
def select_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.select_frames(trajectories(spark, sf_dir), 2, 40, 3).select("atom", "frame", "x")


@query("SELECT l_orderkey AS frame, l_partkey AS source_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) - 1 AS atom FROM (SELECT DISTINCT l_orderkey, l_partkey, 0 AS l_linenumber, 0 AS l_suppkey, 0 AS l_extendedprice FROM lineitem)")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("source_id")).distinct()
    return N.canonical_order(rows).select("frame", "source_id", "atom")


@query(f"""
    WITH {TRAJ}, g AS (SELECT frame, count(*) AS n, count(DISTINCT atom) AS ids, list_sort(list(atom)) AS who FROM traj GROUP BY frame),
    f AS (SELECT who FROM g WHERE frame = 0)
    SELECT g.frame, g.n, g.ids FROM g, f WHERE g.n <> g.ids OR g.who <> f.who
""")
def population_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.population_faults(trajectories(spark, sf_dir), "atom")


@query(f"WITH {POINTS} SELECT atom, round(x / 10 - floor(x / 10), 9) AS w FROM pts")
def wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.functions.columns import wrap as wrapped

    return points(spark, sf_dir).select("atom", F.round(wrapped(F.col("x") / 10), 9).alias("w"))


@query(f"""
    WITH {TRAJ}, w AS (SELECT atom, frame, x / 100 - floor(x / 100) AS w FROM traj),
    d AS (SELECT *, w - lag(w) OVER a AS d FROM w WINDOW a AS (PARTITION BY atom ORDER BY frame))
    SELECT atom, frame, round(first_value(w) OVER a + sum(coalesce(d - round_even(d, 0), 0)) OVER a, 6) + 0.0 AS u
    FROM d WINDOW a AS (PARTITION BY atom ORDER BY frame ROWS UNBOUNDED PRECEDING)
""")
def unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).select("atom", "frame", (F.col("x") / 100).alias("f"))
    return N.unwrap(rows, ["f"]).select("atom", "frame", rounded(F.col("u_f")).alias("u"))


@query(f"WITH {TRAJ} SELECT atom, frame, round(x / 100 - floor(x / 100) + (frame % 5 - 2), 9) AS u FROM traj")
def unwrap_by_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).select("atom", "frame", (F.col("x") / 100).alias("f"), (F.col("frame") % 5 - 2).alias("i_f"))
    return N.unwrap_by_flags(rows, ["f"]).select("atom", "frame", F.round("u_f", 9).alias("u"))


GRADIENT = f"""
    WITH {TRAJ}, h AS (SELECT atom, frame, t / 3600 AS t, x FROM traj),
    n AS (SELECT *, lag(x, 2) OVER w AS xm2, lag(x) OVER w AS xm, lead(x) OVER w AS xp, lead(x, 2) OVER w AS xp2,
                 lag(t, 2) OVER w AS tm2, lag(t) OVER w AS tm, lead(t) OVER w AS tp, lead(t, 2) OVER w AS tp2
          FROM h WINDOW w AS (PARTITION BY atom ORDER BY frame))
    SELECT atom, frame, round(CASE
      WHEN tm IS NULL THEN -(2*(tp-t)+(tp2-tp))/((tp-t)*(tp2-t))*x + (tp2-t)/((tp-t)*(tp2-tp))*xp - (tp-t)/((tp2-tp)*(tp2-t))*xp2
      WHEN tp IS NULL THEN (t-tm)/((tm-tm2)*(t-tm2))*xm2 - (t-tm2)/((tm-tm2)*(t-tm))*xm + (2*(t-tm)+(tm-tm2))/((t-tm)*(t-tm2))*x
      ELSE -(tp-t)/((t-tm)*(tp-tm))*xm + ((tp-t)-(t-tm))/((t-tm)*(tp-t))*x + (t-tm)/((tp-t)*(tp-tm))*xp END, 3) + 0.0 AS v
    FROM n
"""


@query(GRADIENT)
def velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).select("atom", "frame", (F.col("t") / 3600).alias("t"), "x")
    return N.velocities(rows, ["x"]).select("atom", "frame", rounded(F.col("v_x"), 3).alias("v"))


@query(f"""
    WITH {TRAJ}, m AS (SELECT frame, sum(CASE WHEN atom % 3 = 0 THEN (1 + atom % 4) * x END) / sum(CASE WHEN atom % 3 = 0 THEN 1 + atom % 4 END) AS m FROM traj GROUP BY frame)
    SELECT atom, frame, round(x - m, 6) + 0.0 AS d FROM traj JOIN m USING (frame)
""")
def drift_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir)
    out = N.remove_drift(rows, ["x"], (1 + F.col("atom") % 4).cast("double"), F.col("atom") % 3 == 0)
    return out.select("atom", "frame", rounded(F.col("d_x")).alias("d"))


@query(f"""
    WITH {POINTS}, s AS (SELECT atom, x - 0.5 AS x, y - 0.25 AS y, z AS z FROM pts)
    SELECT atom, round((72.0*x - 16.0*y - 11.0*z) / 720.0, 9) + 0.0 AS fx, round((80.0*y + 10.0*z) / 720.0, 9) + 0.0 AS fy, round(90.0*z / 720.0, 9) + 0.0 AS fz FROM s
""")
def cart_to_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.to_fractions(points(spark, sf_dir), AXES, CELL, (0.5, 0.25, 0.0))
    return out.select("atom", *[rounded(F.col(f"f_{a}"), 9).alias(f"f{a}") for a in AXES])


@query(f"WITH {POINTS} SELECT atom, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts")
def frac_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.to_positions(N.to_fractions(points(spark, sf_dir), AXES, CELL), AXES, CELL)
    return out.select("atom", *[rounded(F.col(f"c_{a}")).alias(a) for a in AXES])


@query("""
    WITH c AS (SELECT vec_id, [embedding[k]::DOUBLE FOR k IN [1,2,3,4,5,6,7,8,9]] AS m FROM embeddings)
    SELECT vec_id, round(abs(m[1]*(m[5]*m[9]-m[6]*m[8]) - m[2]*(m[4]*m[9]-m[6]*m[7]) + m[3]*(m[4]*m[8]-m[5]*m[7])), 9) AS volume,
           round(-(m[1]+m[5]+m[9])/3, 9) + 0.0 AS pressure FROM c
""")
def volume_and_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.col("embedding")[k].cast("double") for k in range(9)]
    return read(spark, sf_dir, "embeddings").select("vec_id", rounded(F.abs(determinant(m)), 9).alias("volume"), rounded(-(m[0] + m[4] + m[8]) / 3, 9).alias("pressure"))


@query(f"WITH {POINTS} SELECT atom, round(0.6*x + 0.8*y, 9) + 0.0 AS p0, round(-0.8*x + 0.6*y, 9) + 0.0 AS p1 FROM pts")
def subspace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.project(points(spark, sf_dir), AXES, [(0.6, 0.8, 0.0), (-0.8, 0.6, 0.0)])
    return out.select("atom", rounded(F.col("p0"), 9).alias("p0"), rounded(F.col("p1"), 9).alias("p1"))


@query("SELECT event_id, round(value * 0.0433641153087705, 9) AS value FROM events")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.convert_units(read(spark, sf_dir, "events"), "real", value="energy").select("event_id", F.round("value", 9).alias("value"))


@query("""
    SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'ineligible' WHEN CASE WHEN toxic = 1 THEN NULL ELSE toxic END IS NULL THEN 'degraded' ELSE 'eligible' END AS state
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left").withColumn("toxic", F.when(F.col("toxic") == 1, None).otherwise(F.col("toxic")))
    return N.eligibility(rows, ["quality"], ["toxic"]).select("doc_id", "state")
