"""Queries of the time-lag operators, on the event values of each user as a trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.operators import lag as L
from framelake.operators.spectral import fft_correlation, fft_msd
from framelake.plans.catalog import query
from framelake.sources.tables import TRAJ, trajectories

LAGS = list(range(11))
PAIRS = f"""
    WITH {TRAJ}, lags AS (SELECT unnest(range(11)) AS lag),
    p AS (SELECT a.atom, a.frame, lag, a.x AS x0, b.x AS x1 FROM traj a, lags JOIN traj b ON b.atom = a.atom AND b.frame = a.frame + lag)
"""


@query(PAIRS + "SELECT lag, round(avg((x1 - x0) * (x1 - x0)), 6) + 0.0 AS msd, count(*) AS pairs FROM p GROUP BY lag")
def msd_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.msd(trajectories(spark, sf_dir), ["x"], LAGS).select("lag", rounded(F.col("msd")).alias("msd"), "pairs")


@query(PAIRS + "SELECT lag, round(avg((x1 - x0) * (x1 - x0)), 6) + 0.0 AS msd, count(*) AS pairs FROM p WHERE frame % 3 = 0 GROUP BY lag")
def msd_with_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.msd(trajectories(spark, sf_dir), ["x"], LAGS, origin_stride=3).select("lag", rounded(F.col("msd")).alias("msd"), "pairs")


@query(f"""
    WITH {TRAJ}, lags AS (SELECT unnest(range(0, 200)) AS lag), p AS (SELECT lag, a.x AS x0, b.x AS x1 FROM traj a, lags JOIN traj b ON b.atom = a.atom AND b.frame = a.frame + lag)
    SELECT lag, round(avg((x1 - x0) * (x1 - x0)), 6) + 0.0 AS msd, count(*) AS pairs FROM p GROUP BY lag
""")
def msd_many_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.msd(trajectories(spark, sf_dir), ["x"], range(200)).select("lag", rounded(F.col("msd")).alias("msd"), "pairs")


@query(PAIRS + "SELECT lag, round(avg((x1 - x0) * (x1 - x0)), 4) + 0.0 AS msd FROM p GROUP BY lag")
def msd_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fft_msd(trajectories(spark, sf_dir), "atom", "frame", ["x"], 11).select("lag", rounded(F.col("msd"), 4).alias("msd"))


@query(PAIRS + """, q AS (SELECT p.lag, p.x1 - p.x0 AS dx, (b.t - a.t) / 3600 AS dt FROM p JOIN traj a ON a.atom = p.atom AND a.frame = p.frame JOIN traj b ON b.atom = p.atom AND b.frame = p.frame + p.lag)
    SELECT lag, round(avg(dx * dx), 6) + 0.0 AS xx, round(avg(dx * dt), 6) + 0.0 AS xh, round(avg(dt * dx), 6) + 0.0 AS hx, round(avg(dt * dt), 6) + 0.0 AS hh FROM q GROUP BY lag""")
def msd_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    out = L.msd_tensor(rows, ["x", "h"], LAGS)
    return out.select("lag", *[rounded(F.col(c)).alias(c) for c in ("xx", "xh", "hx", "hh")])


@query(f"WITH {TRAJ} SELECT b.frame - 5 AS lag, round(avg((b.x - a.x) * (b.x - a.x)), 6) + 0.0 AS msd FROM traj a JOIN traj b ON a.atom = b.atom AND a.frame = 5 AND b.frame >= 5 GROUP BY 1")
def msd_fixed_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.msd_fixed_origin(trajectories(spark, sf_dir), ["x"], 5).select("lag", rounded(F.col("msd")).alias("msd"))


VACF = PAIRS + ", v AS (SELECT lag, sum((1 + atom % 4) * x0 * x1) / count(DISTINCT frame) AS total, sum((1 + atom % 4) * x0 * x1) / sum(1 + atom % 4) AS per_weight, count(DISTINCT frame) AS origins FROM p GROUP BY lag)"


def _vacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.correlation(trajectories(spark, sf_dir).withColumn("w", (1 + F.col("atom") % 4).cast("double")), ["x"], LAGS, "w")


@query(VACF + " SELECT lag, round(total, 4) AS total, round(per_weight, 6) AS per_weight, origins FROM v")
def vacf_by_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vacf(spark, sf_dir).select("lag", rounded(F.col("total"), 4).alias("total"), rounded(F.col("per_weight")).alias("per_weight"), "origins")


@query(PAIRS + "SELECT lag, round(sum(x0 * x1), 3) AS total, count(*) AS pairs FROM p GROUP BY lag")
def vacf_fft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fft_correlation(trajectories(spark, sf_dir), "atom", "frame", ["x"], 11).select("lag", rounded(F.col("total"), 3).alias("total"), "pairs")


@query(PAIRS + """, h AS (SELECT lag, CAST(least(floor(abs(x1 - x0) / 5.0), 20) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY ALL)
    SELECT lag, bin, n, CASE WHEN bin < 20 THEN round(n / sum(n) OVER (PARTITION BY lag) / 10.0, 9) END AS g FROM h""")
def van_hove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.van_hove(trajectories(spark, sf_dir), ["x"], LAGS, 5.0, 20).select("lag", "bin", "n", F.round("g", 9).alias("g"))


@query(PAIRS + "SELECT lag, round(avg((x1-x0)*(x1-x0)*(x1-x0)*(x1-x0)) / (3 * avg((x1-x0)*(x1-x0)) * avg((x1-x0)*(x1-x0))) - 1, 6) + 0.0 AS alpha2 FROM p WHERE lag > 0 GROUP BY lag")
def non_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.non_gaussian(trajectories(spark, sf_dir), ["x"], LAGS).select("lag", rounded(F.col("alpha2")).alias("alpha2"))


@query(PAIRS + "SELECT lag, round(avg(cos(0.05 * (x1 - x0))), 6) + 0.0 AS re, round(avg(sin(0.05 * (x1 - x0))), 6) + 0.0 AS im FROM p GROUP BY lag")
def scattering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.scattering(trajectories(spark, sf_dir), ["x"], LAGS, [0.05]).select("lag", rounded(F.col("re")).alias("re"), rounded(F.col("im")).alias("im"))


CURRENT = f"""
    WITH {TRAJ}, j AS (SELECT frame, atom % 3 AS grp, sum((CASE WHEN atom % 2 = 0 THEN 1.0 ELSE -1.0 END) * x) AS current FROM traj GROUP BY ALL),
    lags AS (SELECT unnest(range(11)) AS lag)
"""


def _currents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.when(F.col("atom") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return L.charge_current(trajectories(spark, sf_dir), "x", q, F.col("atom") % 3)


@query(CURRENT + "SELECT frame, grp, round(current, 6) + 0.0 AS current FROM j")
def charge_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _currents(spark, sf_dir).select("frame", "grp", rounded(F.col("current")).alias("current"))


@query(CURRENT + "SELECT lag, a.grp AS a, b.grp AS b, round(avg(a.current * b.current), 3) + 0.0 AS c, count(*) AS origins FROM j a, lags JOIN j b ON b.frame = a.frame + lag GROUP BY ALL")
def current_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.current_correlation(_currents(spark, sf_dir), LAGS).select("lag", "a", "b", rounded(F.col("c"), 3).alias("c"), "origins")


CURVE = VACF + """, c AS (SELECT lag * 0.5 AS t, per_weight AS y FROM v),
    s AS (SELECT t, y, coalesce((y + lag(y) OVER w) / 2 * (t - lag(t) OVER w), 0) AS s0, coalesce((t * y + lag(t * y) OVER w) / 2 * (t - lag(t) OVER w), 0) AS s1 FROM c WINDOW w AS (ORDER BY t)),
    i AS (SELECT t, y, sum(s0) OVER (ORDER BY t) AS i0, sum(s1) OVER (ORDER BY t) AS i1 FROM s)"""


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vacf(spark, sf_dir).select((F.col("lag") * 0.5).alias("t"), F.col("per_weight").alias("y"))


@query(CURVE + " SELECT CAST(t AS DOUBLE) AS t, round(i0, 6) AS d FROM i")
def diffusion_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.running_integral(_curve(spark, sf_dir), "t", "y").select("t", rounded(F.col("integral")).alias("d"))


@query(CURVE + " SELECT CAST(t AS DOUBLE) AS t, round(2 * (t * i0 - i1), 4) + 0.0 AS msd FROM i")
def msd_from_vacf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.msd_from_correlation(_curve(spark, sf_dir), "t", "y").select("t", rounded(F.col("msd"), 4).alias("msd"))


@query(CURVE + f" SELECT CAST(t AS DOUBLE) AS t, round(i0 * ({L.ELEMENTARY_CHARGE!r}::DOUBLE ** 2 * 1e22 / (3 * 1000.0 * {L.BOLTZMANN!r}::DOUBLE * 300.0)), 3) AS sigma FROM i")
def conductivity_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.conductivity(_curve(spark, sf_dir), "t", "y", 1000.0, 300.0).select("t", rounded(F.col("sigma"), 3).alias("sigma"))


@query(CURVE + """ SELECT count(*) AS n, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.5), 6) AS median, round(stddev_samp(y), 6) AS std, round(regr_slope(y, t), 6) + 0.0 AS slope,
    round(regr_intercept(y, t), 6) AS intercept, round(regr_r2(y, t), 6) AS r2, abs(regr_slope(y, t)) <= 100 AS stable FROM i WHERE t BETWEEN 0.5 AND 5""")
def plateau_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.plateau(_curve(spark, sf_dir), "t", "y", 0.5, 5.0, tolerance=100.0)
    return out.select("n", *[rounded(F.col(c)).alias(c) for c in ("mean", "median", "std", "slope", "intercept", "r2")], "stable")


@query(PAIRS + ", m AS (SELECT lag * 0.5 AS t, avg((x1 - x0) * (x1 - x0)) AS y FROM p GROUP BY lag) SELECT round(regr_slope(y, t) / 2, 4) AS d, round(regr_r2(y, t), 6) AS r2 FROM m")
def einstein_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = L.msd(trajectories(spark, sf_dir), ["x"], LAGS).withColumn("t", F.col("lag") * 0.5)
    return L.einstein_fit(curve, "t", "msd", 1).select(rounded(F.col("d"), 4).alias("d"), rounded(F.col("r2")).alias("r2"))


@query(f"""
    WITH {TRAJ}, s AS (SELECT atom % 3 AS k, count(DISTINCT atom) AS n, avg(x) AS d FROM traj GROUP BY 1)
    SELECT round(sum(n * (k - 1) * (k - 1) * d) * ({L.ELEMENTARY_CHARGE!r}::DOUBLE ** 2 * 1e22 / (1000.0 * {L.BOLTZMANN!r}::DOUBLE * 300.0)), 3) AS sigma FROM s
""")
def nernst_einstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    species = trajectories(spark, sf_dir).groupBy((F.col("atom") % 3).alias("k")).agg(F.count_distinct("atom").alias("n"), F.avg("x").alias("d"))
    return L.nernst_einstein(species.withColumn("z", F.col("k") - 1), 1000.0, 300.0).select(rounded(F.col("sigma"), 3).alias("sigma"))
