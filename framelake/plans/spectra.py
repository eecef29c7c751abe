"""Queries of the spectral operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.operators import spectral as S
from framelake.plans.catalog import query
from framelake.plans.dynamics import VACF, _vacf
from framelake.sources.tables import trajectories

SPECTRUM = VACF + f""", k AS (SELECT unnest(range(11)) AS k), y AS (SELECT lag, per_weight * (1 + cos({math.pi!r} * lag / 10.0::DOUBLE)) / 2 AS y FROM v),
    s AS (SELECT k, k / (21 * 0.5::DOUBLE) AS frequency, (CASE WHEN k = 0 THEN 1 ELSE 2 END) * 0.5::DOUBLE * sum(CASE WHEN lag = 0 THEN y ELSE 2 * y * cos(2 * {math.pi!r} * k * lag / 21.0::DOUBLE) END) AS power FROM y, k GROUP BY k)"""


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.one_sided_spectrum(_vacf(spark, sf_dir), "per_weight", 11, 0.5)


@query(SPECTRUM + " SELECT k, round(frequency, 9) AS frequency, round(power, 4) + 0.0 AS power FROM s")
def vacf_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectrum(spark, sf_dir).select("k", F.round("frequency", 9).alias("frequency"), rounded(F.col("power"), 4).alias("power"))


@query(SPECTRUM + " SELECT round((max(frequency) - min(frequency)) / 10 * sum(power), 3) AS integral FROM s")
def bin_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bin_integral(_spectrum(spark, sf_dir), "power").select(rounded(F.col("integral"), 3).alias("integral"))


VDOS = SPECTRUM + ", g AS (SELECT k, greatest(0, power) AS p, (max(frequency) OVER () - min(frequency) OVER ()) / 10 AS w FROM s)"


@query(VDOS + " SELECT k, round(p / (w * sum(p) OVER ()), 9) + 0.0 AS g FROM g")
def vdos_unit_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.density_of_states(_spectrum(spark, sf_dir), "power").select("k", rounded(F.col("g"), 9).alias("g"))


@query(VDOS + " SELECT k, round(p / (w * sum(p) OVER ()) * 9, 6) + 0.0 AS g FROM g")
def vdos_degrees_of_freedom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.density_of_states(_spectrum(spark, sf_dir), "power", "degrees_of_freedom", 9.0).select("k", rounded(F.col("g"), 6).alias("g"))


@query(SPECTRUM + f" SELECT k, round(frequency * {2 * math.pi!r}, 6) AS rad_per_ps, round(frequency * 33.35640951981521::DOUBLE, 6) AS per_cm, round(frequency * 4.135667696923859::DOUBLE, 6) AS mev FROM s")
def frequency_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frequency_axes(_spectrum(spark, sf_dir)).select("k", *[F.round(c, 6).alias(c) for c in S.PER_THZ])


@query(VACF + " SELECT lag, round(total, 3) AS c FROM v UNION ALL SELECT -lag, round(total, 3) FROM v WHERE lag > 0")
def two_sided_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.two_sided(_vacf(spark, sf_dir), [("total", "total")]).select("lag", rounded(F.col("total"), 3).alias("c"))


@query(f"""
    WITH l AS (SELECT unnest(range(11)) AS lag)
    SELECT lag, round((1 + cos({math.pi!r} * (lag / 10.0::DOUBLE))) / 2, 9) + 0.0 AS half_hann,
           round(CASE WHEN lag / 10.0::DOUBLE <= 0.5 THEN 1 ELSE (1 + cos({math.pi!r} * ((lag / 10.0::DOUBLE - 0.5) / 0.5))) / 2 END, 9) + 0.0 AS half_tukey FROM l
""")
def lag_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lag = F.col("lag")
    return spark.range(11).select(F.col("id").alias("lag")).select("lag", rounded(S.taper("half_hann", lag, 11), 9).alias("half_hann"), rounded(S.taper("half_tukey", lag, 11), 9).alias("half_tukey"))


@query(f"""
    WITH traj AS (SELECT user_id AS atom, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS x FROM events),
    n AS (SELECT atom, count(*) AS n FROM traj GROUP BY 1), g AS (SELECT atom, unnest(range(0, (n - 16) // 8 + 1)) AS g FROM n WHERE n >= 16),
    y AS (SELECT g.atom, g.g, t.frame - g.g * 8 AS j, t.x FROM g JOIN traj t ON t.atom = g.atom AND t.frame >= g.g * 8 AND t.frame < g.g * 8 + 16),
    d AS (SELECT atom, g, j, (x - avg(x) OVER (PARTITION BY atom, g)) * (0.5 - 0.5 * cos(2 * {math.pi!r} * j / 16)) AS z FROM y),
    k AS (SELECT unnest(range(9)) AS k),
    f AS (SELECT atom, g, k, sum(z * cos(2 * {math.pi!r} * k * j / 16)) AS re, sum(z * sin(2 * {math.pi!r} * k * j / 16)) AS im FROM d, k GROUP BY ALL)
    SELECT k, round(k / 16.0::DOUBLE, 6) AS frequency, round((CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) * avg(re * re + im * im) / 6.0::DOUBLE, 4) + 0.0 AS power FROM f GROUP BY k
""")
def welch_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.welch(trajectories(spark, sf_dir), "atom", "frame", "x", 16)
    return out.select("k", F.round("frequency", 6).alias("frequency"), rounded(F.col("power"), 4).alias("power"))
