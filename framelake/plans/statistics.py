"""Queries of the summaries, distributions and error metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.operators import stats as T
from framelake.plans.catalog import query
from framelake.sources.tables import TRAJ, read, trajectories


@query("""SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
    round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75 FROM events GROUP BY event_type""")
def scalar_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.scalar_summary(read(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", "min", "max", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


@query("SELECT p_size AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p, count(*) = max(count(*)) OVER () AS is_mode FROM part GROUP BY p_size")
def discrete_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.discrete_pmf(read(spark, sf_dir, "part"), "p_size").select("value", "n", F.round("p", 9).alias("p"), "is_mode")


@query(f"""
    WITH {TRAJ}, c AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY atom ORDER BY frame) = state THEN 0 ELSE 1 END AS fresh FROM traj)
    SELECT state, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS p, min(frame) AS first, max(frame) AS last, CAST(sum(fresh) AS BIGINT) AS visits,
           count(*) = max(count(*)) OVER () AS dominant, count(*) = 1 AS singleton FROM c GROUP BY state
""")
def catalog_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.catalog_occupancy(trajectories(spark, sf_dir), "atom", "frame", "state")
    return out.withColumn("p", F.round("p", 9))


@query("WITH p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY event_type) SELECT round(sum(-p * ln(p)), 9) AS entropy, round(exp(sum(-p * ln(p))), 9) AS effective FROM p")
def occupancy_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.entropy(T.discrete_pmf(read(spark, sf_dir, "events"), "event_type"))
    return out.select(F.round("entropy", 9).alias("entropy"), F.round("effective", 9).alias("effective"))


@query("""
    WITH l AS (SELECT DISTINCT lang FROM documents), s AS (SELECT DISTINCT source FROM documents), n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    SELECT lang, source, coalesce(n, 0) AS n FROM l CROSS JOIN s LEFT JOIN n USING (lang, source)
""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.contingency(read(spark, sf_dir, "documents"), "lang", "source")


@query(f"""
    WITH {TRAJ}, s AS (SELECT atom, frame, state, x > 30 AS big FROM traj),
    d AS (SELECT lag(frame) OVER w AS f, state IS DISTINCT FROM lag(state) OVER w AS a, big IS DISTINCT FROM lag(big) OVER w AS b FROM s WINDOW w AS (PARTITION BY atom ORDER BY frame))
    SELECT CASE WHEN a AND b THEN 'coupled' WHEN a THEN 'state' WHEN b THEN 'big' ELSE 'stable' END AS kind, count(*) AS n FROM d WHERE f IS NOT NULL GROUP BY 1
""")
def boundary_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.boundary_kinds(trajectories(spark, sf_dir).withColumn("big", F.col("x") > 30), "atom", "frame", "state", "big")


ERROR = "(l_extendedprice - l_quantity * (900 + l_partkey % 1000)) / 1000"


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("e", (F.col("l_extendedprice") - F.col("l_quantity") * (900 + F.col("l_partkey") % 1000)) / 1000)


@query(f"SELECT l_returnflag, round(sqrt(sum({ERROR} * {ERROR}) / count(*)), 6) AS rmse, round(avg(abs({ERROR})), 6) AS mae, round(max(abs({ERROR})), 6) AS worst, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def metrics_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.force_metrics(_errors(spark, sf_dir), ["l_returnflag"], F.col("e"))
    return out.select("l_returnflag", *[rounded(F.col(c)).alias(c) for c in ("rmse", "mae", "worst")], "n")


@query(f"SELECT l_linestatus, round(sqrt(avg({ERROR} * {ERROR})), 6) AS rmse, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_linestatus)")
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.metrics_rollup(_errors(spark, sf_dir), "l_linestatus", F.col("e")).select("l_linestatus", rounded(F.col("rmse")).alias("rmse"), "n")


@query(f"SELECT l_suppkey AS condition, round(sqrt(avg({ERROR} * {ERROR})), 6) AS rmse FROM lineitem GROUP BY l_suppkey ORDER BY sqrt(avg({ERROR} * {ERROR})) DESC, l_suppkey LIMIT 1")
def worst_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.worst_condition(_errors(spark, sf_dir), "l_suppkey", F.col("e")).select("condition", rounded(F.col("rmse")).alias("rmse"))


@query("""
    WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
    SELECT round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 3) AS rmse, round(max(abs(a.v - b.v)), 3) AS max_abs, count(*) AS n FROM a JOIN b USING (k)
""")
def paired_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    return T.paired_statistics(a, b, ["k"], "v").select(rounded(F.col("rmse"), 3).alias("rmse"), rounded(F.col("max_abs"), 3).alias("max_abs"), "n")


@query("""
    WITH m AS (SELECT l_orderkey AS c, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1), r AS (SELECT abs(m - 25.0) AS res, s FROM m WHERE s > 0), k AS (SELECT sqrt(avg((res / s) * (res / s))) AS scale FROM r)
    SELECT round(max(scale), 6) AS scale, round(avg(CASE WHEN res <= scale * s * (1 + 1e-9) THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n FROM r, k
""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("target", F.lit(25.0))
    return T.calibration(rows, "l_orderkey", "l_quantity", "target").select(rounded(F.col("scale")).alias("scale"), rounded(F.col("coverage")).alias("coverage"), "n")


FLAGS = ["A", "N", "R"]


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS \"n_A\", count(*) FILTER (l_returnflag = 'N') AS \"n_N\", count(*) FILTER (l_returnflag = 'R') AS \"n_R\" FROM lineitem GROUP BY l_orderkey")
def composition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.composition_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", FLAGS)


def _design(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("y"))
    return T.composition_counts(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", FLAGS).join(y, "l_orderkey")


@query("""
    WITH d AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A')::DOUBLE AS a, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS n, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS r, sum(l_quantity) AS y FROM lineitem GROUP BY 1),
    m AS (SELECT sum(a*a) AS aa, sum(a*n) AS an, sum(a*r) AS ar, sum(n*n) AS nn, sum(n*r) AS nr, sum(r*r) AS rr, sum(a*y) AS ay, sum(n*y) AS ny, sum(r*y) AS ry, sum(y*y) AS yy, count(*) AS k FROM d),
    t AS (SELECT *, aa*(nn*rr-nr*nr) - an*(an*rr-nr*ar) + ar*(an*nr-nn*ar) AS det FROM m),
    w AS (SELECT *, (ay*(nn*rr-nr*nr) - an*(ny*rr-nr*ry) + ar*(ny*nr-nn*ry)) / det AS wa, (aa*(ny*rr-nr*ry) - ay*(an*rr-nr*ar) + ar*(an*ry-ny*ar)) / det AS wn, (aa*(nn*ry-ny*nr) - an*(an*ry-ny*ar) + ay*(an*nr-nn*ar)) / det AS wr FROM t),
    e AS (SELECT *, sqrt((yy - 2*(wa*ay+wn*ny+wr*ry) + wa*wa*aa+wn*wn*nn+wr*wr*rr + 2*(wa*wn*an+wa*wr*ar+wn*wr*nr)) / k) AS rmse FROM w)
    SELECT unnest(['n_A', 'n_N', 'n_R']) AS element, round(unnest([wa, wn, wr]), 5) AS energy, CAST(3 AS INTEGER) AS rank, round(rmse, 5) AS rmse FROM e
""")
def reference_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.reference_fit(_design(spark, sf_dir), [f"n_{f}" for f in FLAGS], "y")
    return out.select("element", rounded(F.col("energy"), 5).alias("energy"), "rank", rounded(F.col("rmse"), 5).alias("rmse"))


@query("""
    WITH d AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
    m AS (SELECT sum(a*a)::HUGEINT AS aa, sum(a*n)::HUGEINT AS an, sum(a*r)::HUGEINT AS ar, sum(n*n)::HUGEINT AS nn, sum(n*r)::HUGEINT AS nr, sum(r*r)::HUGEINT AS rr,
                 sum(a*(a+n))::HUGEINT AS ax, sum(n*(a+n))::HUGEINT AS nx, sum(r*(a+n))::HUGEINT AS rx, sum((a+n)*(a+n))::HUGEINT AS xx FROM d),
    t AS (SELECT aa*(nn*rr-nr*nr) - an*(an*rr-nr*ar) + ar*(an*nr-nn*ar) AS three, aa*(nn*xx-nx*nx) - an*(an*xx-nx*ax) + ax*(an*nx-nn*ax) AS flat FROM m)
    SELECT unnest(['n_A', 'n_N', 'n_R', 'n_X']) AS element, unnest([flat <> 0, flat <> 0, three <> 0, flat <> 0]) AS identified FROM t
""")
def rank_identifiability(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _design(spark, sf_dir).withColumn("n_X", F.col("n_A") + F.col("n_N"))
    return T.identifiable(d, ["n_A", "n_N", "n_R", "n_X"])


@query(f"WITH {TRAJ}, g AS (SELECT frame, sum(x) AS k, count(*) AS n FROM traj GROUP BY frame) SELECT frame, round(2 * k / ((3 * n - 3) * 8.617333262e-5::DOUBLE), 2) AS temperature FROM g WHERE n > 1")
def frame_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).groupBy("frame").agg(F.sum("x").alias("k"), F.count("*").alias("n")).filter("n > 1")
    return T.temperature(rows, "frame", "k", "n").select("frame", rounded(F.col("temperature"), 2).alias("temperature"))


@query("""
    SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max,
           CASE WHEN count(value) < 2 THEN 'unresolved' WHEN stddev_pop(value) <= 0.95 * abs(avg(value)) THEN 'constant' ELSE 'varying' END AS condition FROM events GROUP BY user_id
""")
def temperature_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.temperature_condition(read(spark, sf_dir, "events"), "user_id", "value", 0.95)
    return out.select("user_id", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"), "min", "max", "condition")


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, round(abs(l_discount - l_tax), 9) AS deviation, CASE WHEN abs(l_discount - l_tax) <= 0.02 THEN 0 WHEN abs(l_discount - l_tax) <= 0.02 + 2 * sqrt(0.01 * 0.01 + 0.02 * 0.02) THEN 1 ELSE 2 END AS verdict FROM lineitem
""")
def observable_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumns({"u1": F.lit(0.01), "u2": F.lit(0.02)})
    out = T.combined_uncertainty(rows, "l_tax", "l_discount", "u1", "u2", 2.0, 0.02)
    return out.select("l_orderkey", "l_partkey", "l_linenumber", F.round("deviation", 9).alias("deviation"), "verdict")


@query(f"""
    WITH {TRAJ}, b AS (SELECT *, min(x) OVER (PARTITION BY atom ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM traj),
    l AS (SELECT atom, frame, max(CASE WHEN best IS NULL OR x < best - 0.5 THEN frame END) OVER (PARTITION BY atom ORDER BY frame) AS last FROM b)
    SELECT atom, min(CASE WHEN frame - last >= 6 THEN frame END) AS stop FROM l GROUP BY atom
""")
def adaptive_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.adaptive_stop(trajectories(spark, sf_dir), "atom", "frame", "x", 6, 0.5)


@query(f"""
    WITH {TRAJ} SELECT frame, round(sqrt(avg(x * x)), 6) AS rms, round(avg(abs(x)), 6) AS mean, max(abs(x)) AS max, round(quantile_cont(abs(x), 0.9), 6) AS q90, count(*) AS n FROM traj GROUP BY frame
""")
def frame_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.abs("x")
    out = trajectories(spark, sf_dir).groupBy("frame").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg(a).alias("mean"), F.max(a).alias("max"), F.percentile(a, 0.9).alias("q90"), F.count("*").alias("n"))
    return out.select("frame", rounded(F.col("rms")).alias("rms"), rounded(F.col("mean")).alias("mean"), "max", rounded(F.col("q90")).alias("q90"), "n")
