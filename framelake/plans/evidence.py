"""Queries of the rule tables and grades, of environments, symmetry actions and spectra as tensors."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded, rounded_length
from framelake.operators import density as D
from framelake.operators import evidence as E
from framelake.operators import graphs as G
from framelake.operators import pairs as P
from framelake.operators import prep as R
from framelake.operators import spectral as S
from framelake.operators import stats as T
from framelake.plans.catalog import query
from framelake.plans.graphs import EDGES, _edges
from framelake.plans.pairings import ANGLES, CUBE, PAIRS, RC
from framelake.plans.spectra import SPECTRUM, _spectrum
from framelake.sources.tables import BOX, POINTS, TRAJ, points, read, trajectories

EVIDENCE = "WITH r AS (SELECT p_partkey AS run, p_size % 2 = 0 AS velocities, CASE p_size % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'finite_difference' END AS velocity_source, p_size % 5 <> 0 AS forces, CAST(p_size % 7 // 6 AS DOUBLE) AS max_origin, ['present', 'absent', NULL][1 + p_partkey % 3] AS complete, ['present', 'absent', NULL][1 + p_partkey // 3 % 3] AS bias, ['absent', 'present', NULL][1 + p_partkey // 9 % 3] AS stochastic FROM part)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    pick = lambda values, k: F.element_at(F.array(*[F.lit(v) for v in values]), (k % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        key.alias("run"), (size % 2 == 0).alias("velocities"), F.when(size % 3 == 0, "native").when(size % 3 == 1, "finite_difference").alias("velocity_source"), (size % 5 != 0).alias("forces"), F.expr("cast(p_size % 7 div 6 as double)").alias("max_origin"),
        pick(["present", "absent", None], key).alias("complete"), pick(["present", "absent", None], F.expr("p_partkey div 3")).alias("bias"), pick(["absent", "present", None], F.expr("p_partkey div 9")).alias("stochastic"),
    )


@query(EVIDENCE + " SELECT run, CASE WHEN NOT velocities THEN 'unavailable' WHEN velocity_source = 'finite_difference' THEN 'finite_difference_cartesian' WHEN velocity_source = 'native' THEN 'cartesian' ELSE 'unknown' END AS velocity_frame, CASE WHEN forces THEN 'cartesian_covector' ELSE 'unavailable' END AS force_frame, CASE WHEN max_origin = 0 THEN 'zero_origin' ELSE 'laboratory' END AS origin_frame FROM r")
def field_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.field_semantics(_runs(spark, sf_dir)).select("run", "velocity_frame", "force_frame", "origin_frame")


ADMISSION = EVIDENCE + """, u AS (SELECT run, CASE WHEN forces THEN 'affine_covector' ELSE 'unavailable' END AS geometry, CASE WHEN NOT forces THEN 'unknown_provenance' WHEN bias = 'present' OR stochastic = 'present' THEN 'inadmissible'
    WHEN complete IS NULL OR complete = 'absent' OR bias IS NULL OR stochastic IS NULL THEN 'unknown_provenance' ELSE 'admissible' END AS use FROM r)"""


@query(ADMISSION + " SELECT run, geometry, use FROM u")
def force_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.force_admissibility(E.field_semantics(_runs(spark, sf_dir))).select("run", "geometry", "use")


PRODUCTION = f"""
    WITH {TRAJ}, b AS (SELECT atom, frame // 4 AS block, avg(x) AS m FROM traj GROUP BY ALL HAVING count(*) = 4), s AS (SELECT a.atom, a.block AS start, count(*) AS n, regr_slope(z.m, z.block) AS slope, regr_sxx(z.m, z.block) AS sxx, regr_sxy(z.m, z.block) AS sxy, regr_syy(z.m, z.block) AS syy, avg(z.m) AS mean
      FROM b a JOIN b z ON z.atom = a.atom AND z.block >= a.block GROUP BY ALL),
    g AS (SELECT atom, max(struct_pack(n := n, start := start, mean := mean)) AS b FROM s WHERE n >= 4 AND abs(slope) <= 2 * sqrt(greatest(0, syy - sxy * sxy / sxx) / (n - 2) / sxx) GROUP BY atom), k AS (SELECT atom, count(*) AS blocks FROM b GROUP BY 1),
    p AS (SELECT k.atom, blocks, b.start AS start, coalesce(b.n, 0) AS kept, b.mean AS mean FROM k LEFT JOIN g USING (atom))
"""


def _production(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.production_start(T.block_means(trajectories(spark, sf_dir), ["atom"], "frame", "x", 4), "atom", "block", "mean")


@query(PRODUCTION + " SELECT atom, blocks, start, kept, round(mean, 6) AS mean FROM p")
def production_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _production(spark, sf_dir).withColumn("mean", F.round("mean", 6))


@query("""
    WITH s AS (SELECT event_type, event_id % 5 AS fold, count(value) AS n, sum(value) AS s FROM events GROUP BY ALL)
    SELECT event_type, fold, n, round(s / n, 6) AS own, round((sum(s) OVER w - s) / (sum(n) OVER w - n), 6) AS other FROM s WINDOW w AS (PARTITION BY event_type)
""")
def cross_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("fold", F.col("event_id") % 5)
    out = E.cross_fitted(rows, "event_type", "fold", "value")
    return out.select("event_type", "fold", "n", rounded(F.col("own")).alias("own"), rounded(F.col("other")).alias("other"))


@query(PRODUCTION + f", u AS (SELECT * FROM ({ADMISSION} SELECT * FROM u)), j AS (SELECT atom, kept, use, ['nvt', 'npt', 'nve', 'unresolved'][1 + atom % 4] AS ensemble, ['qualified', 'degraded', 'unqualified'][1 + atom % 3] AS grade FROM p JOIN u ON u.run = atom) "
       "SELECT atom, CASE WHEN ensemble = 'unresolved' OR kept = 0 OR grade = 'unqualified' THEN 'inadmissible' WHEN grade = 'qualified' AND use = 'admissible' THEN 'admissible' WHEN use = 'inadmissible' THEN 'positions_only' ELSE 'provisional' END AS admission FROM j")
def run_admissibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = E.force_admissibility(E.field_semantics(_runs(spark, sf_dir))).select(F.col("run").alias("atom"), "use")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("atom") % len(values) + 1).cast("int"))
    runs = _production(spark, sf_dir).join(use, "atom").withColumns({"ensemble": pick(["nvt", "npt", "nve", "unresolved"]), "grade": pick(["qualified", "degraded", "unqualified"])})
    return E.admissibility(runs).select("atom", "admission")


ROLES = """
    WITH u AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY source) AS n FROM documents),
    r AS (SELECT doc_id, source, CASE WHEN n < 10 THEN 'development' WHEN position % 10 = 1 THEN 'monitor' WHEN position % 10 = 4 THEN 'calibration' WHEN position % 10 = 7 THEN 'locked' WHEN position % 10 IN (0, 2, 3, 5, 6, 8) THEN 'purged' ELSE 'development' END AS role FROM u)
"""


@query(ROLES + """ SELECT source, count(*) AS units, count(*) FILTER (role = 'monitor') AS monitor, count(*) FILTER (role = 'calibration') AS calibration, count(*) FILTER (role = 'locked') AS locked, count(*) FILTER (role = 'development') AS development,
    bool_or(role = 'monitor') AND bool_or(role = 'calibration') AND bool_or(role = 'locked') AND bool_or(role = 'development') AS feasible, CASE WHEN count(*) >= 20 THEN 'strong' WHEN count(*) >= 10 THEN 'weak' ELSE 'none' END AS independence FROM r GROUP BY source""")
def plan_feasibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.plan_feasibility(R.outer_roles(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"]), "source")


@query(ROLES + ", c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT d.doc_id, 1.0::DOUBLE / n AS w FROM documents d JOIN c ON c.lang IS NOT DISTINCT FROM d.lang) SELECT r.doc_id, r.source, role, round(w / (SELECT avg(w) FROM w), 9) AS weight, sha256(text) AS frame FROM r JOIN w USING (doc_id) JOIN documents d USING (doc_id) WHERE role IN ('development', 'monitor')")
def dataset_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be learned from or watched: documents with their role, weight and identity."""
    docs = read(spark, sf_dir, "documents").withColumn("condition", F.coalesce("lang", F.lit("")))
    roles = R.outer_roles(docs.select("doc_id", "source"), "source", ["doc_id"]).filter("role in ('development', 'monitor')").select("doc_id", "source", "role")
    never = F.lit(False)
    weights = R.configuration_weights(docs.select("doc_id", "condition"), "condition", "doc_id", never, never, never)
    return roles.join(weights, "doc_id").join(docs.select("doc_id", F.sha2("text", 256).alias("frame")), "doc_id").withColumn("weight", F.round("weight", 9))


@query("WITH p AS (SELECT DISTINCT l_suppkey AS unit, l_partkey AS witness FROM lineitem), n AS (SELECT unit, count(*) AS n FROM p GROUP BY 1) SELECT unit, witness, round(1.0::DOUBLE / (n * (SELECT count(*) FROM n)), 12) AS w FROM p JOIN n USING (unit)")
def witness_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_partkey").alias("witness"))
    return E.witness_weights(rows, "unit", "witness").withColumn("w", F.round("w", 12))


@query(f"WITH {POINTS}, f AS (SELECT unnest(['x', 'y', 'z']) AS feature, unnest([x, y, z]) AS v FROM pts), q AS (SELECT feature, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.99) AS high FROM f GROUP BY 1) SELECT feature, round(low, 6) AS low, round(high, 6) AS high, round(high - low, 6) AS width FROM q")
def feature_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.feature_extents(points(spark, sf_dir), ["x", "y", "z"])
    return out.select("feature", *[F.round(c, 6).alias(c) for c in ("low", "high", "width")])


RECIPES = {
    "mean_coordination": lambda p, pairs: P.coordination(p, pairs).agg(F.avg("cn").alias("value")),
    "nearest_distance": lambda p, pairs: pairs.groupBy("frame", "i").agg(F.min("r").alias("r")).agg(F.avg("r").alias("value")),
    "number_density": lambda p, pairs: p.groupBy("frame").agg((F.count("*") / BOX**3).alias("d")).agg(F.avg("d").alias("value")),
}


@query(PAIRS + f", n AS (SELECT frame, i, count(*) AS cn, min(r) AS r FROM p WHERE r < {RC} GROUP BY ALL) SELECT 'mean_coordination' AS observable, round(sum(cn) / (SELECT count(*) FROM pts), 9) AS value FROM n UNION ALL SELECT 'nearest_distance', round(avg(r), 9) FROM n UNION ALL SELECT 'number_density', round(avg(d), 9) FROM (SELECT count(*) / 1000.0::DOUBLE AS d FROM pts GROUP BY frame)")
def observable_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return E.observed(RECIPES, list(RECIPES), p, P.neighbors(p, p, CUBE, RC)).withColumn("value", F.round("value", 9))


@query(ANGLES.replace("SELECT a.frame, a.i,", "SELECT a.r AS ra, b.r AS rb, a.sj AS sa, b.sj AS sb, a.frame, a.i,") + " SELECT frame, i, a, b, round(ra, 6) AS ra, round(rb, 6) AS rb, round(degrees(acos(greatest(-1, least(1, cosine)))), 4) AS degrees FROM t WHERE (sa = 1 AND sb = 3) OR (sa = 3 AND sb = 1)")
def angle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    # other neighbours can't be the ends of these angles
    ends = P.neighbors(p, p.filter("species in (1, 3)"), CUBE, RC, home=True)
    out = P.angle_table(P.triplets(ends), (1, 3))
    return out.select("frame", "i", "a", "b", F.round("ra", 6).alias("ra"), F.round("rb", 6).alias("rb"), F.round("degrees", 4).alias("degrees"))


ENVIRONMENT = PAIRS + """, gr AS (SELECT frame, i AS atom, list_sort(list(r)) AS d FROM p WHERE r < 2.5 AND si IN (1, 3) AND sj % 2 = 0 GROUP BY ALL),
    ev AS (SELECT a.frame, a.atom, a.species, gr.d[1] AS d1, gr.d[2] AS d2, gr.d[3] AS d3, gr.d[4] AS d4, list_filter(coalesce(gr.d, []), lambda q: q < 2) AS near FROM pts a LEFT JOIN gr USING (frame, atom) WHERE a.species IN (1, 3)),
    env AS (SELECT frame, atom, species, d1, d2, d3, d4, CAST(len(near) AS INTEGER) AS coordination, list_avg(near) AS mean, list_stddev_pop(near) AS std, list_max(near) - list_min(near) AS spread FROM ev)"""


def _environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    ions = p.filter("species in (1, 3)")
    return P.ion_environments(ions, P.neighbors(ions, p.filter("species % 2 = 0"), CUBE, 2.5), 2.0)


@query(ENVIRONMENT + " SELECT frame, atom, species, round(d1, 6) AS d1, round(d2, 6) AS d2, round(d3, 6) AS d3, round(d4, 6) AS d4, coordination, round(mean, 6) AS mean, round(std, 5) AS std, round(spread, 6) AS spread FROM env")
def ion_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _environments(spark, sf_dir)
    return out.select("frame", "atom", "species", "coordination", *[F.round(c, 6).alias(c) for c in ("d1", "d2", "d3", "d4", "mean", "spread")], F.round("std", 5).alias("std"))


@query(ENVIRONMENT + " SELECT frame, round(avg(d1) FILTER (species = 1), 6) AS d1_mean_1, round(avg(d1) FILTER (species = 3), 6) AS d1_mean_3, round(min(d1) FILTER (species = 1), 6) AS d1_least_1, round(min(d1) FILTER (species = 3), 6) AS d1_least_3, round(max(d1) FILTER (species = 1), 6) AS d1_most_1, round(max(d1) FILTER (species = 3), 6) AS d1_most_3 FROM env GROUP BY frame")
def frame_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.frame_environments(_environments(spark, sf_dir), [1, 3], ["d1"])
    return out.select("frame", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


HARMONICS = f"""
    WITH {POINTS}, m AS (SELECT *, (atom // 24) * 4 + frame AS ring, row_number() OVER (PARTITION BY frame, atom // 24 ORDER BY atom) - 1 AS place, count(*) OVER (PARTITION BY frame, atom // 24) AS members FROM pts),
    d AS (SELECT i.frame, i.atom AS ion, m.ring, m.place, m.members, m.x - i.x AS a, m.y - i.y AS b, m.z - i.z AS c FROM pts i JOIN m ON m.frame = i.frame WHERE i.species = 1),
    r AS (SELECT *, sqrt((a - round_even(a / 10, 0) * 10) ** 2 + (b - round_even(b / 10, 0) * 10) ** 2 + (c - round_even(c / 10, 0) * 10) ** 2) AS dist FROM d), k AS (SELECT unnest(range(4)) AS k),
    h AS (SELECT frame, ion, ring, k.k, members, sum(dist * cos(2 * {math.pi!r} * k.k * place / members)) / members AS re, -sum(dist * sin(2 * {math.pi!r} * k.k * place / members)) / members AS im FROM r, k WHERE k.k <= least(3, members // 2) GROUP BY frame, ion, ring, k.k, members)
"""


def _harmonics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, points and rings: each ion with all rings of its frame."""
    p = points(spark, sf_dir)
    ring = (F.expr("atom div 24") * 4 + F.col("frame")).alias("ring")
    rings = R.with_position(p.select("atom", "frame", ring), ["atom"], ["ring"]).select("ring", "atom", F.col("position").alias("place"))
    return p.filter("species = 1").select("frame", F.col("atom").alias("ion"), "x", "y", "z"), p, rings


@query(HARMONICS + " SELECT frame, ion, ring, CAST(k AS INTEGER) AS k, round(sqrt(re * re + im * im), 6) AS amplitude, CAST(members AS INTEGER) AS members FROM h")
def coordination_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coordination_fingerprints(*_harmonics(spark, sf_dir), CUBE).select("frame", "ion", "ring", "k", rounded_length(F.col("amplitude"), 6).alias("amplitude"), "members")


@query(HARMONICS + " SELECT ring, CAST(k AS INTEGER) AS k, count(*) AS samples, round(avg(sqrt(re * re + im * im)), 6) AS amplitude, round(sqrt(avg(re / sqrt(re * re + im * im)) ** 2 + avg(im / sqrt(re * re + im * im)) ** 2), 5) AS resultant FROM h GROUP BY ring, k")
def harmonic_locking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.harmonic_locking(*_harmonics(spark, sf_dir), CUBE)
    return out.select("ring", "k", "samples", F.round("amplitude", 6).alias("amplitude"), F.round("resultant", 5).alias("resultant"))


@query("SELECT l_shipmode, n, round(share, 6) AS share, round(slope, 9) + 0.0 AS slope, round(r2, 9) AS r2 FROM (SELECT l_linestatus || l_returnflag AS l_shipmode, count(*) AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END) AS share, regr_slope(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END, l_quantity) AS slope, regr_r2(CASE WHEN l_discount > 0.05 THEN 1.0::DOUBLE ELSE 0 END, l_quantity) AS r2 FROM lineitem GROUP BY 1)")
def conditioned_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", "l_returnflag").alias("l_shipmode"), (F.col("l_discount") > 0.05).cast("int").alias("member"), "l_quantity")
    out = P.conditioned_membership(rows, "l_shipmode", "member", "l_quantity")
    return out.select("l_shipmode", "n", F.round("share", 6).alias("share"), rounded(F.col("slope"), 9).alias("slope"), F.round("r2", 9).alias("r2"))


TURN = [0, 1, 0, 0, 0, 1, 1, 0, 0]
ACTION = "act AS (SELECT atom AS vertex, 499 - atom AS image, CAST(atom % 3 - 1 AS INTEGER) AS tx, CAST(atom % 2 AS INTEGER) AS ty, 0 AS tz FROM pts)"


def _action(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("atom")
    return points(spark, sf_dir).select(a.alias("vertex"), (499 - a).alias("image"), (a % 3 - 1).cast("int").alias("tx"), (a % 2).cast("int").alias("ty"), F.lit(0).alias("tz"))


@query(f"WITH {POINTS}, {ACTION}, l AS (SELECT atom AS vertex, CAST(atom % 5 AS INTEGER) AS nx, CAST(-(atom % 4) AS INTEGER) AS ny, CAST(frame AS INTEGER) AS nz FROM pts) SELECT image AS vertex, ny + tx AS nx, nz + ty AS ny, nx + tz AS nz FROM l JOIN act USING (vertex)")
def mapped_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every atom in some image, under a turn of the axes and a reversal of the atoms."""
    lifted = points(spark, sf_dir).select(F.col("atom").alias("vertex"), (F.col("atom") % 5).cast("int").alias("nx"), (-(F.col("atom") % 4)).cast("int").alias("ny"), F.col("frame").cast("int").alias("nz"))
    return G.map_vertices(lifted, _action(spark, sf_dir), TURN)


@query(EDGES + f""", {ACTION}, l AS (SELECT e.*, CAST(u % 3 AS INTEGER) AS ax, 0 AS ay, 1 AS az FROM e), j AS (SELECT a.image AS iu, b.image AS iv, sy + b.tx - a.tx AS x, sz + b.ty - a.ty AS y, sx + b.tz - a.tz AS z, ay + a.tx AS p, az + a.ty AS q, ax + a.tz AS r FROM l JOIN act a ON a.vertex = l.u JOIN act b ON b.vertex = l.v)
    SELECT CASE WHEN iu > iv THEN iv ELSE iu END AS u, CASE WHEN iu > iv THEN iu ELSE iv END AS v, CASE WHEN iu > iv THEN -x ELSE x END AS sx, CASE WHEN iu > iv THEN -y ELSE y END AS sy, CASE WHEN iu > iv THEN -z ELSE z END AS sz,
      CASE WHEN iu > iv THEN p + x ELSE p END AS ax, CASE WHEN iu > iv THEN q + y ELSE q END AS ay, CASE WHEN iu > iv THEN r + z ELSE r END AS az FROM j""")
def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir).withColumns({"ax": (F.col("u") % 3).cast("int"), "ay": F.lit(0), "az": F.lit(1)})
    return G.map_edges(edges, _action(spark, sf_dir), TURN)


@query(f"""
    WITH {POINTS}, u AS (SELECT (x / 10 - floor(x / 10)) * 6 AS a, (y / 10 - floor(y / 10)) * 5 AS b, (z / 10 - floor(z / 10)) * 4 AS c FROM pts WHERE species = 1), o AS (SELECT i, j, k FROM range(2) t(i), range(2) t2(j), range(2) t3(k)),
    w AS (SELECT CAST((floor(a) + i) % 6 AS INTEGER) AS ix, CAST((floor(b) + j) % 5 AS INTEGER) AS iy, CAST((floor(c) + k) % 4 AS INTEGER) AS iz,
      (CASE WHEN i = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE WHEN j = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) * (CASE WHEN k = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS m FROM u, o)
    SELECT ix, iy, iz, round(3 * sum(m), 6) AS mass FROM w GROUP BY ALL
""")
def registered_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames that drift as a whole give three times the density of one."""
    p = points(spark, sf_dir).drop("frame").withColumn("frame", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    drifted = p.select("frame", "atom", "species", *[(F.col(a) / BOX + s * F.col("frame")).alias(f"f{a}") for a, s in zip("xyz", (0.031, -0.017, 0.043))])
    out = D.registered_density(drifted, ["fx", "fy", "fz"], F.col("species") % 2 == 0, F.col("species") == 1, (6, 5, 4))
    # a coordinate that rounding moves across a node gives the node beyond it a mass of nothing
    return out.withColumn("mass", F.round("mass", 6)).filter("mass > 0")


@query(f"""
    WITH {TRAJ}, h AS (SELECT atom, frame, x, t / 36000 AS h FROM traj), n AS (SELECT atom, count(*) AS n FROM h GROUP BY 1), g AS (SELECT atom, unnest(range(0, (n - 16) // 8 + 1)) AS g FROM n WHERE n >= 16),
    y AS (SELECT g.atom, g.g, t.frame - g.g * 8 AS j, t.x, t.h FROM g JOIN h t ON t.atom = g.atom AND t.frame >= g.g * 8 AND t.frame < g.g * 8 + 16),
    d AS (SELECT atom, g, j, (x - avg(x) OVER w) * (0.5 - 0.5 * cos(2 * {math.pi!r} * j / 16)) AS x, (h - avg(h) OVER w) * (0.5 - 0.5 * cos(2 * {math.pi!r} * j / 16)) AS h FROM y WINDOW w AS (PARTITION BY atom, g)), k AS (SELECT unnest(range(9)) AS k),
    f AS (SELECT atom, g, k, sum(x * cos(2 * {math.pi!r} * k * j / 16)) AS xc, sum(x * sin(2 * {math.pi!r} * k * j / 16)) AS xs, sum(h * cos(2 * {math.pi!r} * k * j / 16)) AS hc, sum(h * sin(2 * {math.pi!r} * k * j / 16)) AS hs FROM d, k GROUP BY ALL),
    c AS (SELECT k, (1 + atom % 3) AS w, unnest(['x', 'x', 'h']) AS a, unnest(['x', 'h', 'h']) AS b, unnest([xc * xc + xs * xs, xc * hc + xs * hs, hc * hc + hs * hs]) AS re, unnest([0, xc * hs - xs * hc, 0]) AS im FROM f)
    SELECT k, a, b, round((CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) * sum(w * re) / count(*) / 6.0::DOUBLE, 3) + 0.0 AS re, round((CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END) * sum(w * im) / count(*) / 6.0::DOUBLE, 3) + 0.0 AS im FROM c GROUP BY k, a, b
""")
def welch_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross densities of value and time, atoms weighted by a mass."""
    rows = trajectories(spark, sf_dir).select("atom", "frame", "x", (F.col("t") / 36000).alias("h"), (1 + F.col("atom") % 3).cast("double").alias("m"))
    out = S.welch_tensor(rows, "atom", "frame", ["x", "h"], 16, weight="m")
    return out.select("k", "a", "b", rounded(F.col("re"), 3).alias("re"), rounded(F.col("im"), 3).alias("im"))


@query(SPECTRUM + ", t AS (SELECT max(abs(power)) AS top FROM s) SELECT k, round(power, 4) + 0.0 AS preserved, round(CASE WHEN power < 0 AND abs(power) <= 0.05 * top THEN 0 ELSE power END, 4) + 0.0 AS clipped FROM s, t")
def negative_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spectrum(spark, sf_dir)
    kept, clipped = S.ruled_negatives(s, "power"), S.ruled_negatives(s, "power", "clip_roundoff", 0.05)
    return kept.select("k", rounded(F.col("power"), 4).alias("preserved")).join(clipped.select("k", rounded(F.col("power"), 4).alias("clipped")), "k")
