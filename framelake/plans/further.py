"""Queries of the second-tier operators: validation, gauges, roles, repair, stress, catalogues of states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import rounded
from framelake.functions.registration import j0
from framelake.operators import islands as I
from framelake.operators import lag as L
from framelake.operators import normalize as N
from framelake.operators import pairs as P
from framelake.operators import prep as D
from framelake.operators import selection as S
from framelake.operators import stats as T
from framelake.plans import stepwise
from framelake.plans.catalog import query
from framelake.plans.datasets import COVERS, HASH, _catalog, _covers
from framelake.plans.pairings import CUBE, PAIRS
from framelake.sources.tables import BOX, POINTS, TRAJ, points, read, trajectories


@query(f"""
    WITH {POINTS}, p AS (SELECT *, CASE WHEN atom % 50 <> 7 THEN x END AS x1 FROM pts), f AS (SELECT DISTINCT frame, frame // 2 AS t, frame <> 3 AS solid FROM p UNION ALL SELECT 1, 0, true),
    o AS (SELECT *, lag(t) OVER (ORDER BY frame) AS before FROM f), k AS (SELECT count(*) AS n FROM pts), c AS (SELECT frame, count(*) AS n FROM pts GROUP BY frame)
    SELECT unnest(['frame ids are distinct', 'times increase', 'cells have a volume', 'masses and numbers are positive', 'every frame has every atom once', 'coordinates are finite']) AS rule,
           unnest([(SELECT count(*) FROM (SELECT frame FROM f GROUP BY 1 HAVING count(*) > 1)), (SELECT count(*) FROM o WHERE t <= before), (SELECT count(*) FROM f WHERE NOT solid), (SELECT count(*) FROM pts WHERE species <= 2),
                   (SELECT count(*) FROM c, k WHERE c.n <> k.n), (SELECT count(*) FROM p WHERE x1 IS NULL)]) AS faults
""")
def collection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with faults of every kind but the first cell's: a repeated frame, halting times, a flat cell, odd numbers, missing atoms and coordinates."""
    p = points(spark, sf_dir)
    frames = p.select("frame").distinct().select("frame", F.expr("cast(frame div 2 as double)").alias("t")).unionByName(spark.createDataFrame([(1, 0.0)], "frame bigint, t double"))
    edge = F.when(F.col("frame") == 3, 0.0).otherwise(BOX)
    frames = frames.withColumn("cell", F.array(*[edge if k % 4 == 0 else F.lit(0.0) for k in range(9)]))
    atoms = p.select("atom", (F.col("species") - 2).alias("z"), F.lit(1.0).alias("mass"))
    return N.collection_faults(frames, atoms, p.withColumn("x", F.when(F.col("atom") % 50 != 7, F.col("x"))))


@query("""
    WITH f AS (SELECT vec_id AS frame, (vec_id // 3) % 3 AS state, lag((vec_id // 3) % 3) OVER (ORDER BY vec_id) AS before FROM embeddings)
    SELECT frame, CASE WHEN state = before THEN 'smooth' WHEN state = 1 THEN 'relabelled' ELSE 'handedness' END AS kind FROM f WHERE before IS NOT NULL
""")
def lattice_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that breathe with the vectors, and every third frame change their vectors: as they are, with the first added to the second, and turned over."""
    e = lambda k: 1 + 0.002 * F.col("embedding")[k].cast("double")
    a, b, c = [10 * e(0), 0.1 * e(1), F.lit(0.0)], [F.lit(0.0), 9 * e(2), 0.2 * e(3)], [0.3 * e(4), F.lit(0.0), 8 * e(5)]
    state = F.expr("(vec_id div 3) % 3")
    second = [F.when(state == 0, y).otherwise(x + y) for x, y in zip(a, b)]
    third = [F.when(state == 2, -z).otherwise(z) for z in c]
    return N.lattice_gauge(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.array(*a, *second, *third).alias("cell")))


@query(f"""
    WITH {TRAJ}, f AS (SELECT atom, frame, x / 500 AS f FROM traj), b AS (SELECT atom, f AS b FROM f WHERE frame = 0), s AS (SELECT frame, avg((f - b) - round_even(f - b, 0)) AS s FROM f JOIN b USING (atom) WHERE atom % 2 = 0 GROUP BY frame)
    SELECT atom, frame, round((f - s) - floor(f - s), 9) AS r FROM f JOIN s USING (frame)
""")
def register_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trajectories(spark, sf_dir).select("atom", "frame", (F.col("x") / 500).alias("f"))
    return N.register_frames(rows, ["f"], F.col("atom") % 2 == 0).select("atom", "frame", F.round("r_f", 9).alias("r"))


@query(f"WITH {POINTS} SELECT atom, round(1.01 * x, 9) AS x, round(0.02 * x + y, 9) AS y, round(0.97 * z, 9) AS z FROM pts")
def strained_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.strain(points(spark, sf_dir), ("x", "y", "z"), (0.01, 0.02, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.03))
    return out.select("atom", *[F.round(a, 9).alias(a) for a in "xyz"])


def _moved(a: str) -> str:
    name = f"'3' || chr(0) || '{a}:' || CAST(frame AS VARCHAR) || ':' || CAST(atom AS VARCHAR)"
    return f"round({a} + ({HASH.format(x=name)} * 2 - 1) * 0.05, 9) AS {a}"


@query(f"WITH {POINTS} SELECT atom, {_moved('x')}, {_moved('y')}, {_moved('z')} FROM pts")
def displaced_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.displace(points(spark, sf_dir), ("x", "y", "z"), 0.05, 3).select("atom", *[F.round(a, 9).alias(a) for a in "xyz"])


@query(f"""
    WITH {TRAJ}, ids AS (SELECT atom FROM traj GROUP BY atom HAVING count(*) > 60), r AS (SELECT atom AS source_id, frame // 2 AS frame, t / 3600 AS t, x / 100 AS f FROM traj SEMI JOIN ids USING (atom) WHERE frame < 60 AND frame % 2 = 0),
    p AS (SELECT *, dense_rank() OVER (ORDER BY source_id) - 1 AS atom, f - floor(f) AS w FROM r), d AS (SELECT *, w - lag(w) OVER a AS d FROM p WINDOW a AS (PARTITION BY atom ORDER BY frame)),
    u AS (SELECT atom, frame, t, first_value(w) OVER a + sum(coalesce(d - round_even(d, 0), 0)) OVER a AS u FROM d WINDOW a AS (PARTITION BY atom ORDER BY frame ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT frame, avg(u) AS m FROM u WHERE atom % 2 = 0 GROUP BY frame), h AS (SELECT atom, frame, t, u, u - m AS x FROM u JOIN m USING (frame)),
    n AS (SELECT *, lag(x, 2) OVER w AS xm2, lag(x) OVER w AS xm, lead(x) OVER w AS xp, lead(x, 2) OVER w AS xp2, lag(t, 2) OVER w AS tm2, lag(t) OVER w AS tm, lead(t) OVER w AS tp, lead(t, 2) OVER w AS tp2 FROM h WINDOW w AS (PARTITION BY atom ORDER BY frame))
    SELECT atom, frame, round(u, 6) + 0.0 AS u, round(x, 6) + 0.0 AS d, round(CASE
      WHEN tm IS NULL THEN -(2*(tp-t)+(tp2-tp))/((tp-t)*(tp2-t))*x + (tp2-t)/((tp-t)*(tp2-tp))*xp - (tp-t)/((tp2-tp)*(tp2-t))*xp2
      WHEN tp IS NULL THEN (t-tm)/((tm-tm2)*(t-tm2))*xm2 - (t-tm2)/((tm-tm2)*(t-tm))*xm + (2*(t-tm)+(tm-tm2))/((t-tm)*(t-tm2))*x
      ELSE -(tp-t)/((t-tm)*(tp-tm))*xm + ((tp-t)-(t-tm))/((t-tm)*(tp-t))*x + (t-tm)/((tp-t)*(tp-tm))*xp END, 4) + 0.0 AS v FROM n
""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other of the first 60 frames of the users that have so many."""
    rows = trajectories(spark, sf_dir)
    long = rows.groupBy("atom").agg(F.count("*").alias("n")).filter("n > 60").select("atom")
    rows = rows.join(long, "atom", "left_semi").select(F.col("atom").alias("source_id"), "frame", (F.col("t") / 3600).alias("t"), (F.col("x") / 100).alias("f"))
    out = N.normalized(rows, ["f"], (0, 60, 2), drift=F.col("atom") % 2 == 0)
    return out.select("atom", "frame", rounded(F.col("u_f")).alias("u"), rounded(F.col("d_f")).alias("d"), rounded(F.col("v_f"), 4).alias("v"))


@query(f"""
    WITH {TRAJ}, b AS (SELECT atom, frame // 8 AS block, avg(x) AS m FROM traj GROUP BY ALL HAVING count(*) = 8),
    g AS (SELECT atom, count(*) AS k, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS error, regr_slope(m, block) AS slope, regr_sxx(m, block) AS sxx, regr_syy(m, block) AS syy, regr_sxy(m, block) AS sxy FROM b GROUP BY atom HAVING count(*) >= 3),
    s AS (SELECT *, sqrt(greatest(0, syy - sxy * sxy / sxx) / (k - 2) / sxx) AS se FROM g), c AS (SELECT atom, mean, error, slope - 1.96 * se AS lo, slope + 1.96 * se AS hi, abs(mean - 50) <= 1.96 * error AS o FROM s)
    SELECT atom, round(mean, 9) AS mean, round(error, 6) AS error, round(lo, 5) + 0.0 AS slope_low, round(hi, 5) + 0.0 AS slope_high, o AS offset_ok, lo <= 0 AND hi >= 0 AS drift_ok,
           CASE WHEN o AND lo <= 0 AND hi >= 0 THEN 'qualified' WHEN o OR (lo <= 0 AND hi >= 0) THEN 'degraded' ELSE 'unqualified' END AS grade FROM c
""")
def temperature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.temperature_quality(trajectories(spark, sf_dir), "atom", "frame", "x", 50.0, 8)
    return out.select("atom", rounded(F.col("mean"), 9).alias("mean"), rounded(F.col("error")).alias("error"), rounded(F.col("slope_low"), 5).alias("slope_low"), rounded(F.col("slope_high"), 5).alias("slope_high"), "offset_ok", "drift_ok", "grade")


@query("""
    WITH s AS (SELECT vec_id, [-embedding[k]::DOUBLE / 160.21766208::DOUBLE FOR k IN [1,2,3,4,5,6,7,8,9]] AS m FROM embeddings), v AS (SELECT vec_id, m[1] AS a, m[5] AS b, m[9] AS c, (m[6] + m[8]) / 2 AS d, (m[3] + m[7]) / 2 AS e, (m[2] + m[4]) / 2 AS f FROM s)
    SELECT vec_id, round(a * 1e4, 6) + 0.0 AS xx, round(d * 1e4, 6) + 0.0 AS yz, round(1e4 * sqrt(((a-b)*(a-b) + (b-c)*(b-c) + (c-a)*(c-a)) / 2 + 3 * (d*d + e*e + f*f)), 6) AS von_mises FROM v
""")
def stress_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 9).alias("s"))
    out = T.von_mises(T.convert_stress(rows, "s", "gpa", sign=-1))
    return out.select("vec_id", *[rounded(F.col(c) * 1e4).alias(c) for c in ("xx", "yz", "von_mises")])


@query("""
    WITH r AS (SELECT user_id, event_type, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events), c AS (SELECT user_id, event_type, count(*) AS n, count(v) AS k FROM r GROUP BY ALL), m AS (SELECT user_id, max(n) AS top FROM c GROUP BY 1)
    SELECT m.user_id, arg_min(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END) FILTER (event_type IN ('purchase', 'view', 'click') AND k = n AND n = top) AS channel FROM m JOIN c USING (user_id) GROUP BY m.user_id
""")
def energy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 97 != 0, F.col("value")))
    return T.energy_channel(rows, "user_id", "event_type", "v", ["purchase", "view", "click"])


@query("""
    WITH u AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents)
    SELECT doc_id, lang, position, CASE WHEN n < 10 THEN 'development' WHEN position % 10 = 1 THEN 'monitor' WHEN position % 10 = 4 THEN 'calibration' WHEN position % 10 = 7 THEN 'locked' WHEN position % 10 IN (0, 2, 3, 5, 6, 8) THEN 'purged' ELSE 'development' END AS role FROM u
""")
def outer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.outer_roles(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"])


@query(COVERS + ", d AS (SELECT family, witness, count(DISTINCT candidate) AS d FROM covers GROUP BY ALL) SELECT family, count(*) AS witnesses, min(d) AS least, quantile_cont(d, 0.5) AS median, max(d) AS most FROM d GROUP BY family")
def family_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.family_support(_covers(spark, sf_dir)[0])


@query(COVERS + ", n AS (SELECT family, witness, count(*) AS n FROM covers WHERE candidate < 40 GROUP BY ALL) SELECT family, round(sum(w * list_sum([1.0::DOUBLE / k FOR k IN range(1, n + 1)])), 6) AS utility FROM n JOIN weights USING (family, witness) GROUP BY family")
def representative_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    chosen = covers.select("candidate").distinct().filter("candidate < 40")
    return D.representative_utility(covers, weights, chosen).select("family", rounded(F.col("utility")).alias("utility"))


@query(COVERS + ", o AS (SELECT * FROM covers WHERE candidate < 40), n AS (SELECT family, witness, count(*) AS n FROM o GROUP BY ALL) SELECT candidate, CAST(sum(CASE WHEN n = 1 THEN w ELSE 0 END) AS DOUBLE) AS lost_mass, round(sum(w / n), 6) AS lost_utility FROM o JOIN n USING (family, witness) JOIN weights USING (family, witness) GROUP BY candidate")
def removal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    chosen = covers.select("candidate").distinct().filter("candidate < 40")
    return D.removal_loss(covers, weights, chosen).withColumn("lost_utility", rounded(F.col("lost_utility")))


@query(COVERS + ", " + stepwise.plain_greedy(20))
def lazy_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    return S.lazy_greedy(covers, weights, 20)


@query(COVERS + ", ranks0 AS (SELECT row_number() OVER (ORDER BY candidate) - 1 AS rank, candidate FROM (SELECT DISTINCT candidate FROM covers WHERE candidate < 12)), " + stepwise.swaps(8, 8))
def repair_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    ranking = I.with_position(covers.select("candidate").distinct().filter("candidate < 12"), ["candidate"]).withColumnRenamed("position", "rank")
    return S.repair_swaps(covers, weights, ranking, 8)


@query(f"""
    WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), p AS (SELECT source, size, unnest(range(size)) AS pass FROM s), o AS (SELECT *, row_number() OVER (ORDER BY pass, sha256('5' || chr(0) || 'quota' || chr(0) || source), source) AS place FROM p),
    q AS (SELECT source, size, count(*) FILTER (place <= 77) AS quota FROM o GROUP BY ALL), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents),
    i AS (SELECT source, size, quota, CASE WHEN quota = size THEN 0 ELSE {HASH.format(x="'5' || chr(0) || 'target:' || source")} END AS u, unnest(range(quota)) AS i FROM q)
    SELECT r.doc_id, r.source, r.position FROM r JOIN i ON r.source = i.source AND r.position = least(i.size - 1, floor((i.i + i.u) * i.size / i.quota))
""")
def run_spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.run_spread_sample(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"], 77, 5)


@query("SELECT sha256(concat_ws(chr(31), p_brand, p_type)) AS domain, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type")
def label_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.label_domains(read(spark, sf_dir, "part"), "p_partkey", ["p_brand", "p_type"])


@query("""
    WITH a AS (SELECT p_brand, p_type, p_size, p_partkey FROM part), b AS (SELECT *, lead(p_brand) OVER w AS b2, lead(p_type) OVER w AS t2, lead(p_size) OVER w AS s2 FROM a WINDOW w AS (ORDER BY p_partkey))
    SELECT p_partkey, CASE WHEN p_type IS DISTINCT FROM t2 THEN 'incompatible' WHEN p_size IS NOT DISTINCT FROM s2 AND p_brand IS NOT DISTINCT FROM b2 THEN 'identical' ELSE 'compatible' END AS outcome FROM b
""")
def compare_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.with_position(read(spark, sf_dir, "part"), ["p_partkey"])
    a = rows.select("p_partkey", (F.col("position") + 1).alias("k"), F.struct("p_brand", "p_type", "p_size").alias("a"))
    b = rows.select(F.col("position").alias("k"), F.struct("p_brand", "p_type", "p_size").alias("b"))
    return D.compare_labels(a.join(b, "k", "left"), "a", "b", ["p_type"], ["p_size", "p_brand"]).select("p_partkey", "outcome")


@query(PAIRS + """, e AS (SELECT atom_frame AS frame, i, j FROM (SELECT frame * 10 + i % 5 AS atom_frame, i // 8 AS i, j // 8 AS j FROM p WHERE r < 0.8 AND i < j)), dg AS (SELECT frame, string_agg(k, ';' ORDER BY k) AS d FROM (SELECT DISTINCT frame, concat_ws(',', i, j) AS k FROM e) GROUP BY frame),
    f AS (SELECT d, row_number() OVER (ORDER BY min(frame)) - 1 AS state FROM dg GROUP BY d) SELECT frame, state FROM dg JOIN f USING (d)""")
def state_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = P.neighbors(p, p, CUBE, 0.8, unordered=True)
    edges = near.select((F.col("frame") * 10 + F.col("i") % 5).alias("frame"), F.expr("i div 8").alias("i"), F.expr("j div 8").alias("j"))
    return D.state_catalog(edges, "frame", ["i", "j"])


OBSERVED = f"""
    WITH {TRAJ}, s AS (SELECT atom, frame, CASE WHEN state IN ('view', 'click', 'error') THEN state END AS core FROM traj),
    n AS (SELECT *, first_value(core IGNORE NULLS) OVER (PARTITION BY atom ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, lead(core) OVER (PARTITION BY atom ORDER BY frame) AS after, lead(frame) OVER (PARTITION BY atom ORDER BY frame) AS more FROM s)
"""


@query(OBSERVED + "SELECT core AS source, nxt AS target, count(*) AS n FROM n WHERE core IS NOT NULL AND more IS NOT NULL AND after IS DISTINCT FROM core AND nxt IS NOT NULL AND nxt <> core GROUP BY ALL")
def observed_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = trajectories(spark, sf_dir).select("atom", "frame", F.when(F.col("state").isin("view", "click", "error"), F.col("state")).alias("core"))
    return I.passages(cores, "atom", "frame", "core").filter("kind = 'jump'").groupBy("source", "target").agg(F.count("*").alias("n"))


@query(OBSERVED + "SELECT CASE WHEN nxt IS NULL THEN 'right_censored_exit' WHEN nxt = core THEN 'return_excursion' ELSE 'jump' END AS kind, count(*) AS n FROM n WHERE core IS NOT NULL AND more IS NOT NULL AND after IS DISTINCT FROM core GROUP BY 1")
def transition_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cores = trajectories(spark, sf_dir).select("atom", "frame", F.when(F.col("state").isin("view", "click", "error"), F.col("state")).alias("core"))
    return I.passages(cores, "atom", "frame", "core").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""
    WITH {TRAJ}, l AS (SELECT unnest(range(6)) AS lag), p AS (SELECT lag, 0.05 * sqrt((b.x - a.x) ** 2 + ((b.t - a.t) / 36000) ** 2) AS z FROM traj a, l JOIN traj b ON b.atom = a.atom AND b.frame = a.frame + lag)
    SELECT lag, round(avg(CASE WHEN z = 0 THEN 1 ELSE list_sum([CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp(2 * (k * ln(z / 2) - lgamma(k + 1))) FOR k IN range(60)]) END), 6) AS f FROM p GROUP BY lag
""")
def scattering_planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-dimensional isotropic average, which is J0 of q times the displacement."""
    rows = trajectories(spark, sf_dir).withColumn("h", F.col("t") / 36000)
    pairs = L.lag_pairs(rows, ["x", "h"], range(6))
    r = F.sqrt(L.square(L.displacement(["x", "h"])))
    return pairs.groupBy("lag").agg(F.avg(j0(0.05 * r)).alias("f")).select("lag", F.round("f", 6).alias("f"))


@query(PAIRS + "SELECT frame, i, j, round(r, 9) AS distance FROM p WHERE r < 1 AND i < j")
def bond_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return P.neighbors(p, p, CUBE, 1.0, unordered=True).select("frame", "i", "j", F.round("r", 9).alias("distance"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), source, CAST(doc_id AS VARCHAR))) AS frame_uid FROM documents")
def frame_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from framelake.functions.columns import canonical_digest

    return read(spark, sf_dir, "documents").select("doc_id", canonical_digest(F.col("source"), F.col("doc_id")).alias("frame_uid"))


@query("""
    WITH c AS (SELECT doc_id, source, lang FROM documents), l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT sha256(text) AS fp, count(*) AS copies FROM documents GROUP BY 1)
    SELECT c.doc_id, c.source, c.lang, CASE WHEN quality IS NULL THEN 'ineligible' ELSE 'eligible' END AS state, copies > 1 AS duplicated FROM c JOIN documents o USING (doc_id) JOIN d ON d.fp = sha256(o.text) LEFT JOIN l USING (doc_id)
""")
def frame_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.sha2("text", 256).alias("fp"))
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    copies = docs.groupBy("fp").agg(F.count("*").alias("copies"))
    out = N.eligibility(docs.join(labels, "doc_id", "left"), ["quality"]).join(copies, "fp")
    return out.select("doc_id", "source", "lang", "state", (F.col("copies") > 1).alias("duplicated"))


@query("""
    WITH t AS (SELECT doc_id FROM documents WHERE doc_id % 5 > 1), l AS (SELECT doc_id, avg(abs(quality - 0.7)) AS r FROM labels GROUP BY 1) SELECT doc_id, round(r, 6) AS residual FROM l SEMI JOIN t USING (doc_id)
""")
def difficulty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of the training domain only; labels of other domains are never read into the result."""
    domain = _catalog(spark, sf_dir).filter("uid % 5 > 1").select(F.col("uid").alias("doc_id"))
    own = read(spark, sf_dir, "labels").join(domain, "doc_id", "left_semi")
    return own.groupBy("doc_id").agg(rounded(F.avg(F.abs(F.col("quality") - 0.7))).alias("residual"))


@query(PAIRS + ", e AS (SELECT frame, i, j FROM p WHERE r < 1.2 AND si % 2 = 0 AND sj % 2 = 1) SELECT a.frame, a.i AS a, b.i AS b, count(*) AS bridges FROM e a JOIN e b ON a.frame = b.frame AND a.j = b.j AND a.i < b.i GROUP BY ALL")
def framework_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return P.bridges_within(p.filter("species % 2 = 0"), p.filter("species % 2 = 1"), CUBE, 1.2)


@query(f"""
    WITH {POINTS}, o AS (SELECT frame, (atom // 24) * 4 + frame AS ring, atom, x, y, z, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, first_value(z) OVER w AS z0
      FROM pts WINDOW w AS (PARTITION BY frame, atom // 24 ORDER BY atom)),
    u AS (SELECT frame, ring, x0 + sum(coalesce(dx - round_even(dx / 10, 0) * 10, 0)) OVER w AS x, y0 + sum(coalesce(dy - round_even(dy / 10, 0) * 10, 0)) OVER w AS y, z0 + sum(coalesce(dz - round_even(dz / 10, 0) * 10, 0)) OVER w AS z
      FROM o WINDOW w AS (PARTITION BY frame, ring ORDER BY atom ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT frame, ring, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM u GROUP BY ALL),
    s AS (SELECT frame, ring, cx, cy, cz, n, sum((x-cx)**2) AS a, sum((y-cy)**2) AS b, sum((z-cz)**2) AS c, sum((x-cx)*(y-cy)) AS d, sum((x-cx)*(z-cz)) AS e, sum((y-cy)*(z-cz)) AS f FROM u JOIN c USING (frame, ring) GROUP BY ALL),
    q AS (SELECT *, (a+b+c)/3 AS q FROM s), p AS (SELECT *, sqrt(((a-q)**2 + (b-q)**2 + (c-q)**2 + 2*(d*d+e*e+f*f)) / 6) AS p FROM q),
    r AS (SELECT *, q + 2*p*cos(acos(greatest(-1, least(1, ((a-q)*((b-q)*(c-q)-f*f) - d*(d*(c-q)-f*e) + e*(d*f-(b-q)*e)) / (2*p*p*p)))) / 3 + 2*pi()/3) AS l FROM p),
    v AS (SELECT *, unnest([{{'x': d*f-e*(b-l), 'y': e*d-(a-l)*f, 'z': (a-l)*(b-l)-d*d}}, {{'x': d*(c-l)-e*f, 'y': e*e-(a-l)*(c-l), 'z': (a-l)*f-d*e}}, {{'x': (b-l)*(c-l)-f*f, 'y': f*e-d*(c-l), 'z': d*f-(b-l)*e}}]) AS v FROM r),
    k AS (SELECT frame, ring, arg_max(v, v.x**2 + v.y**2 + v.z**2) AS v, any_value(cx) AS cx, any_value(cy) AS cy, any_value(cz) AS cz, any_value(l) AS l, any_value(n) AS n FROM v GROUP BY ALL),
    g AS (SELECT *, sign(CASE WHEN abs(v.x) > 1e-12 THEN v.x WHEN abs(v.y) > 1e-12 THEN v.y ELSE v.z END) / sqrt(v.x**2 + v.y**2 + v.z**2) AS g FROM k)
    SELECT frame, ring, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(v.x * g, 4) + 0.0 AS nx, round(v.y * g, 4) + 0.0 AS ny, round(v.z * g, 4) + 0.0 AS nz, round(sqrt(greatest(l, 0) / n), 5) AS flatness FROM g
""")
def ring_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    rings = p.select((F.expr("atom div 24") * 4 + F.col("frame")).alias("ring"), "atom", F.col("atom").alias("place"))
    out = P.ring_planes(p, rings, CUBE)
    return out.select("frame", "ring", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")], *[rounded(F.col(c), 4).alias(c) for c in ("nx", "ny", "nz")], F.round("flatness", 5).alias("flatness"))


@query(f"WITH {POINTS}, q AS (SELECT frame AS run, unnest(range(12)) AS frame, atom, x + 0.07::DOUBLE * unnest(range(12)) * (1 + atom % 2) AS x, y, z FROM pts), " + stepwise.rebuilds(12, 0.5, BOX))
def rebuild_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve frames of every run, in which odd atoms move twice as fast."""
    moved = points(spark, sf_dir).withColumnRenamed("frame", "run").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))))
    out = P.rebuild_frames(moved.withColumn("x", F.col("x") + 0.07 * F.col("frame") * (1 + F.col("atom") % 2)), CUBE, 0.5)
    return out.withColumn("drift", F.round("drift", 6))
