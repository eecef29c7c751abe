"""Queries of the dataset preparation operators, on documents, labels, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.columns import canonical_digest, rounded
from framelake.operators import islands as I
from framelake.operators import prep as P
from framelake.operators import selection as S
from framelake.plans import stepwise
from framelake.plans.catalog import query
from framelake.sources.tables import BOX, POINTS, points, read

NORM = "sha256(trim(regexp_replace(lower(coalesce(text, '')), '[ \\t\\r\\n]+', ' ', 'g')))"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[ \t\r\n]+", " "))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), F.col("source").alias("run"), F.col("lang").alias("condition"), F.sha2(text, 256).alias("fp"))


@query(f"SELECT doc_id AS uid, {NORM} AS fp FROM documents")
def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).select("uid", "fp")


@query("SELECT o_orderkey, sha256(concat_ws(chr(31), coalesce(CAST(o_custkey AS VARCHAR), chr(0)), coalesce(o_orderstatus, chr(0)), coalesce(o_orderpriority, chr(0)))) AS digest FROM orders")
def label_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", canonical_digest(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority")).alias("digest"))


@query(f"""
    WITH {POINTS}, a AS (SELECT frame, atom, sha256(concat_ws(',', CAST(species AS VARCHAR), printf('%.6f', round_even(x / 10 - floor(x / 10), 6) + 0.0), printf('%.6f', round_even(y / 10 - floor(y / 10), 6) + 0.0), printf('%.6f', round_even(z / 10 - floor(z / 10), 6) + 0.0))) AS d FROM pts)
    SELECT frame, sha256(string_agg(d, '' ORDER BY atom)) AS fingerprint FROM a GROUP BY frame
""")
def geometry_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.geometry_fingerprint(points(spark, sf_dir), (BOX, BOX, BOX))


@query(f"""
    WITH c AS (SELECT doc_id AS uid, source AS run, {NORM} AS fp FROM documents), e AS (SELECT *, uid = min(uid) OVER (PARTITION BY run) AS f, uid = max(uid) OVER (PARTITION BY run) AS l FROM c)
    SELECT fp, count(*) AS n, count(DISTINCT run) AS runs, count(DISTINCT run) > 1 AS cross_source, bool_or(f) AND bool_or(l) AND count(DISTINCT run) > 1 AS restart, min(uid) AS representative FROM e GROUP BY fp HAVING count(*) >= 2
""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    ends = c.groupBy("run").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"))
    c = c.join(F.broadcast(ends), "run")
    return P.duplicate_groups(c, "fp", "run", "uid", F.col("uid") == F.col("lo"), F.col("uid") == F.col("hi"))


@query("""
    WITH f AS (SELECT doc_id, n_chars, text FROM documents), s AS (SELECT n_chars FROM f GROUP BY 1 HAVING count(*) > 1)
    SELECT n_chars, sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM f JOIN s USING (n_chars) GROUP BY ALL HAVING count(*) > 1
""")
def staged_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.staged_file_groups(read(spark, sf_dir, "documents").select("doc_id", "n_chars", "text"), "n_chars", F.sha2("text", 256), "doc_id")


@query("""
    WITH RECURSIVE e AS (SELECT min(doc_id) OVER (PARTITION BY n_chars) AS a, doc_id AS b FROM documents UNION SELECT min(doc_id) OVER (PARTITION BY sha256(text)), doc_id FROM documents),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT doc_id AS u, doc_id AS r FROM documents UNION SELECT s.a, w.r FROM w JOIN s ON s.b = w.u)
    SELECT u AS doc_id, min(r) AS component FROM w GROUP BY u
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share their length or their text, each group tied to its first."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    star = lambda key: d.join(d.groupBy(key).agg(F.min("doc_id").alias("a")), key).select("a", F.col("doc_id").alias("b"))
    return P.connected_components(d.select("doc_id"), star("n_chars").unionByName(star("digest")), "doc_id", "a", "b")


ROLES = "CASE doc_id % 6 WHEN 0 THEN 'monitor' WHEN 1 THEN 'calibration' WHEN 2 THEN 'purged' ELSE 'development' END"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("uid") % 6
    role = F.when(k == 0, "monitor").when(k == 1, "calibration").when(k == 2, "purged").otherwise("development")
    return _catalog(spark, sf_dir).select("uid", "run", role.alias("role"))


@query(f"""
    WITH c AS (SELECT doc_id AS uid, {NORM} AS fp, {ROLES} AS role FROM documents), p AS (SELECT * FROM c WHERE role <> 'purged'), w AS (SELECT doc_id // 4 AS event, doc_id AS uid FROM documents)
    SELECT 'duplicate_crosses_roles' AS code, fp AS subject, list_aggregate(list_sort(list(DISTINCT role)), 'string_agg', ',') AS roles FROM p GROUP BY fp HAVING count(DISTINCT role) > 1
    UNION ALL SELECT 'window_split', CAST(event AS VARCHAR), list_aggregate(list_sort(list(DISTINCT role)), 'string_agg', ',') FROM w JOIN p USING (uid) GROUP BY event HAVING count(DISTINCT role) > 1
""")
def leakage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    windows = c.select(F.expr("uid div 4").alias("event"), "uid")
    return P.leakage_findings(_units(spark, sf_dir).select("uid", "role"), c.select("uid", "fp"), windows, "fp")


@query(f"""
    WITH u AS (SELECT source AS run, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, {ROLES} AS role FROM documents)
    SELECT run, position FROM u WHERE role = 'development' AND EXISTS (SELECT 1 FROM u v WHERE v.run = u.run AND v.role IN ('monitor', 'calibration') AND abs(v.position - u.position) <= 1)
""")
def missing_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_purge(I.with_position(_units(spark, sf_dir), ["uid"], ["run"]), 1)


HASH = "(CAST(CAST(('0x' || substr(sha256({x}), 1, 16)) AS UBIGINT) AS DOUBLE) + 0.5) / 18446744073709551616.0::DOUBLE"


@query("SELECT doc_id, " + HASH.format(x="'7' || chr(0) || CAST(doc_id AS VARCHAR)") + " AS u FROM documents")
def hash_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", P.hash_fraction(7, F.col("doc_id").cast("string")).alias("u"))


STRATA = "strata AS (SELECT doc_id, source || '/' || coalesce(lang, '') AS stratum FROM documents)"
QUOTAS = f"""
    WITH {STRATA}, s AS (SELECT stratum, count(*) AS size FROM strata GROUP BY 1),
    p AS (SELECT stratum, size, unnest(range(size)) AS pass FROM s), o AS (SELECT *, row_number() OVER (ORDER BY pass, sha256('3' || chr(0) || 'quota' || chr(0) || stratum), stratum) AS place FROM p),
    q AS (SELECT stratum, size, count(*) FILTER (place <= 137) AS quota FROM o GROUP BY ALL)
"""


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.coalesce("lang", F.lit(""))).alias("stratum"))


def _quotas(rows: DataFrame) -> DataFrame:
    return P.balanced_quotas(rows.groupBy("stratum").agg(F.count("*").alias("size")), "stratum", "size", 137, 3)


@query(QUOTAS + "SELECT stratum, size, quota FROM q")
def balanced_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quotas(_strata(spark, sf_dir))


@query(QUOTAS + ", r AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY doc_id) - 1 AS position FROM strata), i AS (SELECT stratum, size, quota, CASE WHEN quota = size THEN 0 ELSE "
       + HASH.format(x="'3' || chr(0) || 'target:' || stratum") + " END AS u, unnest(range(quota)) AS i FROM q) SELECT r.doc_id, r.stratum FROM r JOIN i ON r.stratum = i.stratum AND r.position = least(i.size - 1, floor((i.i + i.u) * i.size / i.quota))")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _strata(spark, sf_dir)
    return P.systematic_sample(rows, "stratum", ["doc_id"], _quotas(rows), "size", 3).select("doc_id", "stratum")


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 3")
def top_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.top_of_each(read(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id", "rank")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_rows(read(spark, sf_dir, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 25)


WEIGHTS = """
    WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT doc_id, 1.0::DOUBLE / n * (CASE WHEN doc_id % 11 = 0 THEN 2.0 WHEN doc_id % 11 < 3 THEN 1.5 ELSE 1.0 END) * (CASE WHEN doc_id % 13 = 0 THEN 0.5 ELSE 1.0 END) AS w FROM documents JOIN c USING (lang)),
    m AS (SELECT doc_id, w / avg(w) OVER () AS weight FROM r)
"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    k = F.col("doc_id") % 11
    return P.configuration_weights(rows, "lang", "doc_id", k == 0, k < 3, F.col("doc_id") % 13 == 0)


@query(WEIGHTS + "SELECT doc_id, round(weight, 9) AS weight FROM m")
def configuration_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("doc_id", F.round("weight", 9).alias("weight"))


@query(WEIGHTS + ", " + stepwise.clipped(0.3, 1.6, 32))
def clipped_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.clipped_weights(_weights(spark, sf_dir), 0.3, 1.6).select("doc_id", F.round("weight", 9).alias("weight"))


@query("""
    SELECT l_suppkey, (min(struct_pack(a := l_extendedprice, b := l_orderkey, c := l_linenumber)) FILTER (l_discount < 0.03)).a AS l_extendedprice,
           (min(struct_pack(a := l_extendedprice, b := l_orderkey, c := l_linenumber)) FILTER (l_discount < 0.03)).b AS l_orderkey FROM lineitem GROUP BY l_suppkey
""")
def select_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.select_representative(read(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_discount") < 0.03, ["l_extendedprice", "l_orderkey", "l_linenumber"])
    return out.drop("l_linenumber")


@query("SELECT l_suppkey, count(*) AS folds, count(*) FILTER (l_discount <= 0.05) AS accepted, CASE WHEN count(*) = count(*) FILTER (l_discount <= 0.05) THEN 'accepted' WHEN count(*) FILTER (l_discount <= 0.05) = 0 THEN 'rejected' ELSE 'mixed' END AS verdict FROM lineitem GROUP BY l_suppkey")
def fold_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.fold_acceptance(read(spark, sf_dir, "lineitem"), "l_suppkey", "l_discount", 0.05)


@query("SELECT l_partkey, min(l_suppkey) AS incidence, max(l_linenumber) AS minimum, count(DISTINCT l_suppkey) > 1 AS conflict FROM lineitem GROUP BY l_partkey")
def merged_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merged_obligations(read(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", "l_linenumber")


COVERS = "WITH covers AS (SELECT DISTINCT l_returnflag AS family, l_partkey AS witness, l_suppkey AS candidate FROM lineitem), weights AS (SELECT family, witness, 1.0 + witness % 3 AS w FROM covers GROUP BY ALL)"


def _covers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("witness"), F.col("l_suppkey").alias("candidate")).distinct()
    return c, c.select("family", "witness").distinct().withColumn("w", (1 + F.col("witness") % 3).cast("double"))


@query(COVERS + ", h AS (SELECT DISTINCT family, witness, 1 AS hit FROM covers WHERE candidate < 15) SELECT family, CAST(sum(CASE WHEN hit = 1 THEN w ELSE 0 END) AS DOUBLE) AS mass, CAST(sum(w) AS DOUBLE) AS total, round(sum(CASE WHEN hit = 1 THEN w ELSE 0 END) / sum(w), 9) AS share FROM weights LEFT JOIN h USING (family, witness) GROUP BY family")
def covered_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    chosen = covers.select("candidate").distinct().filter("candidate < 15")
    return P.covered_mass(covers, weights, chosen).withColumn("share", F.round("share", 9))


@query(COVERS + ", f AS (SELECT family, witness, min(candidate) AS since FROM covers GROUP BY ALL), k AS (SELECT unnest([5, 20, 60]) AS size) SELECT size, family, round(sum(CASE WHEN since < size THEN w ELSE 0 END) / sum(w), 9) AS share, sum(CASE WHEN since < size THEN w ELSE 0 END) / sum(w) >= 0.9 AS qualified FROM weights LEFT JOIN f USING (family, witness), k GROUP BY ALL")
def qualify_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    ranking = covers.select("candidate").distinct().withColumn("rank", F.col("candidate"))
    return P.qualify_prefixes(covers, weights, ranking, [5, 20, 60], 0.9).withColumn("share", F.round("share", 9))


DUTIES = ", units AS (SELECT DISTINCT candidate, candidate % 10 AS unit FROM covers), duties AS (SELECT n_regionkey AS obligation, s_suppkey AS candidate, 1 + n_regionkey % 3 AS minimum FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _duties(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return of.select(F.col("n_regionkey").alias("obligation"), F.col("s_suppkey").alias("candidate"), (1 + F.col("n_regionkey") % 3).alias("minimum"))


def _greedy(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    covers, weights = _covers(spark, sf_dir)
    units = covers.select("candidate").distinct().withColumn("unit", F.col("candidate") % 10)
    return S.greedy_coverage(covers, weights, units, 30, 0.8, _duties(spark, sf_dir), **options)


@query(COVERS + DUTIES + ", " + stepwise.greedy(30, 0.8))
def greedy_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _greedy(spark, sf_dir)


@query(COVERS + DUTIES + ", " + stepwise.greedy(30, 0.8) + " WHERE rank >= 12")
def greedy_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection that stopped after 12 picks goes on from them."""
    covers, weights = _covers(spark, sf_dir)
    units = covers.select("candidate").distinct().withColumn("unit", F.col("candidate") % 10)
    begun = [r.candidate for r in S.greedy_coverage(covers, weights, units, 12, 0.8, _duties(spark, sf_dir)).orderBy("rank").collect()]
    return S.greedy_coverage(covers, weights, units, 18, 0.8, _duties(spark, sf_dir), prefix=begun)


@query(COVERS + """, chosen AS (SELECT DISTINCT candidate FROM covers WHERE candidate < 15 AND candidate <> 4 UNION SELECT DISTINCT candidate FROM covers WHERE candidate BETWEEN 20 AND 24),
    n AS (SELECT family, witness, count(*) AS n FROM covers SEMI JOIN chosen USING (candidate) GROUP BY ALL)
    SELECT family, CAST(sum(CASE WHEN n IS NULL THEN 0 ELSE w END) AS DOUBLE) AS mass, round(sum(CASE WHEN n IS NULL THEN 0 ELSE w END) / sum(w), 9) AS share, round(sum(CASE WHEN n IS NULL THEN 0 ELSE w * list_sum([1.0::DOUBLE / k FOR k IN range(1, n + 1)]) END), 6) AS utility
    FROM weights LEFT JOIN n USING (family, witness) GROUP BY family""")
def selection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after some candidates were selected and one of them was deselected."""
    covers, weights = _covers(spark, sf_dir)
    every = covers.select("candidate").distinct()
    chosen = S.deselected(S.selected(every.filter("candidate < 15"), every.filter("candidate between 20 and 24")), every.filter("candidate = 4"))
    return S.selection_state(covers, weights, chosen).select("family", "mass", F.round("share", 9).alias("share"), rounded(F.col("utility")).alias("utility"))


PICKED = ", picked AS (SELECT candidate FROM duties WHERE candidate % 9 = 1)"


@query(COVERS + DUTIES + PICKED + "SELECT obligation, max(minimum) AS minimum, count(*) AS capacity, count(p.candidate) AS selected, greatest(max(minimum) - count(p.candidate), 0) AS deficit, count(*) >= max(minimum) AS feasible FROM duties d LEFT JOIN picked p ON p.candidate = d.candidate GROUP BY obligation")
def obligation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _duties(spark, sf_dir)
    return S.obligation_report(d, d.select("candidate").filter("candidate % 9 = 1"))


@query(COVERS + DUTIES + PICKED + ", t AS (SELECT obligation, count(p.candidate) <= max(minimum) AS tight FROM duties d LEFT JOIN picked p ON p.candidate = d.candidate GROUP BY obligation) SELECT p.candidate, NOT bool_or(tight) AS safe FROM picked p JOIN duties d ON d.candidate = p.candidate JOIN t USING (obligation) GROUP BY p.candidate")
def hard_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _duties(spark, sf_dir)
    return S.hard_safe(d, d.select("candidate").filter("candidate % 9 = 1"))


@query("""
    WITH m AS (SELECT l_suppkey AS row, list(DISTINCT l_partkey ORDER BY l_partkey) AS columns FROM lineitem GROUP BY 1), w AS (SELECT p_partkey AS place, 1 + p_partkey % 7 AS row FROM part)
    SELECT place, row, CAST(unnest(range(len(columns))) AS INTEGER) AS k, unnest(columns) AS column FROM w JOIN m USING (row)
""")
def csr_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"), (1 + F.col("p_partkey") % 7).alias("row"))
    entries = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("row"), "l_partkey").join(wanted.select("row").distinct(), "row", "left_semi")
    return S.csr_gather(entries.groupBy("row").agg(F.array_sort(F.collect_set("l_partkey")).alias("columns")), wanted)


@query("SELECT candidate, count(*) AS witnesses, sha256(string_agg(CAST(witness AS VARCHAR), ',' ORDER BY witness)) AS digest FROM (SELECT DISTINCT l_suppkey AS candidate, l_partkey AS witness FROM lineitem) GROUP BY candidate")
def csr_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_partkey").alias("witness")).distinct()
    row = F.array_join(F.transform(F.array_sort(F.collect_list("witness")), lambda x: x.cast("string")), ",")
    return c.groupBy("candidate").agg(F.count("*").alias("witnesses"), F.sha2(row, 256).alias("digest"))


@query("""
    WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 'none' ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT k, CASE WHEN a.s IS NULL THEN 'new' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 's' WHEN a.p <> b.p THEN 'p' ELSE 'none' END AS rework FROM a FULL JOIN b USING (k)
""")
def required_rework(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    after = o.filter("k % 4 <> 0").withColumns({"s": F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("s")), "p": F.when(F.col("k") % 3 == 0, "none").otherwise(F.col("p"))})
    return P.required_rework(o.filter("k % 5 <> 0"), after, "k", ["s", "p"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def prediction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("(SELECT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda f: read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("id"))
    a, r = ids("A"), ids("R")
    return a.subtract(r).unionByName(r.subtract(a))


@query("""
    WITH r AS (SELECT unnest(['development', 'monitor', 'calibration', 'locked']) AS role), o AS (SELECT unnest(['train', 'select', 'calibrate', 'report']) AS operation)
    SELECT role, operation, CASE WHEN role = 'development' THEN true WHEN role = 'monitor' THEN operation IN ('select', 'report') WHEN role = 'calibration' THEN operation IN ('calibrate', 'report') ELSE operation = 'report' END AS allowed FROM r, o
""")
def blinding_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = spark.createDataFrame([(r,) for r in ("development", "monitor", "calibration", "locked")], "role string")
    operations = spark.createDataFrame([(o,) for o in ("train", "select", "calibrate", "report")], "operation string")
    op, role = F.col("operation"), F.col("role")
    allowed = F.when(role == "development", True).when(role == "monitor", op.isin("select", "report")).when(role == "calibration", op.isin("calibrate", "report")).otherwise(op == "report")
    return roles.join(F.broadcast(operations)).select("role", "operation", allowed.alias("allowed"))


@query("SELECT doc_id, round(CAST(dense_rank() OVER (ORDER BY lang, source) AS DOUBLE), 0) AS condition FROM documents")
def condition_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    named = I.with_position(d.select("lang", "source").distinct(), ["lang", "source"]).withColumn("condition", (F.col("position") + 1).cast("double"))
    return d.join(F.broadcast(named.drop("position")), ["lang", "source"]).select("doc_id", rounded(F.col("condition"), 0).alias("condition"))
