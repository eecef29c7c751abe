"""Queries of the sources and sinks: the stored tables are written as files of a format and read back through its reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.durable import shared_folder
from framelake.functions import registration as R
from framelake.functions.columns import rounded
from framelake.sources import sinks as W
from framelake.sources import trajectories as T
from framelake.plans.catalog import query
from framelake.sources.tables import POINTS, TRAJ, points, read, trajectories
from framelake.streaming import windows as S

AXES = ("x", "y", "z")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/framelake-{name}-{uuid.uuid4().hex}"


def _lines(items: Column, head: Column | None = None) -> Column:
    """An array of lines as a text, after a head."""
    text = F.array_join(items, "\n")
    return text if head is None else F.concat(head, F.lit("\n"), text)


def _number(c: Column, places: int = 12) -> Column:
    return F.format_string(f"%.{places}f", c)


def _frames(spark: SparkSession, sf_dir: str, scale: float = 1.0) -> DataFrame:
    """frame, atoms: an array of (atom, species, x, y, z), in order; coordinates over the scale."""
    p = points(spark, sf_dir)
    return p.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("atom", "species", *[(F.col(a) / scale).alias(a) for a in AXES]))).alias("atoms"))


def _rows(of: str, words) -> Column:
    return F.transform(of, lambda a: F.concat_ws(" ", *words(a)))


def _written(spark: SparkSession, texts: DataFrame, name: str) -> str:
    """A file for each row (frame, value), in a folder named by it."""
    path = _folder(spark, name)
    texts.select("frame", "value").repartition("frame").write.partitionBy("frame").text(path)
    return path


def _frame_of() -> Column:
    return F.regexp_extract("file", r"frame=(\d+)", 1).cast("bigint")


@query(f"WITH {POINTS} SELECT frame, frame * 10 AS step, atom AS id, CAST(species AS INTEGER) AS type, round(x / 10, 7) AS fx, round(y / 10, 7) AS fy, round(z / 10, 7) AS fz, row_number() OVER (PARTITION BY frame ORDER BY atom) - 1 AS atom FROM pts")
def lammps_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames in one stream of dumps, atoms in falling order of their ids."""
    head = F.format_string("ITEM: TIMESTEP\n%d\nITEM: NUMBER OF ATOMS\n%d\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type xu yu zu", F.col("frame") * 10, F.size("atoms"))
    text = _lines(_rows("atoms", lambda a: [a["atom"].cast("string"), a["species"].cast("string"), *[_number(a[x]) for x in AXES]]), head)
    path = _folder(spark, "dump")
    turned = _frames(spark, sf_dir).withColumn("atoms", F.reverse("atoms"))
    turned.select("frame", text.alias("value")).coalesce(1).sortWithinPartitions("frame").select("value").write.text(path)
    out = T.dump_atoms(T.read_dump(spark, path))
    return out.select("frame", "step", "id", "type", "atom", *[F.round(f"f{a}", 7).alias(f"f{a}") for a in AXES])


@query(f"WITH {TRAJ} SELECT atom AS user, frame AS step, round(x, 6) AS temp FROM traj")
def lammps_thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with a table of each user, other lines between them."""
    rows = trajectories(spark, sf_dir).groupBy("atom").agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("r"))
    body = F.transform("r", lambda a: F.concat_ws(" ", a["frame"].cast("string"), F.col("atom").cast("string"), _number(a["x"])))
    path = _folder(spark, "log")
    rows.select(F.concat(F.lit("units metal\nrun 100\n   Step User Temp\n"), F.array_join(body, "\n"), F.lit("\nLoop time of 1.5 on 4 procs\n12 neighbors")).alias("value")).write.text(path)
    out = T.read_thermo(spark, path)
    return out.select(F.col("thermo")["User"].cast("bigint").alias("user"), "step", F.round(F.col("thermo")["Temp"], 6).alias("temp"))


SHIFTED = f"WITH {POINTS}, s AS (SELECT frame AS run, unnest(range(3)) AS frame, row_number() OVER (PARTITION BY frame ORDER BY atom) - 1 AS atom, 'E' || chr(CAST(97 + species AS INTEGER)) AS element, (x / 10 + 0.1 * unnest(range(3))) AS fx, y / 10 AS fy, z / 10 AS fz FROM pts)"


def _element(species: Column) -> Column:
    return F.concat(F.lit("E"), F.chr(97 + species))


def _shifted(atoms: str, k: int) -> Column:
    """The lines of the fractions, x moved by k tenths."""
    return _rows(atoms, lambda a: [_number(a["x"] + 0.1 * k), _number(a["y"]), _number(a["z"])])


@query(SHIFTED + " SELECT run, frame, atom, element, round(fx, 7) AS fx, round(fy, 7) AS fy, round(fz, 7) AS fz FROM s")
def xdatcar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of three configurations for each frame of the points."""
    f = _frames(spark, sf_dir, 10.0)
    head = F.concat(F.lit("points\n 1.0\n 10 0 0\n 0 10 0\n 0 0 10\n"), F.array_join(F.transform("atoms", lambda a: _element(a["species"])), " "), F.lit("\n"), F.array_join(F.transform("atoms", lambda a: F.lit("1")), " "))
    parts = [_lines(_shifted("atoms", k), F.lit(f"Direct configuration= {k + 1:5d}")) for k in range(3)]
    path = _written(spark, f.withColumn("value", F.concat_ws("\n", head, *parts)), "xdatcar")
    out = T.read_xdatcar(spark, path)
    return out.select(_frame_of().alias("run"), "frame", "atom", "element", *[F.round(f"f{a}", 7).alias(f"f{a}") for a in AXES])


def _vasprun(calculations: int = 3) -> Column:
    row = lambda tag, words: F.concat(F.lit(f"<{tag}>"), words, F.lit(f"</{tag}>"))
    atoms = F.array_join(F.transform("atoms", lambda a: F.concat(F.lit("<rc><c>"), _element(a["species"]), F.lit(" </c><c> "), (a["species"] + 1).cast("string"), F.lit("</c></rc>"))), "\n")
    kinds = "".join(f"<rc><c>1</c><c>E{chr(97 + k)}</c><c>{10 + k}.5</c><c>1.0</c><c>x</c></rc>" for k in range(20))
    out = [F.lit('<?xml version="1.0"?>\n<modeling>\n<incar><i name="POTIM">      2.00000000</i></incar>\n<atominfo><array name="atoms"><set>\n'), atoms, F.lit(f'</set></array><array name="atomtypes"><set>{kinds}</set></array></atominfo>\n')]
    for k in range(calculations):
        at = F.array_join(F.transform(_shifted("atoms", k), lambda s: row("v", s)), "\n")
        force = F.array_join(F.transform("atoms", lambda a: row("v", F.concat_ws(" ", _number(a["z"]), F.lit(str(k)), F.lit("0")))), "\n")  # noqa: B023
        out += [
            F.lit('<calculation>\n<structure><crystal><varray name="basis"><v>10 0 0</v><v>0 10 0</v><v>0 0 10</v></varray></crystal>\n<varray name="positions">'), at,
            F.lit('</varray></structure>\n<varray name="forces">'), force, F.lit(f'</varray>\n<energy><i name="e_fr_energy">-{k}.25</i><i name="kinetic">0.5</i></energy>\n</calculation>\n'),
        ]
    return F.concat(*out, F.lit("</modeling>"))


@query(SHIFTED + """, n AS (SELECT *, row_number() OVER () AS one FROM s) SELECT run, frame, round(0.002::DOUBLE * frame, 6) AS t, atom, element, CAST(ascii(substr(element, 2)) - 97 + 10.5 AS DOUBLE) AS mass,
    round(fx, 7) AS fx, 50.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, round(fz, 7) AS force_x, CAST(frame AS DOUBLE) AS force_y FROM n""")
def vasprun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms, masses, times, forces, and velocities by differences, of three calculations a file."""
    path = _written(spark, _frames(spark, sf_dir, 10.0).withColumn("value", _vasprun()), "vasprun")
    out = T.vasprun_atoms(spark, path)
    return out.select(_frame_of().alias("run"), "frame", F.round("t", 6).alias("t"), "atom", "element", "mass", F.round("fx", 7).alias("fx"), rounded(F.col("vx"), 4).alias("vx"), rounded(F.col("vy"), 4).alias("vy"), F.round("force_x", 7).alias("force_x"), "force_y")


@query(f"WITH {POINTS} SELECT DISTINCT frame AS run, k AS frame, name, CASE WHEN name = 'kinetic' THEN 0.5 ELSE -k - 0.25 END::DOUBLE AS energy FROM pts, range(3) t(k), (SELECT unnest(['e_fr_energy', 'kinetic']) AS name)")
def run_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, _frames(spark, sf_dir, 10.0).withColumn("value", _vasprun()), "vasprun")
    return T.frame_energies(T.read_vasprun(spark, path)).select(_frame_of().alias("run"), "frame", "name", "energy")


@query(f"WITH {POINTS} SELECT DISTINCT frame AS run, CASE frame WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 3 END::BIGINT AS frames, CASE frame WHEN 3 THEN 1 ELSE 0 END::BIGINT AS malformed, CASE frame WHEN 1 THEN 'in_record' WHEN 2 THEN 'in_file' ELSE 'none' END AS interruption FROM pts")
def recovered_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four files one is whole, one ends in its last calculation, one behind it, and one has a broken calculation in its middle."""
    whole = _vasprun()
    cut = F.substring_index(whole, "</calculation>", 2)
    text = (
        F.when(F.col("frame") == 1, F.concat(cut, F.lit("</calculation>\n<calculation>\n<structure><crystal><varr"))).when(F.col("frame") == 2, F.concat(F.substring_index(whole, "</calculation>", 3), F.lit("</calculation>\n")))
        .when(F.col("frame") == 3, F.replace(whole, F.lit('<i name="e_fr_energy">-1.25</i>'), F.lit('<i name="e_fr_energy">-1.25</j>'))).otherwise(whole)
    )
    path = _written(spark, _frames(spark, sf_dir, 10.0).withColumn("value", text), "vasprun")
    return T.vasprun_states(spark, path).select(_frame_of().alias("run"), "frames", "malformed", "interruption")


@query(SHIFTED + " SELECT run, frame, round(frame * 0.004::DOUBLE, 6) AS t, atom, element, round(fx, 7) AS fx, round(fy, 7) AS fy, round(fy, 7) AS vx, CAST(frame AS DOUBLE) AS vy FROM s")
def contcar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concatenated records with velocities, and a cut one at each file's end."""
    f = _frames(spark, sf_dir, 10.0)
    names, ones = F.array_join(F.transform("atoms", lambda a: _element(a["species"])), " "), F.array_join(F.transform("atoms", lambda a: F.lit("1")), " ")
    record = lambda k: F.concat_ws(
        "\n", F.lit("points\n   1.00000000000000\n    10.0 0.0 0.0\n    0.0 10.0 0.0\n    0.0 0.0 10.0"), names, ones, F.lit("Direct"), F.array_join(_shifted("atoms", k), "\n"), F.lit(""),
        F.array_join(_rows("atoms", lambda a: [_number(a["y"]), F.lit(f"{k}.0"), F.lit("0.0")]), "\n"), F.lit(""),
    )
    cut = F.concat_ws("\n", F.lit("points\n   1.0\n    10.0 0.0 0.0\n    0.0 10.0 0.0\n    0.0 0.0 10.0"), names, ones, F.lit("Direct\n 0.5 0.5"))
    path = _written(spark, f.withColumn("value", F.concat_ws("\n", *[record(k) for k in range(3)], cut)), "contcar")
    out = T.contcar_atoms(T.read_contcar_stream(spark, path), 4.0)
    return out.select(_frame_of().alias("run"), "frame", F.round("t", 6).alias("t"), "atom", "element", F.round("fx", 7).alias("fx"), F.round("fy", 7).alias("fy"), F.round("vx", 7).alias("vx"), "vy")


@query(SHIFTED + " SELECT run, atom, element, round(fx, 7) AS fx, round(fy, 7) AS fy, round(fz, 7) AS fz FROM s WHERE frame = 0")
def structure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single structures, a file each, with Cartesian coordinates."""
    f = _frames(spark, sf_dir)
    names, ones = F.array_join(F.transform("atoms", lambda a: _element(a["species"])), " "), F.array_join(F.transform("atoms", lambda a: F.lit("1")), " ")
    text = F.concat_ws("\n", F.lit("points\n1.0\n10 0 0\n0 10 0\n0 0 10"), names, ones, F.lit("Cartesian"), F.array_join(_rows("atoms", lambda a: [_number(a[x]) for x in AXES]), "\n"))
    out = T.read_poscar(spark, _written(spark, f.withColumn("value", text), "poscar") + "/*/*.txt")
    at = out.select("file", "species", F.posexplode("fractions").alias("k", "f"))
    return at.select(_frame_of().alias("run"), F.col("k").cast("bigint").alias("atom"), F.element_at("species", F.col("k") + 1).alias("element"), *[F.round(F.element_at("f", k), 7).alias(f"f{a}") for k, a in zip((1, 2, 3), AXES)])


def _xyz(spark: SparkSession, sf_dir: str) -> str:
    f = _frames(spark, sf_dir)
    cell = F.array(*[F.lit(10.0 if k % 4 == 0 else 0.0) for k in range(9)])
    frames = f.select(
        "frame", cell.alias("lattice"), F.transform("atoms", lambda a: _element(a["species"])).alias("species"), F.transform("atoms", lambda a: F.array(*[a[x] for x in AXES])).alias("positions"),
        F.transform("atoms", lambda a: F.array(a["z"], a["x"], F.lit(0.5))).alias("forces"),
    )
    path = _folder(spark, "xyz")
    W.write_extxyz(frames, path, places=12)
    return path


def _xyz_atoms(frames: DataFrame) -> DataFrame:
    at = frames.select(F.col("info")["frame"].cast("bigint").alias("frame"), "species", "forces", F.posexplode("positions").alias("k", "p"))
    return at.select("frame", F.col("k").cast("bigint").alias("atom"), F.element_at("species", F.col("k") + 1).alias("element"), F.round(F.element_at("p", 1), 6).alias("x"), F.round(F.element_at(F.element_at("forces", F.col("k") + 1), 1), 6).alias("force_x"))


XYZ = f"WITH {POINTS} SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY atom) - 1 AS atom, 'E' || chr(CAST(97 + species AS INTEGER)) AS element, round(x, 6) AS x, round(z, 6) AS force_x FROM pts"


@query(XYZ)
def extxyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _xyz_atoms(T.read_extxyz(spark, _xyz(spark, sf_dir)))


@query(XYZ + " WHERE frame IN (1, 3)")
def extxyz_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the frames, by their offsets in a written index, whose digests the bytes must have."""
    path = _xyz(spark, sf_dir)
    index = W.write_xyz_index(spark, path)
    named = T.read_extxyz(spark, path).select("file", "frame", F.col("info")["frame"].cast("bigint").alias("own")).filter("own in (1, 3)")
    return _xyz_atoms(T.fetch_frames(index, named.select("file", "frame")))


@query(f"WITH {POINTS}, n AS (SELECT frame, count(*) AS n FROM pts GROUP BY 1) SELECT frame, CAST(n AS INTEGER) AS n_atoms, 64 AS digest_length, true AS contiguous FROM n")
def extxyz_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _xyz(spark, sf_dir)
    own = T.read_extxyz(spark, path).select("file", "frame", F.col("info")["frame"].cast("bigint").alias("own"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = T.xyz_index(spark, path).withColumn("contiguous", F.col("offset") == before).join(own, ["file", "frame"])
    return out.select(F.col("own").alias("frame"), "n_atoms", F.length("sha256").alias("digest_length"), "contiguous")


def _controls(spark: SparkSession, sf_dir: str) -> str:
    k = F.col("s_suppkey")
    tag = lambda name, value: F.concat(F.lit(f"{name} = "), value.cast("string"))
    text = F.concat_ws(
        "\n", F.concat(F.when(k % 5 != 4, F.concat(tag("IBRION", F.when(k % 7 == 6, 2).otherwise(0)), F.lit(" ; "))).otherwise(F.lit("")), tag("NSW", k % 3 * 100), F.lit(" ! steps")), tag("mdalgo", k % 6), tag("ISIF", F.when(k % 4 == 3, 3).otherwise(2)),
        tag("SMASS", F.element_at(F.array(F.lit(-3), F.lit(0), F.lit(-1), F.lit(-2)), (F.expr("s_suppkey div 6 % 4") + 1).cast("int"))), F.when(k % 2 == 0, F.lit("ML_LMLFF = .TRUE. # learned")), F.when(k % 8 == 0, F.lit("ML_MODE = run")), F.lit("LANGEVIN_GAMMA = 10.0 10.0"),
    )
    return _written(spark, read(spark, sf_dir, "supplier").select(k.alias("frame"), text.alias("value")), "controls")


CONTROLS = """
    WITH t AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 <> 4 THEN CASE WHEN s_suppkey % 7 = 6 THEN 2 ELSE 0 END END AS ibrion, s_suppkey % 3 * 100 AS nsw, s_suppkey % 6 AS algo, CASE WHEN s_suppkey % 4 = 3 THEN 3 ELSE 2 END AS isif, [-3, 0, -1, -2][s_suppkey // 6 % 4 + 1] AS smass FROM supplier),
    d AS (SELECT *, CASE WHEN ibrion IS NULL THEN 'unresolved' WHEN ibrion = 0 AND nsw > 0 THEN 'molecular_dynamics' ELSE 'static' END AS dynamics,
      CASE WHEN algo IN (0, 2) AND smass = -3 THEN 'none' WHEN algo IN (0, 2) AND smass >= 0 THEN 'nose_hoover' WHEN algo = 0 AND smass = -1 THEN 'rescaling' WHEN algo = 0 AND smass = -2 THEN 'none' WHEN algo = 1 THEN 'andersen' WHEN algo = 3 THEN 'langevin' WHEN algo = 4 THEN 'nose_hoover_chain' WHEN algo = 5 THEN 'canonical_rescaling' END AS th,
      CASE WHEN algo = 3 AND isif = 3 THEN 'parrinello_rahman' WHEN isif = 3 THEN NULL ELSE 'none' END AS ba FROM t),
    e AS (SELECT *, CASE WHEN algo = 0 AND smass = -2 THEN 'constant_velocity' WHEN th IS NULL OR ba IS NULL OR th = 'rescaling' THEN 'unresolved' WHEN ba <> 'none' THEN 'npt' WHEN th = 'none' THEN 'nve' ELSE 'nvt' END AS en FROM d)
    SELECT k AS run, dynamics, CASE dynamics WHEN 'molecular_dynamics' THEN en ELSE dynamics END AS ensemble, CASE dynamics WHEN 'molecular_dynamics' THEN coalesce(th, 'unresolved') ELSE dynamics END AS thermostat, CASE dynamics WHEN 'molecular_dynamics' THEN coalesce(ba, 'unresolved') ELSE dynamics END AS barostat,
      'unresolved' AS bias, CASE WHEN k % 8 = 0 THEN 'model' WHEN k % 2 = 0 THEN 'mixed' ELSE 'first_principles' END AS forces FROM e
"""


@query(CONTROLS)
def certified_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.certify_controls(T.read_controls(spark, _controls(spark, sf_dir)))
    return out.withColumn("run", _frame_of()).drop("file")


@query("SELECT s_suppkey AS run, CASE WHEN s_suppkey % 5 <> 4 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 0 END + 5::BIGINT AS tags, CAST(s_suppkey % 6 AS VARCHAR) AS mdalgo FROM supplier")
def run_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = T.read_controls(spark, _controls(spark, sf_dir))
    return tags.groupBy(_frame_of().alias("run")).agg(F.count("*").alias("tags"), F.max(F.when(F.col("tag") == "MDALGO", F.col("value"))).alias("mdalgo"))


@query("SELECT s_suppkey AS run, 1::BIGINT AS files FROM supplier")
def discovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.manifest(spark, _controls(spark, sf_dir), "*.txt").filter("length > 0").withColumnRenamed("path", "file")
    return found.groupBy(_frame_of().alias("run")).agg(F.count("*").alias("files"))


@query("""
    WITH a AS (SELECT s_suppkey AS run FROM supplier WHERE s_suppkey % 10 <> 1), b AS (SELECT s_suppkey AS run FROM supplier WHERE s_suppkey % 10 <> 2)
    SELECT run, CASE WHEN a.run IS NULL THEN 'added' WHEN b.run IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (run) WHERE a.run IS NULL OR b.run IS NULL OR run % 10 = 3
""")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the lines of files, against those recorded: some are new, some gone, some altered."""
    live = T.source_digests(spark, _controls(spark, sf_dir)).withColumn("path", _frame_of().cast("string"))
    told = live.filter("path % 10 <> 1").withColumn("digest", F.when(F.col("path") % 10 == 3, F.lit("other")).otherwise(F.col("digest")))
    return T.changed_files(told, live.filter("path % 10 <> 2")).select(F.col("path").cast("bigint").alias("run"), "change")


@query(f"WITH {POINTS} SELECT frame AS run_id, atom, species, x FROM pts WHERE frame IN (0, 2)")
def frame_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the cached runs, whose rows must have the manifest's digests."""
    path = _folder(spark, "cache")
    W.write_cache(points(spark, sf_dir).withColumnRenamed("frame", "run_id"), path)
    return W.read_cache(spark, path, runs=["0", "2"]).select(F.col("run_id").cast("bigint").alias("run_id"), "atom", "species", "x")


@query("SELECT kind, n_nationkey AS key, n_name AS name FROM nation, (SELECT unnest(['csv', 'json']) AS kind)")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    out = None
    for kind in ("csv", "json"):
        path = _folder(spark, kind)
        W.write_table(rows, path, ["key"], kind)
        back = spark.read.schema("key int, name string").format(kind).option("header", True).load(path).select(F.lit(kind).alias("kind"), "key", "name")
        out = back if out is None else out.unionByName(back)
    return out


@query(f"WITH {TRAJ}, n AS (SELECT atom, count(*) AS n FROM traj GROUP BY atom) SELECT atom, unnest(range(least(n, 4))) AS lag FROM n")
def registered_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function of lags, by name in SQL."""
    R.register(spark)
    sizes = trajectories(spark, sf_dir).groupBy("atom").agg(F.count("*").cast("int").alias("n"))
    return spark.sql("SELECT atom, g.lag FROM {sizes} s, LATERAL lag_grid(s.n, 3) g", sizes=sizes)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream."""
    path, rows = _folder(spark, "events"), read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _finished(stream: DataFrame) -> DataFrame:
    """What a stream over all there is has put out."""
    spark, path = stream.sparkSession, _folder(stream.sparkSession, "stream")
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(f"""
    WITH {TRAJ}, r AS (SELECT atom, frame, t, state, frame - row_number() OVER (PARTITION BY atom, state ORDER BY frame) AS run FROM traj), g AS (SELECT atom, state, run, min(frame) AS lo, max(frame) AS hi, min(t) AS first, max(t) AS last, count(*) AS n FROM r GROUP BY ALL),
    e AS (SELECT atom, max(frame) AS top FROM traj GROUP BY 1) SELECT atom AS key, state, CAST(round(first) AS BIGINT) AS first, CAST(round(last) AS BIGINT) AS last, n FROM g JOIN e USING (atom) WHERE hi < top
""")
def stream_residence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intervals that a stream of all events has closed."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("user"), "ts", F.col("event_type").alias("state"))
    out = _finished(S.residence(rows, "user", "ts", "state", "1 hour", 10**13)).filter("not right_censored")
    return out.select("key", "state", *[F.round(F.unix_micros(c) / 1e6).cast("bigint").alias(c) for c in ("first", "last")], "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", "event_type", "ts")
    return _finished(S.distinct_records(rows, "ts", ["user_id", "event_type"], "4000 days").select("user_id", "event_type"))
