"""Readers of trajectory text formats as long tables, through Spark's own readers, so that any store works.

Formats whose frames begin with a fixed text are read with that text as the record separator, others by
numbered lines (sources.lines): files stay splittable, a record is a frame, and parsing is column
expressions. What ends in the middle of a record was interrupted: that record is left out, all before it
count. A record that is broken in the middle of a file raises.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.sources.lines import gathered, line_before, numbered_lines, records


class FormatError(ValueError):
    """A file isn't what its format says."""


def _fail(test: Column, message: str) -> Column:
    return F.when(test, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def _whole(cut: Column, broken: Column, message: str) -> Column:
    """False for what was cut at the end, an error for what is broken; one expression, so that the order of the tests holds."""
    return F.when(cut, F.lit(False)).when(broken, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def _words(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def _number(c: Column) -> Column:
    return c.try_cast("double")


def ordered_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, split, at (the order in the file), value and last (whether it is the file's last) of records that a text separates."""
    raw = spark.read.option("lineSep", separator).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    ends = raw.groupBy("file").agg(F.max(F.struct("split", "at")).alias("__end"))
    return raw.join(ends, "file").withColumn("last", F.struct("split", "at") == F.col("__end")).drop("__end")


# --- LAMMPS custom dumps -----------------------------------------------------------------------------


def read_dump(spark: SparkSession, path: str, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """file, frame, step, lx, ly, lz, ox, oy, oz, n_atoms, atoms: one row a frame of orthogonal or skewed boxes.

    atoms is an array of maps from the ATOMS columns to text, in the file's order; lx.. are the box's
    lengths, xy, xz, yz its tilts. frame counts each file's steps from 0, after which start, stop and stride
    choose. Compressed files are read as they are by Spark (gz, bz2), one task each.
    """
    raw = ordered_records(spark, path, "ITEM: TIMESTEP\n").filter(F.trim("value") != "")
    parts = F.split("value", "ITEM: ")
    block = lambda name: F.try_element_at(F.filter(parts, lambda p: p.startswith(name)), F.lit(1))
    rows = raw.select(
        "file", "last", _number(F.trim(parts[0])).cast("bigint").alias("step"), block("NUMBER OF ATOMS").alias("n"), block("BOX BOUNDS").alias("box"), block("ATOMS").alias("atoms"), block("TIME").alias("time")
    )
    lacking = F.col("step").isNull() | F.col("n").isNull() | F.col("box").isNull() | F.col("atoms").isNull()
    rows = rows.filter(_whole(F.col("last") & lacking, lacking, "a dump frame lacks a part"))
    box, lines = F.split("box", "\n"), F.split(F.rtrim("atoms"), "\n")
    bound = lambda k, i: _number(F.try_element_at(_words(box[k]), F.lit(i + 1)))
    tilt = lambda k: F.coalesce(bound(k, 2), F.lit(0.0))
    names = F.slice(_words(lines[0]), 2, 1000)
    body = F.filter(F.slice(lines, 2, 1 << 30), lambda s: F.trim(s) != "")
    # within a lambda the names would be split off the frame's text once an atom: let() works them out once
    let = lambda value, use: F.transform(F.array(value), use)[0]
    maps = let(names, lambda ns: F.transform(body, lambda s: let(_words(s), lambda w: F.map_from_arrays(F.slice(ns, 1, F.size(w)), F.slice(w, 1, F.size(ns))))))
    out = rows.select(
        "file", "last", "step", _number(F.trim(F.split("time", "\n")[1])).alias("time"), _number(F.trim(F.split("n", "\n")[1])).cast("int").alias("n_atoms"),
        *[(bound(k, 1) - bound(k, 0)).alias(f"b{a}") for k, a in zip((1, 2, 3), "xyz")], *[bound(k, 0).alias(f"o{a}") for k, a in zip((1, 2, 3), "xyz")],
        tilt(1).alias("xy"), tilt(2).alias("xz"), tilt(3).alias("yz"), maps.alias("atoms"), F.size(names).alias("width"),
    )
    least = F.array_min(F.transform("atoms", lambda a: F.size(a)))
    short = F.col("last") & (F.size("atoms") <= F.col("n_atoms")) & (F.coalesce(least < F.col("width"), F.lit(False)) | (F.size("atoms") < F.col("n_atoms")))
    out = out.filter(_whole(short, F.size("atoms") != F.col("n_atoms"), "a dump frame has another number of atoms")).drop("last", "width")
    # bounds of skewed boxes hold the tilts' extents
    spread = F.greatest(F.lit(0.0), F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")) - F.least(F.lit(0.0), F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz"))
    out = out.withColumns({"lx": F.col("bx") - spread, "ly": F.col("by") - F.abs("yz"), "lz": F.col("bz")}).drop("bx", "by", "bz")
    # only file and step are ranked: the frames' rows aren't moved for it
    order = out.select("file", "step").distinct().withColumn("frame", (F.row_number().over(Window.partitionBy("file").orderBy("step")) - 1).cast("bigint"))
    chosen = (F.col("frame") >= start) & ((F.col("frame") - start) % stride == 0)
    order = order.filter(chosen & (F.col("frame") < stop) if stop is not None else chosen)
    return out.join(order, ["file", "step"])


def dump_atoms(frames: DataFrame) -> DataFrame:
    """file, frame, step, atom (from 0, by id), id, type, fx, fy, fz and what else there is of vx.., fx_force..: sorted by id.

    Scaled (xs, xsu) coordinates are fractions as they stand, others (x, xu) are divided by the box.
    """
    at = frames.select("file", "frame", "step", "lx", "ly", "lz", "ox", "oy", "oz", F.explode("atoms").alias("a"))
    get = lambda name: F.try_element_at("a", F.lit(name)).cast("double")
    coords = {f"f{x}": F.coalesce(get(f"{x}su"), get(f"{x}s"), (F.coalesce(get(f"{x}u"), get(x)) - F.col(f"o{x}")) / F.col(f"l{x}")) for x in "xyz"}
    more = {f"v{x}": get(f"v{x}") for x in "xyz"} | {f"force_{x}": get(f"f{x}") for x in "xyz"}
    out = at.select("file", "frame", "step", F.try_element_at("a", F.lit("id")).cast("bigint").alias("id"), F.try_element_at("a", F.lit("type")).cast("int").alias("type"), *[c.alias(n) for n, c in (coords | more).items()])
    return out.withColumn("atom", (F.row_number().over(Window.partitionBy("file", "frame").orderBy("id")) - 1).cast("bigint"))


def read_thermo(spark: SparkSession, path: str) -> DataFrame:
    """file, step and the thermo columns (a map to double) of a log: the rows of numbers between a Step header and what isn't one."""
    lines = records(numbered_lines(spark, path), F.col("value").rlike(r"^\s*(Step\s|Loop time)"))
    words = _words(F.col("value"))
    heads = lines.filter(F.col("value").rlike(r"^\s*Step\s")).select("file", "record", words.alias("names"))
    rows = lines.filter(F.col("value").rlike(r"^\s*-?\d+(\s+\S+)*\s*$")).select("file", "record", "no", F.transform(words, lambda x: x.try_cast("double")).alias("values"))
    rows = rows.join(heads, ["file", "record"]).filter((F.size("values") == F.size("names")) & ~F.exists("values", lambda v: v.isNull()))
    return rows.select("file", F.col("values")[0].cast("bigint").alias("step"), F.map_from_arrays("names", "values").alias("thermo"))


# --- VASP --------------------------------------------------------------------------------------------


def read_xdatcar(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, atom, element, fx, fy, fz, cell (9 doubles): frames of one cell per file, counted by their own numbers."""
    raw = ordered_records(spark, path, "Direct configuration=")
    lines = F.filter(F.split("value", "\n"), lambda s: F.trim(s) != "")
    raw = raw.select("file", "last", lines.alias("l"))
    head = raw.filter(F.size("l") >= 7).filter(F.try_element_at("l", F.lit(7)).rlike(r"^[\s\d]+$") & F.try_element_at("l", F.lit(6)).rlike("[A-Za-z]"))
    scale = _number(F.trim(F.col("l")[1]))
    cell = F.flatten(F.transform(F.slice("l", 3, 3), lambda s: F.transform(_words(s), lambda x: x.cast("double") * scale)))
    elements = F.flatten(F.zip_with(_words(F.col("l")[5]), _words(F.col("l")[6]), lambda e, n: F.array_repeat(e, n.cast("int"))))
    # one header a file
    head = head.groupBy("file").agg(F.first(F.struct(cell.alias("cell"), elements.alias("elements"))).alias("h"))
    frames = raw.filter(F.col("l")[0].rlike(r"^\s*\d+\s*$")).select("file", "last", (F.trim(F.col("l")[0]).cast("bigint") - 1).alias("frame"), F.slice("l", 2, 1 << 30).alias("l"))
    # an interrupted file's last frame may lack lines, or the rest of one
    cut = F.col("last") & ((F.size("l") < F.size("h.elements")) | F.exists(F.slice("l", F.lit(1), F.size("h.elements")), lambda s: F.size(_words(s)) < 3))
    frames = frames.join(head, "file").filter(_whole(cut, F.size("l") < F.size("h.elements"), "an XDATCAR frame is cut short"))
    at = frames.select("file", "frame", "h.cell", "h.elements", F.posexplode(F.slice("l", F.lit(1), F.size("h.elements"))).alias("atom", "line"))
    f = _words(F.col("line"))
    return at.select("file", "frame", F.col("atom").cast("bigint").alias("atom"), F.element_at("elements", F.col("atom") + 1).alias("element"), *[_number(f[k]).alias(f"f{a}") for k, a in enumerate("xyz")], "cell")


_VARRAY = "array<struct<_name:string,v:array<string>>>"
_ITEM = "array<struct<_name:string,_VALUE:double>>"
CALCULATION = f"structure struct<crystal:struct<varray:{_VARRAY}>,varray:{_VARRAY}>, varray {_VARRAY}, energy struct<i:{_ITEM}>, bad string"


def vasprun_records(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, state, calculation (parsed), last: a row each calculation element, in the file's order, and one for the head with frame -1.

    state: complete, malformed (closed, but no XML), or truncated (not closed, and the file ends with it); an
    unclosed one before others is malformed. The head's calculation is null, and its text is in head.
    """
    raw = ordered_records(spark, path, "<calculation>")
    closed = F.col("value").contains("</calculation>")
    body = F.concat(F.lit("<calculation>"), F.substring_index("value", "</calculation>", 1), F.lit("</calculation>"))
    parsed = F.from_xml(F.when(closed, body), CALCULATION, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    first = raw.groupBy("file").agg(F.min(F.struct("split", "at")).alias("__first"))
    rows = raw.join(first, "file").withColumn("head", F.when(F.struct("split", "at") == F.col("__first"), F.col("value")))
    rows = rows.withColumns({"calculation": parsed, "closed": closed})
    state = F.when(F.col("head").isNotNull(), "head").when(F.col("closed") & F.col("calculation.bad").isNull(), "complete").when(~F.col("closed") & F.col("last"), "truncated").otherwise("malformed")
    rows = rows.withColumn("state", state)
    # only places are ranked: the calculations aren't moved for it
    places = rows.select("file", "split", "at").withColumn("frame", (F.row_number().over(Window.partitionBy("file").orderBy("split", "at")) - 2).cast("bigint"))
    return rows.join(places, ["file", "split", "at"]).select("file", "frame", "state", "calculation", "last", "head")


def source_states(found: DataFrame) -> DataFrame:
    """file, frames (complete ones), malformed, interruption of each file: none, in_record (its last calculation isn't closed), or in_file (the file isn't closed behind it)."""
    unclosed = F.max((F.col("state") == "truncated").cast("int")) == 1
    return found.groupBy("file").agg(
        F.sum((F.col("state") == "complete").cast("bigint")).alias("frames"), F.sum((F.col("state") == "malformed").cast("bigint")).alias("malformed"), unclosed.alias("cut"), F.bool_or(F.coalesce("ended", F.lit(False))).alias("ended")
    ).select("file", "frames", "malformed", F.when(F.col("cut"), "in_record").when(~F.col("ended"), "in_file").otherwise("none").alias("interruption"))


def vasprun_states(spark: SparkSession, path: str) -> DataFrame:
    """source_states of vasprun files."""
    whole = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").contains("</modeling>").alias("ended"))
    ended = whole.groupBy("file").agg(F.bool_or("ended").alias("ended"))
    return source_states(vasprun_records(spark, path).select("file", "state").join(ended, "file"))


def read_vasprun(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, frame, cell, positions, velocities, forces, stress (arrays of rows), energies (a map): one row a complete calculation.

    An interrupted file gives its complete calculations. A malformed one before the end raises, or, if not
    strict, leaves its number out.
    """
    broken = (F.col("state") == "malformed") & F.lit(strict)
    raw = vasprun_records(spark, path).filter(_whole(~broken & (F.col("state") != "complete"), broken, "a calculation is malformed")).select("file", "frame", "calculation.*")
    rows = lambda arrays, name: F.transform(F.element_at(F.filter(arrays, lambda a: a["_name"] == name), 1)["v"], lambda s: F.transform(_words(s), lambda x: x.cast("double")))
    safe = lambda arrays, name: F.when(F.exists(arrays, lambda a: a["_name"] == name), rows(arrays, name))
    return raw.select(
        "file", "frame", safe(F.col("structure.crystal.varray"), "basis").alias("cell"), safe(F.col("structure.varray"), "positions").alias("positions"), safe(F.col("structure.varray"), "velocities").alias("velocities"),
        safe(F.col("varray"), "forces").alias("forces"), safe(F.col("varray"), "stress").alias("stress"), F.map_from_entries(F.transform("energy.i", lambda e: F.struct(e["_name"], e["_VALUE"]))).alias("energies"),
    )


def vasprun_heads(spark: SparkSession, path: str) -> DataFrame:
    """file, potim_fs, elements (by atom), masses (by atom): what stands before the first calculation."""
    head = vasprun_records(spark, path).filter("state = 'head'")
    table = lambda name: F.regexp_extract("head", rf'(?s)<array name="{name}"[^>]*>(.*?)</array>', 1)
    atom = r"<rc>\s*<c>\s*([A-Za-z]+)\s*</c>\s*<c>\s*(\d+)\s*</c>"
    kind = r"<rc>\s*<c>\s*\d+\s*</c>\s*<c>\s*([A-Za-z]+)\s*</c>\s*<c>\s*([-+.\dEe]+)\s*</c>"
    out = head.select(
        "file", F.regexp_extract("head", r'<i name="POTIM"[^>]*>\s*([-+.\dEe]+)\s*</i>', 1).try_cast("double").alias("potim_fs"),
        F.regexp_extract_all(table("atoms"), F.lit(atom), F.lit(1)).alias("elements"), F.regexp_extract_all(table("atoms"), F.lit(atom), F.lit(2)).alias("types"),
        F.regexp_extract_all(table("atomtypes"), F.lit(kind), F.lit(2)).alias("kinds"),
    )
    mass = F.transform("types", lambda t: F.try_element_at("kinds", t.cast("int")).cast("double"))
    return out.select("file", "potim_fs", "elements", mass.alias("masses"))


def vasprun_atoms(spark: SparkSession, path: str, timestep_fs: float | None = None, reconstruct: bool = True, strict: bool = True) -> DataFrame:
    """file, frame, t (ps), atom, element, mass, fx, fy, fz, vx, vy, vz (fractions a ps), force_x, force_y, force_z: a row each atom and frame.

    t goes by the file's POTIM or the given step. Velocities are the file's own, or, if it has none and
    reconstruct is set, differences of the unwrapped fractions.
    """
    from framelake.operators.normalize import unwrap, velocities

    frames = read_vasprun(spark, path, strict).join(vasprun_heads(spark, path), "file")
    step = F.lit(timestep_fs) if timestep_fs is not None else F.col("potim_fs")
    frames = frames.filter(_fail(F.size("elements") != F.size("positions"), "atominfo and positions differ in their number of atoms"))
    at = frames.select("file", "frame", (F.col("frame") * step / 1000).alias("t"), "elements", "masses", "velocities", "forces", F.posexplode("positions").alias("k", "f"))
    of = lambda c: F.try_element_at(F.col(c), F.col("k") + 1)
    axes = list(zip("xyz", range(1, 4)))
    rows = at.select(
        "file", "frame", "t", F.col("k").cast("bigint").alias("id"), of("elements").alias("element"), of("masses").alias("mass"), *[F.element_at("f", k).alias(f"f{a}") for a, k in axes],
        *[F.try_element_at(of("velocities"), F.lit(k)).alias(f"own_{a}") for a, k in axes], *[F.try_element_at(of("forces"), F.lit(k)).alias(f"force_{a}") for a, k in axes],
    )
    fractions = ["fx", "fy", "fz"]
    rows = rows.withColumn("atom", F.struct("file", "id"))
    if reconstruct:
        rows = velocities(unwrap(rows, fractions), [f"u_{f}" for f in fractions])
        rows = rows.withColumns({f"v{a}": F.coalesce(F.col(f"own_{a}"), F.col(f"v_u_f{a}")) for a, _ in axes})
    else:
        rows = rows.withColumns({f"v{a}": F.col(f"own_{a}") for a, _ in axes})
    return rows.select("file", "frame", "t", F.col("id").alias("atom"), "element", "mass", *fractions, "vx", "vy", "vz", "force_x", "force_y", "force_z")


def frame_energies(frames: DataFrame) -> DataFrame:
    """file, frame, name, energy: the named energies of every calculation, as rows."""
    return frames.select("file", "frame", F.explode("energies").alias("name", "energy"))


def source_digests(spark: SparkSession, path: str) -> DataFrame:
    """file, digest: SHA-256 over the SHA-256 of a file's lines in order, so that no task reads a whole file."""
    lines = numbered_lines(spark, path).select("file", "split", "no", F.sha2("value", 256).alias("d"))
    parts = lines.groupBy("file", "split").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("no", "d"))), lambda s: s["d"])), 256).alias("d"))
    return parts.groupBy("file").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("split", "d"))), lambda s: s["d"])), 256).alias("digest"))


def read_controls(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, value of KEY = VALUE control files; comments (! or #) and several pairs a line (;) are understood."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.explode(F.split(F.regexp_replace("value", "[!#].*$", ""), ";")).alias("p"))
    pair = F.split("p", "=", 2)
    return lines.filter(F.col("p").contains("=")).select("file", F.upper(F.trim(pair[0])).alias("tag"), F.trim(pair[1]).alias("value"))


#: The tags that the rules read (fixed names).
RULE_TAGS = ["IBRION", "MDALGO", "ISIF", "SMASS", "NSW", "ANDERSEN_PROB", "LANGEVIN_GAMMA", "LANGEVIN_GAMMA_L", "PMASS", "ML_LMLFF", "ML_MODE"]


def certify_controls(tags: DataFrame) -> DataFrame:
    """file, dynamics, ensemble, thermostat, barostat, bias, forces: what the tags (file, tag, value) say about a run; unresolved where they don't settle it.

    Tags of one file are pivoted, then ruled on by the program's documented meaning of them.
    """
    wide = tags.groupBy("file").pivot("tag", RULE_TAGS).agg(F.last("value"))
    whole = lambda c: F.trim(F.col(c)).try_cast("int")
    real = lambda c: F.trim(F.col(c)).try_cast("double")
    ibrion, algo, isif = whole("IBRION"), F.coalesce(whole("MDALGO"), F.lit(0)), F.coalesce(whole("ISIF"), F.lit(2))
    smass, moving = F.coalesce(real("SMASS"), F.lit(-3.0)), (ibrion == 0) & (F.coalesce(whole("NSW"), F.lit(0)) > 0)
    # a friction or collision rate of nothing but zeros is none
    zero = lambda c: F.coalesce(~F.col(c).rlike(r"[1-9]"), F.lit(False))
    free = (algo.isin(0, 2, 21) & (smass == -3)) | (algo.isin(1, 11) & zero("ANDERSEN_PROB")) | ((algo == 3) & zero("LANGEVIN_GAMMA"))
    thermostat = (
        F.when(free, "none").when(algo.isin(0, 2, 21) & (smass >= 0), "nose_hoover").when((algo == 0) & (smass == -1), "rescaling").when((algo == 0) & (smass == -2), "none")
        .when(algo.isin(1, 11), "andersen").when(algo == 3, "langevin").when(algo == 4, "nose_hoover_chain").when(algo == 5, "canonical_rescaling").when(algo == 13, "andersen_groups")
    )
    barostat = F.when((algo == 3) & (isif == 3), "parrinello_rahman").when(isif >= 3, F.lit(None)).otherwise("none")
    ensemble = (
        F.when((algo == 0) & (smass == -2), "constant_velocity").when(F.col("thermostat").isNull() | F.col("barostat").isNull() | (F.col("thermostat") == "rescaling"), "unresolved")
        .when((F.col("barostat") != "none") & (F.col("thermostat") == "none"), "nph").when(F.col("barostat") != "none", "npt").when(F.col("thermostat") == "none", "nve").otherwise("nvt")
    )
    learned = F.upper(F.coalesce("ML_LMLFF", F.lit("F"))).rlike("T")
    forces = F.when(learned & (F.upper(F.trim(F.coalesce("ML_MODE", F.lit("")))) == "RUN"), "model").when(learned, "mixed").otherwise("first_principles")
    out = wide.withColumns({"dynamics": F.when(ibrion.isNull(), "unresolved").when(moving, "molecular_dynamics").otherwise("static"), "thermostat": thermostat, "barostat": barostat})
    out = out.withColumns({"ensemble": ensemble, "bias": F.when(algo.isin(11, 21), "metadynamics").otherwise("unresolved"), "forces": forces})
    only = lambda c: F.when(F.col("dynamics") == "molecular_dynamics", F.coalesce(F.col(c), F.lit("unresolved"))).otherwise(F.when(F.col("dynamics") == "static", "static").otherwise("unresolved")).alias(c)
    return out.select("file", "dynamics", only("ensemble"), only("thermostat"), only("barostat"), "bias", "forces")


# --- extended XYZ ------------------------------------------------------------------------------------

def opened(name: str, data: bytes) -> bytes:
    """The bytes of a file, unpacked by what its name ends in."""
    for end, unpack in ((".gz", gzip.decompress), (".bz2", bz2.decompress), (".xz", lzma.decompress)):
        if name.endswith(end):
            return unpack(data)
    return data


def xyz_records(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, offset, length (bytes), n_atoms, lines, ended, complete: a row a frame. A frame begins with a line that is a number alone, and then a comment.

    The last frame of a file isn't complete if it lacks lines, or words of its last line; another one with
    too few or too many lines raises.
    """
    number = F.col("value").rlike(r"^\s*\d+\s*$")
    lines = line_before(numbered_lines(spark, path).filter(F.trim("value") != ""), number, "after")
    found = gathered(records(lines, number & ~F.col("after"))).withColumnRenamed("record", "frame")
    last = found.groupBy("file").agg(F.max("frame").alias("__last"))
    found = found.join(last, "file").withColumn("n_atoms", F.trim(F.col("lines")[0]).cast("int"))
    n = F.size("lines") - 2
    found = found.filter(_fail((n > F.col("n_atoms")) | ((n < F.col("n_atoms")) & (F.col("frame") < F.col("__last"))), "a frame has another number of atoms than it says"))
    words = lambda k: F.size(_words(F.element_at("lines", k)))
    short = (F.col("frame") == F.col("__last")) & (F.col("n_atoms") > 0) & (words(F.size("lines")) < words(F.lit(3)))
    complete = F.when(n == F.col("n_atoms"), ~short).otherwise(F.lit(False))
    return found.select("file", "frame", "offset", "length", "n_atoms", "lines", "ended", complete.alias("complete"))


def xyz_frames(records: DataFrame) -> DataFrame:
    """file, frame, offset, n_atoms, lattice, info, species, positions, forces (null if there are none) of complete frames."""
    pair = r'(\w+)=("[^"]*"|\S+)'
    comment = F.col("lines")[1]
    values = F.transform(F.regexp_extract_all(comment, F.lit(pair), F.lit(2)), lambda v: F.trim(v, F.lit('"')))
    rows = records.withColumn("info", F.map_from_arrays(F.regexp_extract_all(comment, F.lit(pair), F.lit(1)), values))
    layout = F.split(F.coalesce(F.try_element_at("info", F.lit("Properties")), F.lit("species:S:1:pos:R:3")), ":")
    rows = rows.withColumns({"names": F.filter(layout, lambda x, i: i % 3 == 0), "widths": F.transform(F.filter(layout, lambda x, i: i % 3 == 2), lambda x: x.cast("int"))})
    rows = rows.withColumn("words", F.transform(F.slice("lines", 3, 1 << 30), _words))
    wide = F.aggregate("widths", F.lit(0), lambda a, x: a + x)
    rows = rows.filter(_whole(~F.col("complete"), F.exists("words", lambda w: F.size(w) != wide), "an atom line doesn't fit Properties"))

    def part(*names: str) -> Column:
        """The columns of the first of the properties that there is, as doubles."""
        found = F.coalesce(*[F.when(F.array_contains("names", n), F.array_position("names", n)) for n in names]).cast("int")
        start = F.aggregate(F.slice("widths", F.lit(1), found - 1), F.lit(0), lambda a, x: a + x)
        width = F.element_at("widths", found)
        return F.when(found.isNotNull(), F.transform("words", lambda w: F.transform(F.slice(w, start + 1, width), lambda x: x.cast("double"))))

    place = F.array_position("names", "species").cast("int")
    kind = F.aggregate(F.slice("widths", F.lit(1), place - 1), F.lit(0), lambda a, x: a + x)
    lattice = F.transform(_words(F.try_element_at("info", F.lit("Lattice"))), lambda x: x.cast("double"))
    return rows.select(
        "file", "frame", "offset", "n_atoms", F.when(F.map_contains_key("info", "Lattice"), lattice).alias("lattice"), "info",
        F.transform("words", lambda w: F.element_at(w, kind + 1)).alias("species"), part("pos").alias("positions"), part("forces", "REF_forces").alias("forces"),
    )


def read_extxyz(spark: SparkSession, path: str, frames: list[int] | None = None) -> DataFrame:
    """One row a complete frame: file, frame, offset, n_atoms, lattice, info, species, positions, forces. frames, if given, are the only ones whose atoms are parsed."""
    found = xyz_records(spark, path)
    return xyz_frames(found if frames is None else found.filter(F.col("frame").isin(frames)))


def xyz_text(lines: Column) -> Column:
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def xyz_index(spark: SparkSession, path: str) -> DataFrame:
    """file, frame, offset, length, n_atoms, sha256 (of the frame's lines): what fetch_frames needs of each complete frame."""
    found = xyz_records(spark, path).filter("complete")
    return found.select("file", "frame", "offset", "length", "n_atoms", F.sha2(xyz_text(F.col("lines")), 256).alias("sha256"))


def fetch_frames(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """xyz_frames of the wanted (file, frame) by an index: each task seeks to its frames and reads nothing else. Bytes that differ from the index raise.

    Files are opened by the store's own Arrow file system (local paths, HDFS, object stores).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            rows = []
            for name, frame, offset, length, n, digest in sorted(zip(*(c.to_pylist() for c in batch.columns))):
                store, path = fs.FileSystem.from_uri(name)
                with store.open_input_file(path) as f:
                    f.seek(offset)
                    lines = [x for x in f.read(length).decode().split("\n") if x.strip()]
                if hashlib.sha256("".join(x + "\n" for x in lines).encode()).hexdigest() != digest:
                    raise FormatError(f"frame {frame} of {name} isn't what its index says")
                rows.append((name, frame, offset, length, n, lines, True))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], ["file", "frame", "offset", "length", "n_atoms", "lines", "complete"])

    chosen = index.join(wanted.select("file", "frame").distinct(), ["file", "frame"]).select("file", "frame", "offset", "length", "n_atoms", "sha256")
    return xyz_frames(chosen.mapInArrow(run, "file string, frame bigint, offset bigint, length bigint, n_atoms int, lines array<string>, complete boolean"))


def poll_frames(spark: SparkSession, path: str, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(complete frames that begin beyond what was seen, what is seen now: file, upto). A growing file's last frame is left for the next poll until its last line has ended.

    seen is what the poll before gave; files without a row in it are new.
    """
    found = xyz_records(spark, path).filter("complete and ended")
    now = found.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("upto"))
    if seen is None:
        return xyz_frames(found), now
    old = seen.select("file", F.col("upto").alias("__upto"))
    fresh = found.join(old, "file", "left").filter(F.col("offset") >= F.coalesce("__upto", F.lit(0))).drop("__upto")
    now = now.join(old, "file", "full_outer").select("file", F.greatest("upto", "__upto").alias("upto"))
    return xyz_frames(fresh), now


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of the files there; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def changed_files(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """path, change: added, removed or changed (path, digest on both sides)."""
    a, b = recorded.select("path", F.col("digest").alias("__a")), live.select("path", F.col("digest").alias("__b"))
    what = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("change")).filter("change is not null")


POSCAR = "file string, frame bigint, cell array<double>, species array<string>, fractions array<array<double>>, velocities array<array<double>>"


def poscar_frames(text: str) -> Iterator[tuple[list[float], list[str], list[list[float]], list[list[float]] | None]]:
    """(cell, species, fractions, velocities) of each complete record of a file of concatenated POSCAR / CONTCAR records."""
    lines = text.split("\n")
    at = 0
    while at + 8 <= len(lines):
        if not any(x.strip() for x in lines[at:]):
            return
        try:
            scale = float(lines[at + 1])
            cell = [[scale * float(x) for x in lines[at + k].split()[:3]] for k in (2, 3, 4)]
            names, counts = lines[at + 5].split(), [int(x) for x in lines[at + 6].split()]
        except (ValueError, IndexError) as e:
            raise FormatError(f"line {at + 1} doesn't begin a record") from e
        species = [n for n, c in zip(names, counts) for _ in range(c)]
        at += 7
        if lines[at].strip()[:1] in "Ss":
            at += 1
        cartesian = lines[at].strip()[:1] in "CcKk"
        at += 1
        rows = [x.split()[:3] for x in lines[at : at + len(species)]]
        if len(rows) < len(species) or any(len(r) < 3 for r in rows):
            return
        at += len(species)
        coords = [[float(x) for x in r] for r in rows]
        if cartesian:
            inv = _inverse3(cell)
            coords = [[sum(scale * v[i] * inv[i][j] for i in range(3)) for j in range(3)] for v in coords]
        velocities = None
        if at < len(lines) and not lines[at].strip():
            after = [x.split()[:3] for x in lines[at + 1 : at + 1 + len(species)]]
            if len(after) == len(species) and all(len(r) == 3 and _numbers(r) for r in after):
                velocities = [[float(x) for x in r] for r in after]
                at += 1 + len(species)
            while at < len(lines) and not lines[at].strip():
                at += 1
        yield [x for v in cell for x in v], species, coords, velocities


def _numbers(words: list[str]) -> bool:
    try:
        return bool([float(w) for w in words])
    except ValueError:
        return False


def _inverse3(m: list[list[float]]) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adjugate = [[e * i - f * h, c * h - b * i, b * f - c * e], [f * g - d * i, a * i - c * g, c * d - a * f], [d * h - e * g, b * g - a * h, a * e - b * d]]
    return [[x / det for x in row] for row in adjugate]


def read_poscar(spark: SparkSession, path: str) -> DataFrame:
    """One row a structure of files of one or a few records: file, frame, cell, species, fractions, velocities (null if there are none). A file a task; gz, bz2 and xz are unpacked."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _poscar_batches((name, k, *record) for k, record in enumerate(poscar_frames(opened(name, data).decode())))

    return files.mapInArrow(run, POSCAR)


def _poscar_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.list_(pa.float64())), pa.list_(pa.list_(pa.float64()))]
    names = ["file", "frame", "cell", "species", "fractions", "velocities"]
    while part := list(islice(rows, 256)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)


def read_contcar_stream(spark: SparkSession, path: str, velocities: bool = True) -> DataFrame:
    """The same of concatenated records of any length, splits of a file in different tasks: a record begins seven lines before its Direct or Cartesian line, eight with a Selective line.

    velocities: every record must have its own, or it raises. A cut last record is left out.
    """
    lines = numbered_lines(spark, path)
    mode = F.col("value").rlike(r"(?i)^\s*(direct|cartesian)\s*$")
    begins = line_before(lines, F.col("value").rlike(r"(?i)^\s*selective"), "selective").filter(mode)
    begins = begins.select("file", (F.col("no") - 7 - F.col("selective").cast("int")).alias("no"), F.lit(True).alias("__begin"))
    found = gathered(records(lines.join(begins, ["file", "no"], "left"), F.col("__begin")))
    last = found.groupBy("file").agg(F.max("record").alias("last"))
    texts = found.join(last, "file").select("file", "record", F.array_join("lines", "\n").alias("text"), (F.col("record") == F.col("last")).alias("last"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name, record, text, last in zip(*(c.to_pylist() for c in batch.columns)):
                    parsed = list(poscar_frames(text))
                    if velocities and parsed and parsed[0][3] is None:
                        parsed = []
                    if not parsed and not last:
                        raise FormatError(f"record {record} of {name} isn't whole")
                    if parsed:
                        yield (name, record, *parsed[0])

        yield from _poscar_batches(rows())

    return texts.mapInArrow(run, POSCAR)


def contcar_atoms(frames: DataFrame, timestep_fs: float) -> DataFrame:
    """file, frame, t (ps), atom, element, fx, fy, fz, vx, vy, vz of a stream's records; the step between saved records is given."""
    at = frames.select("file", "frame", (F.col("frame") * timestep_fs / 1000).alias("t"), "species", "velocities", F.posexplode("fractions").alias("k", "f"))
    axes = list(zip("xyz", range(1, 4)))
    own = F.try_element_at(F.col("velocities"), F.col("k") + 1)
    return at.select(
        "file", "frame", "t", F.col("k").cast("bigint").alias("atom"), F.element_at("species", F.col("k") + 1).alias("element"),
        *[F.element_at("f", k).alias(f"f{a}") for a, k in axes], *[F.try_element_at(own, F.lit(k)).alias(f"v{a}") for a, k in axes],
    )
