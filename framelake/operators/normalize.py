"""Normalisation of coordinates and frames: selections, wrapping, unwrapping, velocities, drift, cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.functions.columns import inverse, row_times, wrap


class SemanticsError(ValueError):
    """An operator for ordered frames was given independent samples."""


def require_trajectory(semantics: str) -> None:
    if semantics != "trajectory":
        raise SemanticsError(f"needs ordered frames, not {semantics}")


def select_atoms(rows: DataFrame, species: Sequence[int] | None = None, atoms: DataFrame | None = None) -> DataFrame:
    """By species, or by a table of atom ids; exactly one of them. Repeated ids raise at run time."""
    if (species is None) == (atoms is None):
        raise ValueError("either species or atoms")
    if species is not None:
        return rows.filter(F.col("species").isin(list(species)))
    once = atoms.groupBy("atom").agg(F.count("*").alias("n"))
    once = once.filter(F.when(F.col("n") > 1, F.raise_error(F.lit("an atom is selected twice")).cast("boolean")).otherwise(F.lit(True)))
    return rows.join(once, "atom", "left_semi")


def select_frames(rows: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Every step-th frame from start, before stop, numbered anew from 0."""
    chosen = (F.col("frame") >= start) & ((F.col("frame") - start) % step == 0)
    if stop is not None:
        chosen &= F.col("frame") < stop
    return rows.filter(chosen).withColumn("frame", F.expr(f"(frame - {start}) div {step}"))


def canonical_order(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """atom: the place of each row in its frame by source id. Frames are ranked apart from each other."""
    w = Window.partitionBy("frame").orderBy(key)
    return rows.withColumn("atom", (F.row_number().over(w) - 1).cast("bigint"))


def population_faults(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Frames whose ids repeat, or differ in number or sum of hashes from the first frame's."""
    ids = rows.groupBy("frame").agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("sum"))
    first = ids.agg(F.min_by(F.struct("n", "sum"), "frame").alias("first"))
    return ids.join(F.broadcast(first)).filter("n <> ids or n <> first.n or sum <> first.sum").select("frame", "n", "ids")


def unwrap(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """u_<axis>: wrapped fractions made continuous along each atom; steps go to the nearest image, ties to even."""
    w = Window.partitionBy("atom").orderBy("frame")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    wrapped = {f"__w_{a}": wrap(F.col(a)) for a in axes}
    out = rows.withColumns(wrapped)
    out = out.withColumns({f"__d_{a}": F.col(f"__w_{a}") - F.lag(f"__w_{a}").over(w) for a in axes})
    out = out.withColumns(
        {f"u_{a}": F.first(f"__w_{a}").over(run) + F.sum(F.coalesce(F.col(f"__d_{a}") - F.rint(f"__d_{a}"), F.lit(0.0))).over(run) for a in axes}
    )
    return out.drop(*[f"__{p}_{a}" for p in "wd" for a in axes])


def unwrap_by_flags(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """u_<axis>: the wrapped fraction plus its image flag (i_<axis>)."""
    return rows.withColumns({f"u_{a}": wrap(F.col(a)) + F.col(f"i_{a}") for a in axes})


def velocities(rows: DataFrame, axes: Sequence[str], time: str = "t") -> DataFrame:
    """v_<axis>: second-order differences on a nonuniform grid, one-sided at the ends; two frames share one slope."""
    w = Window.partitionBy("atom").orderBy("frame")
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else (F.lead(c, k).over(w) if k else F.col(c))

    def slope(c: str) -> Column:
        h1, h2 = at(time, 0) - at(time, -1), at(time, 1) - at(time, 0)
        inner = -h2 / (h1 * (h1 + h2)) * at(c, -1) + (h2 - h1) / (h1 * h2) * at(c, 0) + h1 / (h2 * (h1 + h2)) * at(c, 1)
        f1, f2 = at(time, 1) - at(time, 0), at(time, 2) - at(time, 1)
        first = -(2 * f1 + f2) / (f1 * (f1 + f2)) * at(c, 0) + (f1 + f2) / (f1 * f2) * at(c, 1) - f1 / (f2 * (f1 + f2)) * at(c, 2)
        b1, b2 = at(time, -1) - at(time, -2), at(time, 0) - at(time, -1)
        last = b2 / (b1 * (b1 + b2)) * at(c, -2) - (b1 + b2) / (b1 * b2) * at(c, -1) + (2 * b2 + b1) / (b2 * (b1 + b2)) * at(c, 0)
        start, end = at(time, -1).isNull(), at(time, 1).isNull()
        two = F.coalesce((at(c, 1) - at(c, 0)) / f1, (at(c, 0) - at(c, -1)) / h1)
        return F.when(start, F.coalesce(first, two)).when(end, F.coalesce(last, two)).otherwise(inner)

    return rows.withColumns({f"v_{a}": slope(a) for a in axes})


def remove_drift(rows: DataFrame, axes: Sequence[str], weight: Column | None = None, group: Column | None = None) -> DataFrame:
    """d_<axis>: less the weighted mean of the drift group in the same frame. Means are pre-aggregated and joined on frame."""
    weight = F.lit(1.0) if weight is None else weight
    member = F.lit(True) if group is None else group
    total = F.sum(F.when(member, weight))
    means = rows.groupBy("frame").agg(*[(F.sum(F.when(member, weight * F.col(a))) / total).alias(f"__m_{a}") for a in axes])
    out = rows.join(means, "frame")
    return out.withColumns({f"d_{a}": F.col(a) - F.col(f"__m_{a}") for a in axes}).drop(*[f"__m_{a}" for a in axes])


def to_fractions(rows: DataFrame, axes: Sequence[str], cell: Sequence[float | Column], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """f_<axis>: (x - origin) times the inverse cell; cell vectors are the matrix's rows."""
    m = [F.lit(c) if isinstance(c, (int, float)) else c for c in cell]
    v = [F.col(a) - F.lit(o) for a, o in zip(axes, origin)]
    return rows.withColumns({f"f_{a}": c for a, c in zip(axes, row_times(v, inverse(m)))})


def to_positions(rows: DataFrame, axes: Sequence[str], cell: Sequence[float | Column]) -> DataFrame:
    """c_<axis>: fractions f_<axis> times the cell. With one cell for all frames this is the reference-cell map."""
    m = [F.lit(c) if isinstance(c, (int, float)) else c for c in cell]
    return rows.withColumns({f"c_{a}": c for a, c in zip(axes, row_times([F.col(f"f_{a}") for a in axes], m))})


def project(rows: DataFrame, axes: Sequence[str], basis: Sequence[Sequence[float]]) -> DataFrame:
    """p0, p1, ...: components along the basis rows, which must be orthonormal."""
    for i, a in enumerate(basis):
        for j, b in enumerate(basis):
            if abs(sum(x * y for x, y in zip(a, b)) - (i == j)) > 1e-9:
                raise ValueError("the basis isn't orthonormal")
    return rows.withColumns({f"p{k}": sum((F.col(a) * F.lit(c) for a, c in zip(axes, row)), F.lit(0.0)) for k, row in enumerate(basis)})


#: Factors to angstrom, picosecond, electronvolt and atomic mass unit (fixed values).
UNITS = {
    "metal": {"length": 1.0, "time": 1.0, "energy": 1.0, "mass": 1.0},
    "real": {"length": 1.0, "time": 1e-3, "energy": 0.0433641153087705, "mass": 1.0},
    "si": {"length": 1e10, "time": 1e12, "energy": 6.241509074460763e18, "mass": 6.02214076e26},
}


def convert_units(rows: DataFrame, style: str, **columns: str) -> DataFrame:
    """columns: name -> quantity; "velocity" and "force" are derived. Reduced units have no scale and are refused."""
    if style not in UNITS:
        raise ValueError(f"no units {style}")
    u = UNITS[style]
    factor = u | {"velocity": u["length"] / u["time"], "force": u["energy"] / u["length"], "pressure": u["energy"] / u["length"] ** 3}
    return rows.withColumns({c: F.col(c) * F.lit(factor[q]) for c, q in columns.items()})


def eligibility(rows: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """state: ineligible if a required label is null or not a number, degraded if an optional one is, else eligible."""
    bad = lambda cs: sum((F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0) for c in cs), F.lit(0)) > 0
    return rows.withColumn("state", F.when(bad(required), "ineligible").when(bad(optional), "degraded").otherwise("eligible"))


def collection_faults(frames: DataFrame, atoms: DataFrame, positions: DataFrame) -> DataFrame:
    """rule, faults for each invariant of a collection: all zero if it is sound.

    frames: frame, t, cell (9 doubles); atoms: atom, z, mass; positions: frame, atom, x, y, z.
    """
    from framelake.functions.columns import determinant

    w = Window.partitionBy(F.lit(0)).orderBy("frame")  # one row a frame
    ordered = frames.withColumn("__before", F.lag("t").over(w))
    cell = [F.element_at("cell", k + 1) for k in range(9)]
    n_atoms = atoms.agg(F.count("*").alias("__n"))
    count = lambda df, test: df.agg(F.sum(F.when(test, 1).otherwise(0)).cast("bigint").alias("faults"))
    per = positions.groupBy("frame").agg(F.count("*").alias("n"), F.count_distinct("atom").alias("ids"))
    rules = {
        "frame ids are distinct": frames.groupBy("frame").count().agg(F.sum((F.col("count") > 1).cast("bigint")).alias("faults")),
        "times increase": count(ordered, F.col("t") <= F.col("__before")),
        "cells have a volume": count(frames, F.abs(determinant(cell)) <= 1e-12),
        "masses and numbers are positive": count(atoms, (F.col("mass") <= 0) | (F.col("z") <= 0)),
        "every frame has every atom once": count(per.join(F.broadcast(n_atoms)), (F.col("n") != F.col("__n")) | (F.col("ids") != F.col("__n"))),
        "coordinates are finite": count(positions, sum((F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) == float("inf")), 1).otherwise(0) for c in "xyz"), F.lit(0)) > 0),
    }
    out = None
    for name, df in rules.items():
        row = df.select(F.lit(name).alias("rule"), F.coalesce("faults", F.lit(0)).cast("bigint").alias("faults"))
        out = row if out is None else out.unionByName(row)
    return out


def lattice_gauge(frames: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """frame, kind of the step to each frame: smooth, handedness (the determinant's sign changes) or relabelled.

    relabelled: the new cell is an integer combination of the old one's vectors, of determinant 1, other
    than the same vectors. frames: frame, cell (9 doubles, rows).
    """
    from framelake.functions.columns import determinant

    w = Window.partitionBy(F.lit(0)).orderBy("frame")  # one row a frame
    own = [F.element_at("cell", k + 1) for k in range(9)]
    rows = frames.withColumn("__old", F.lag("cell").over(w))
    old = [F.element_at("__old", k + 1) for k in range(9)]
    inv = inverse(old)
    step = [sum((own[3 * i + k] * inv[3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)]
    rows = rows.filter("__old is not null").withColumn("__m", F.array(*step)).withColumn("__flip", determinant(own) * determinant(old) < 0)
    m = [F.element_at("__m", k + 1) for k in range(9)]
    whole = [F.rint(c) for c in m]
    near = F.greatest(*[F.abs(c - r) for c, r in zip(m, whole)]) <= tolerance
    same = sum((F.abs(r - (1.0 if k % 4 == 0 else 0.0)) for k, r in enumerate(whole)), F.lit(0.0)) == 0
    kind = F.when(F.col("__flip"), "handedness").when(near & ~same & (F.abs(determinant(whole)) == 1), "relabelled").otherwise("smooth")
    return rows.select("frame", kind.alias("kind"))


def register_frames(rows: DataFrame, axes: Sequence[str], group: Column, reference: int = 0) -> DataFrame:
    """r_<axis>: fractions less the group's mean nearest-image displacement from the reference frame.

    The displacement is a row a frame, made by one aggregate and joined back on frame.
    """
    base = rows.filter(F.col("frame") == reference).select("atom", *[F.col(a).alias(f"__b_{a}") for a in axes])
    own = rows.filter(group).join(base, "atom")
    step = {a: F.col(a) - F.col(f"__b_{a}") for a in axes}
    shift = own.groupBy("frame").agg(*[F.avg(d - F.rint(d)).alias(f"__s_{a}") for a, d in step.items()])
    out = rows.join(shift, "frame")
    return out.withColumns({f"r_{a}": wrap(F.col(a) - F.col(f"__s_{a}")) for a in axes}).drop(*[f"__s_{a}" for a in axes])


def displace(rows: DataFrame, axes: Sequence[str], amplitude: float, seed: int) -> DataFrame:
    """Coordinates moved by up to amplitude along each axis, the same for the same seed, frame and atom (a fraction of SHA-256)."""
    from framelake.operators.prep import hash_fraction

    named = lambda a: F.concat(F.lit(f"{a}:"), F.col("frame").cast("string"), F.lit(":"), F.col("atom").cast("string"))
    return rows.withColumns({a: F.col(a) + (hash_fraction(seed, named(a)) * 2 - 1) * amplitude for a in axes})


def normalized(rows: DataFrame, axes: Sequence[str], frames: tuple[int, int | None, int] = (0, None, 1), drift: Column | None = None, weight: Column | None = None) -> DataFrame:
    """atom, frame, t, and for each axis u_ (unwrapped), d_ (less the drift of the group) and v_ (velocity) of fractions: the usual steps in their order.

    rows: source_id, frame, t and the axes. Atoms get their places by source id; a frame that holds other
    atoms than the first raises.
    """
    own = select_frames(rows, *frames)
    bad = population_faults(own).agg(F.count("*").alias("__bad"))
    good = F.when(F.col("__bad") > 0, F.raise_error(F.lit("frames hold different atoms")).cast("boolean")).otherwise(F.lit(True))
    own = canonical_order(own).join(F.broadcast(bad)).filter(good).drop("__bad")
    moved = unwrap(own, axes)
    still = remove_drift(moved.withColumns({f"w_{a}": F.col(f"u_{a}") for a in axes}), [f"w_{a}" for a in axes], weight, drift)
    still = still.withColumnsRenamed({f"d_w_{a}": f"d_{a}" for a in axes}).drop(*[f"w_{a}" for a in axes])
    return velocities(still, [f"d_{a}" for a in axes]).withColumnsRenamed({f"v_d_{a}": f"v_{a}" for a in axes})


def strain(rows: DataFrame, axes: Sequence[str], tensor: Sequence[float]) -> DataFrame:
    """Coordinates times (1 + tensor), a row-major 3x3 matrix."""
    m = [F.lit((1.0 if k % 4 == 0 else 0.0) + e) for k, e in enumerate(tensor)]
    return rows.withColumns(dict(zip(axes, row_times([F.col(a) for a in axes], m))))
