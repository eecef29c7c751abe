"""Writers: deterministic tables, extended XYZ and a cache partitioned by run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, order: Sequence[str], kind: str = "csv") -> None:
    """One ordered file of a small result, as csv (with header) or json; an existing path is an error."""
    out = df.coalesce(1).sortWithinPartitions(*order).write.mode("error")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def write_extxyz(frames: DataFrame, path: str, places: int = 8) -> None:
    """frames (frame, lattice, species, positions, [forces]) as extended XYZ text, in frame order over the files."""
    has_forces = "forces" in frames.columns
    number = lambda x: F.format_string(f"%.{places}f", x)
    triple = lambda v: F.concat_ws(" ", F.transform(v, number))
    props = "species:S:1:pos:R:3" + (":forces:R:3" if has_forces else "")
    head = F.concat(F.lit('Lattice="'), triple(F.col("lattice")), F.lit(f'" Properties={props} frame='), F.col("frame").cast("string"))
    atoms = F.arrays_zip("species", "positions", *(["forces"] if has_forces else []))
    line = F.transform(atoms, lambda a: F.concat_ws(" ", a["species"], triple(a["positions"]), *([triple(a["forces"])] if has_forces else [])))
    text = F.concat_ws("\n", F.size("species").cast("string"), head, F.concat_ws("\n", line))
    frames.repartitionByRange("frame").sortWithinPartitions("frame").select(text.alias("value")).write.mode("error").text(path)


def write_xyz_index(spark: SparkSession, path: str) -> DataFrame:
    """Writes the index of the extended XYZ files of a folder beside it (<folder>-index), and reads it back."""
    from framelake.sources.trajectories import xyz_index

    where = f"{path.rstrip('/')}-index"
    xyz_index(spark, path).write.mode("error").parquet(where)
    return spark.read.parquet(where)


class CacheError(ValueError):
    """A cache isn't what its manifest says."""


def run_digests(frames: DataFrame, run: str) -> DataFrame:
    """run, rows, digest: sums of two 60-bit lanes of the rows' SHA-256, whatever their order."""
    columns = sorted(frames.columns)
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    lane = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return frames.groupBy(F.col(run).cast("string").alias(run)).agg(F.count("*").alias("rows"), F.concat_ws(":", lane(0), lane(1)).alias("digest"))


def write_cache(frames: DataFrame, path: str, run: str = "run_id") -> None:
    """Parquet in a folder per run, so that a run is read without the others, and a manifest of their rows and digests beside it (<path>-manifest)."""
    frames.write.mode("error").partitionBy(run).parquet(path)
    run_digests(frames, run).write.mode("error").parquet(f"{path.rstrip('/')}-manifest")


def read_cache(spark: SparkSession, path: str, run: str = "run_id", runs: Sequence[str] | None = None, verify: bool = True) -> DataFrame:
    """The cached rows, of some runs if given; verify compares them with the manifest first."""
    frames, told = spark.read.parquet(path), spark.read.parquet(f"{path.rstrip('/')}-manifest")
    if runs is not None:
        frames, told = (df.filter(F.col(run).cast("string").isin(list(map(str, runs)))) for df in (frames, told))
    if verify:
        live = run_digests(frames, run)
        bad = told.exceptAll(live).unionByName(live.exceptAll(told)).select(run).distinct()
        if names := [r[0] for r in bad.limit(20).collect()]:
            raise CacheError(f"cached runs differ from their manifest: {names}")
    return frames
