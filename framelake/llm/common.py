"""What the text operators share: written tables, joins that bear hot keys, names that no column has."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.durable import discard, kept

__all__ = ["attach", "discard", "lean", "released", "table", "unused", "written"]


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and outlives lost executors."""
    return kept(df, tag)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def released() -> None:
    """Gives memory that this process has freed back to the system; allocators keep it otherwise, and idle workers with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A Python task that leaves its worker, which Spark keeps for later ones, without the memory that it has freed."""

    @functools.wraps(run)
    def go(*args) -> Iterator:
        try:
            yield from run(*args)
        finally:
            released()

    return go


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row per group on key, whatever the group sizes.

    Groups of over total / 10,000 rows (64 at least) number under 10,000, so they are
    broadcast and their rows stay where they are; the other groups are small, and shuffle.
    """
    floor = max(64, total // 10_000)
    values = [c for c in groups.columns if c not in (key, size)]
    hot = groups.filter(F.col(size) > floor).drop(size).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    there = marked.filter(F.col("__hot")).drop("__hot")
    rest = marked.filter(F.col("__hot").isNull()).drop("__hot", *values)
    cold = groups.filter(F.col(size) <= floor).drop(size)
    return there.unionByName(rest.join(cold, key))
