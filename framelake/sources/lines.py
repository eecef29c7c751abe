"""Numbered lines of text files and the records that they make up, however large a file is.

Files are read by Spark's text reader, in splits. A split's lines are counted and measured; sums over the
splits of a file (a row a split) give every line its number and byte offset, and every record its number.
So a record (a frame, a table of a log) may cross splits, and no task holds a file. Files that are compressed as a
whole (gz, bz2) are one split each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT = ["file", "split"]


def _of_split() -> Window:
    return Window.partitionBy(*SPLIT).orderBy("at")


def _before(splits: DataFrame, columns: list[str]) -> DataFrame:
    """file, split and b_<c>: the sums of the columns over the splits before."""
    w = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(*SPLIT, *[F.coalesce(F.sum(c).over(w), F.lit(0)).cast("bigint").alias(f"b_{c}") for c in columns])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at (order within the split), no (from 0), offset and bytes (with the line feed), value, ended (whether there is a line feed)."""
    raw = spark.read.option("lineSep", "\n").text(path)
    raw = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.col("value"), F.col("_metadata.file_size").alias("size"),
    )
    sums = raw.groupBy(*SPLIT).agg(F.count("*").alias("lines"), F.sum("bytes").alias("bytes"))
    run = _of_split().rowsBetween(Window.unboundedPreceding, 0)
    own = raw.withColumns({"no": F.row_number().over(_of_split()) - 1, "offset": F.sum("bytes").over(run) - F.col("bytes")})
    out = own.join(_before(sums, ["lines", "bytes"]), SPLIT)
    out = out.withColumns({"no": (F.col("no") + F.col("b_lines")).cast("bigint"), "offset": F.col("offset") + F.col("b_bytes")})
    return out.withColumn("ended", F.col("offset") + F.col("bytes") <= F.col("size")).drop("b_lines", "b_bytes", "size")


def line_before(lines: DataFrame, test: Column, name: str) -> DataFrame:
    """lines with whether the test holds for the line before (false for a file's first), across splits too."""
    own = lines.withColumn("__test", F.coalesce(test, F.lit(False)))
    last = own.groupBy(*SPLIT).agg(F.max_by("__test", "at").alias("__last"))
    of_file = Window.partitionBy("file").orderBy("split")
    last = last.select(*SPLIT, F.lag("__last").over(of_file).alias("__prior"))
    out = own.join(last, SPLIT)
    return out.withColumn(name, F.coalesce(F.lag("__test").over(_of_split()), F.col("__prior"), F.lit(False))).drop("__test", "__prior")


def records(lines: DataFrame, head: Column) -> DataFrame:
    """lines with record: the number of the last head line at or before, from 0; lines before the first head have -1."""
    own = lines.withColumn("__head", F.coalesce(head, F.lit(False)).cast("int"))
    sums = own.groupBy(*SPLIT).agg(F.sum("__head").alias("heads"))
    run = _of_split().rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__run", F.sum("__head").over(run)).join(_before(sums, ["heads"]), SPLIT)
    return own.withColumn("record", (F.col("__run") + F.col("b_heads") - 1).cast("bigint")).drop("__run", "b_heads", "__head")


def gathered(lines: DataFrame) -> DataFrame:
    """file, record, offset, length (bytes), ended (by a line feed), lines (in order): a row a record; those before the first head are left out."""
    by = lines.filter("record >= 0").groupBy("file", "record").agg(F.min("offset").alias("offset"), F.sum("bytes").alias("length"), F.bool_and("ended").alias("ended"), F.array_sort(F.collect_list(F.struct("no", "value"))).alias("l"))
    return by.select("file", "record", "offset", "length", "ended", F.transform("l", lambda s: s["value"]).alias("lines"))
