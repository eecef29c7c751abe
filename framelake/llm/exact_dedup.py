"""Exact dedup by two-pass Bloom filtering.

Pass 1 puts a hash of every text into a two-bit Bloom filter: each of its four slots remembers
"seen" and "seen again". Tasks fill filters of their own, which merge by or / and, so a hash that
occurs twice has all its slots "seen again", whichever tasks read it. Pass 2 tests every row: a row
whose slots aren't all "seen again" is unique for sure and passes straight through; only the rest
shuffle, and are compared by SHA-256. A false positive costs a shuffled row, never a wrong result.

A filter has 16 bits a row and max_bits at most. Where the rows need more, hashes are cut into so many
ranges, and the two passes run range by range over the column of hashes; so a task holds 2 x max_bits / 8
bytes while it fills and max_bits / 8 while it tests (64 MB and 32 MB by default), at any number of rows.

Nulls: a null text is an empty one; a null doc_id counts as larger than any other. Repeated rows
(equal doc_id and equal text): one stays. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, lean, unused, written

SLOTS = 4
SEGMENT_BITS = 1 << 19


def text_key(text: Column) -> Column:
    """SHA-256 (hex) of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    """SLOTS slot numbers for each 64-bit hash; bits is a power of two."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    at = h[None, :] + np.arange(SLOTS, dtype=np.uint64)[:, None] * step
    at ^= at >> np.uint64(29)
    return (at * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(bits - 1)


def filter_shape(rows: int, max_bits: int) -> tuple[int, int]:
    """(bits of a filter, number of hash ranges): 16 bits a row, both powers of two, filters from 2^13 to max_bits."""
    need = max(1 << 13, 1 << int(16 * max(rows, 1) - 1).bit_length())
    bits = min(need, max_bits)
    return bits, need // bits


def repeated_filter(hashes: DataFrame, bits: int, tasks: int) -> bytes:
    """The merged "seen again" bits over the one bigint column of hashes: at most bits / 8 bytes."""
    segment = min(SEGMENT_BITS, bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(h), 1 << 16):
                # a slot that this very hash takes twice isn't thereby a repeat, but may count as one
                flat, n = np.unique(slots(h[lo : lo + (1 << 16)], bits).ravel(), return_counts=True)
                place, bit = flat >> np.uint64(3), np.uint8(128) >> (flat & np.uint64(7)).astype(np.uint8)
                twice = (n > 1) | (seen[place] & bit > 0)
                np.bitwise_or.at(again, place[twice], bit[twice])
                np.bitwise_or.at(seen, place, bit)
        for k in range(0, bits // 8, segment // 8):
            own = [x[k : k + segment // 8] for x in (seen, again)]
            if own[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([8 * k // segment]), *(pa.array([zlib.compress(x.tobytes(), 1)], pa.binary()) for x in own)], ["segment", "seen", "again"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        seen, again = np.zeros(segment // 8, np.uint8), np.zeros(segment // 8, np.uint8)
        for s, a in zip(parts["seen"], parts["again"]):
            s, a = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (s, a))
            again |= a | (seen & s)
            seen |= s
        return pd.DataFrame({"segment": parts["segment"].iloc[:1], "again": [zlib.compress(again.tobytes(), 1)]})

    parts = hashes.coalesce(max(1, tasks)).mapInArrow(lean(fill), "segment bigint, seen binary, again binary")
    out = bytearray(bits // 8)
    for r in parts.groupBy("segment").applyInPandas(merge, "segment bigint, again binary").toLocalIterator():
        out[r["segment"] * segment // 8 : (r["segment"] + 1) * segment // 8] = zlib.decompress(r["again"])
    return bytes(out)


def maybe_repeated(spark: SparkSession, again: bytes):
    """A column function on a bigint hash: False is certain."""
    held = spark.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        found = np.frombuffer(held.value, np.uint8)
        at = slots(h.to_numpy(np.int64), len(found) * 8)
        return pd.Series((found[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))) & 1).all(axis=0))

    return test


def tested_keys(keys: DataFrame, max_bits: int) -> list[DataFrame]:
    """The rows of a written table with text_sha256, with maybe (false: the text is unique for sure): a table for each range of hashes."""
    spark, h = keys.sparkSession, F.xxhash64("text_sha256")
    bits, ranges = filter_shape(keys.count(), max_bits)
    out = []
    for k in range(ranges):
        # the range comes from bits that slots() doesn't start from
        own = keys if ranges == 1 else keys.filter(F.pmod(F.xxhash64(h), F.lit(ranges)) == k)
        test = maybe_repeated(spark, repeated_filter(own.select(h), bits, spark.sparkContext.defaultParallelism))
        out.append(written(own.withColumn("maybe", test(h)), "tested"))
    return out


def duplicate_classes(spark: SparkSession, docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_sha256")), "keys")
    tested = reduce(DataFrame.unionByName, tested_keys(keys, max_bits))
    alone = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # equal rows are counted, not carried
    rows = tested.filter("maybe").groupBy("text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    groups = rows.groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("ids"))
    joined = attach(rows, groups, "text_sha256", "ids", tested.count())
    again = joined.select(
        "doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"), "text_sha256"
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(again)


def exact_dedup(spark: SparkSession, docs: DataFrame, max_bits: int = 1 << 28) -> DataFrame:
    """docs without later copies: of equal texts the row with the smallest doc_id stays, with all its columns.

    Rows are tested once more by a filter of the hashes that do repeat, of max_bits at most: those it clears pass
    straight through, the others shuffle.
    """
    key, maybe, low, low_key, hot, hot_key = unused(docs.columns, "key", "maybe", "low", "low_key", "hot", "hot_key")
    keys = written(docs.select(docs["doc_id"].alias("doc_id"), text_key(docs["text"]).alias("text_sha256")), "keys")
    tested = reduce(DataFrame.unionByName, tested_keys(keys, max_bits))
    groups = tested.filter("maybe").groupBy("text_sha256").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    groups = written(groups, "groups")
    # the rows' filter holds the hashes that do repeat, each put in twice
    h = groups.select(F.xxhash64("text_sha256"))
    bits, _ = filter_shape(groups.count(), max_bits)
    test = maybe_repeated(spark, repeated_filter(h.unionAll(h), bits, spark.sparkContext.defaultParallelism))
    # of groups of over a ten-thousandth of all rows, which are under 10,000, only the row that stays goes on
    large = groups.filter(F.col("n") > max(64, tested.count() // 10_000)).select(F.col("text_sha256").alias(hot_key), F.col("keep").alias(hot))
    rows = docs.withColumn(key, text_key(docs["text"])).withColumn(maybe, test(F.xxhash64(key)))
    rows = rows.join(F.broadcast(large), F.col(key) == F.col(hot_key), "left").filter(F.col(hot_key).isNull() | F.col("doc_id").eqNullSafe(F.col(hot))).drop(hot, hot_key)
    first = groups.select(F.col("text_sha256").alias(low_key), F.col("keep").alias(low))
    again = rows.filter(maybe).join(first, F.col(key) == F.col(low_key), "left")
    again = again.filter(F.col(low_key).isNull() | F.col("doc_id").eqNullSafe(F.col(low))).drop(low, low_key).dropDuplicates([key])
    return rows.filter(~F.col(maybe)).unionByName(again).drop(key, maybe)
