"""SimHash near-duplicates by vantage-point trees over Hamming distance.

Fingerprints are deduplicated first; what follows sees each once. A vantage-point tree splits them at
"within mu of the vantage point": a fingerprint farther off than mu, but not beyond mu + radius, goes to
both sides, as by the triangle bound only it can have a partner inside. So each pair within the radius
meets in at least one leaf. The upper levels of the tree are built on the driver from a bounded sample of
fingerprints, and deal them into shards; shards that come out over twice the size meant are split again, by
trees of their own samples, until none is or no split helps. Each shard goes on splitting in memory, compares
exactly in its leaves, and returns one star per component, never pairs. Stars of different shards that share a
fingerprint are joined by min-label rounds with pointer jumps, on tables in the shared folder.

Where fingerprints are unlike (distances about 32 +- 4), each level copies about 0.3 of them, so the
comparisons grow as the power 1.6 of their number; this is the method's price, and no pair is lost.

Nulls: a null text is an empty one, with fingerprint 0, linked like any other; a null doc_id is never a
component's id unless all are null. Equal rows each give a row. An empty table gives an empty table.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, discard, lean, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LEAF = 1024


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text; each bit is 1 if set in over half of the shingles' XXH64."""
    found = WORD.findall((text or b"").lower())
    if not found:
        return 0
    if len(found) <= words:
        grams = [b" ".join(found)]
    else:
        grams = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(grams), 1 << 16):
        part = grams[lo : lo + (1 << 16)]
        h = np.fromiter((digest(g, 42) for g in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the fingerprint's 64 bits as a bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "doc_id bigint, fp bigint")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :])


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point and mu with the least expected work, or None if no split helps."""
    if len(points) < 2:
        return None
    some = points if len(points) <= 4096 else rng.choice(points, 4096, replace=False)
    vantages = rng.choice(some, min(8, len(some)), replace=False)
    best, found = 0.95, None  # of what comparing all with all costs
    for v, d in zip(vantages, _near(vantages, some)):
        upto = np.cumsum(np.bincount(d, minlength=65 + radius)) / len(some)
        mu = np.arange(65)
        cost = upto[mu + radius] ** 2 + (1 - upto[mu]) ** 2
        k = int(cost.argmin())
        if cost[k] < best and upto[k + radius] < 1 - 1e-9 and upto[k] > 0:
            best, found = float(cost[k]), (int(v), k)
    return found


class Tree:
    """Nodes are (vantage, mu, inner, outer), leaves shard numbers."""

    def __init__(self, sample: np.ndarray, total: int, capacity: int, radius: int) -> None:
        self.radius, self.shards = radius, 0
        rng = np.random.default_rng(7)
        self.root = self._grow(np.unique(sample), total / max(len(sample), 1), capacity, rng)

    def _grow(self, points: np.ndarray, scale: float, capacity: int, rng: np.random.Generator):
        at = _split(points, self.radius, rng) if len(points) * scale > capacity and len(points) >= 64 else None
        if at is None:
            self.shards += 1
            return self.shards - 1
        d = np.bitwise_count(points ^ np.uint64(at[0]))
        return (*at, self._grow(points[d <= at[1] + self.radius], scale, capacity, rng), self._grow(points[d > at[1]], scale, capacity, rng))

    def route(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indices of its members) for all shards that get some of fps."""
        stack = [(self.root, np.arange(len(fps)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if isinstance(node, int):
                yield node, own
                continue
            d = np.bitwise_count(fps[own] ^ np.uint64(node[0]))
            stack += [(node[2], own[d <= node[1] + self.radius]), (node[3], own[d > node[1]])]


def _groups(points: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Index arrays of the components of two and more, by exact comparison. Memory: 4 M cells at a time."""
    n = len(points)
    left = np.ones(n, bool)
    whole = _near(points, points) <= radius if n <= 2 * LEAF else None
    seeds = np.flatnonzero(whole.sum(axis=1) > 1) if whole is not None else range(n)
    for s in seeds:
        if not left[s]:
            continue
        left[s] = False
        members, edge = [np.array([s])], np.array([s])
        while len(edge):
            step = max(1, (1 << 22) // n)
            fresh = []
            for lo in range(0, len(edge), step):
                part = edge[lo : lo + step]
                rest = np.flatnonzero(left)
                if not len(rest):
                    break
                hit = whole[np.ix_(part, rest)] if whole is not None else _near(points[part], points[rest]) <= radius
                new = rest[hit.any(axis=0)]
                left[new] = False
                fresh.append(new)
            edge = np.concatenate(fresh) if fresh else np.array([], int)
            members.append(edge)
        if sum(map(len, members)) > 1:
            yield np.concatenate(members)


def local_stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of every component of two and more among the distinct uint64 fps of one shard."""
    rng = np.random.default_rng(11)
    parent = np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    stack = [np.arange(len(fps))]
    while stack:
        own = stack.pop()
        at = _split(fps[own], radius, rng) if len(own) > LEAF else None
        if at is None:
            for group in _groups(fps[own], radius):
                a = find(int(own[group[0]]))
                for x in own[group[1:]]:
                    b = find(int(x))
                    if a != b:
                        a, b = min(a, b), max(a, b)
                        parent[b] = a
            continue
        d = np.bitwise_count(fps[own] ^ np.uint64(at[0]))
        stack += [own[d <= at[1] + radius], own[d > at[1]]]
    roots = np.array([find(i) for i in range(len(fps))], int)
    many = np.bincount(roots, minlength=len(fps))[roots] > 1 if len(fps) else np.zeros(0, bool)
    return fps[many], fps[roots[many]]


def near_components(spark: SparkSession, fps: DataFrame, radius: int = 3, shard_size: int = 1 << 16, sample_size: int = 50_000) -> DataFrame:
    """(fp, doc_id, size, component_id): one row per distinct fp of (doc_id, fp); doc_id is its smallest.

    shard_size: fingerprints a shard is meant to hold (8 bytes each); the first levels come from
    sample_size fingerprints at most. Neither changes the result.
    """
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size")), "reps")
    total = reps.count()
    tree = None
    if total > shard_size:
        share = sample_size / total
        drawn = reps.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))).limit(2 * sample_size)
        tree = Tree(np.array([r[0] for r in drawn.collect()], np.int64).view(np.uint64), total, shard_size, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, at in tree.route(own) if tree else [(0, np.arange(len(own)))]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard)), pa.array(own[at].view(np.int64))], ["shard", "fp"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        member, root = local_stars(np.unique(shard["fp"].to_numpy(np.int64).view(np.uint64)), radius)
        return pd.DataFrame({"shard": int(shard["shard"].iloc[0]), "root": root.view(np.int64), "fp": member.view(np.int64)})

    dealt = reps.select("fp").mapInArrow(lean(deal), "shard bigint, fp bigint")
    shards = tree.shards if tree else 1
    if tree:
        dealt, shards = split_again(written(dealt, "dealt"), shards, shard_size, radius)
    # a task a shard: a shard's fingerprints are few bytes, but many comparisons
    stars = dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(search, "shard bigint, root bigint, fp bigint")
    stars = written(stars, "stars")
    labels = joined_labels(stars) if shards > 1 else stars.select("fp", F.col("root").alias("label"))
    known = reps.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    known = written(known, "known")
    least = known.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("fps"))
    return attach(known, least, "label", "fps", total).drop("label")


def split_again(dealt: DataFrame, shards: int, shard_size: int, radius: int, at_once: int = 2000, drawn: int = 4096) -> tuple[DataFrame, int]:
    """(dealt (a written table of shard and fp) with shards of over twice shard_size split, the number of shards).

    A round takes the at_once largest of them; each gets a tree of its own, grown in a task from about drawn of its
    fingerprints, and the trees (some kilobytes each) are sent to all tasks. What no split helps stays as it is.
    """
    spark, whole = dealt.sparkSession, set()

    def grow(own: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(own["fp"].to_numpy(np.int64).view(np.uint64), int(own["n"].iloc[0]), shard_size, radius)
        return pd.DataFrame({"shard": own["shard"].iloc[:1], "tree": [pickle.dumps(tree)], "parts": [tree.shards]})

    while True:
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * shard_size)
        large = [tuple(r) for r in sizes.orderBy(F.desc("n"), "shard").limit(at_once + len(whole)).collect() if r[0] not in whole][:at_once]
        if not large:
            return dealt, shards
        known = F.broadcast(spark.createDataFrame(large, "shard bigint, n bigint"))
        draw = F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(1 << 30)) < F.lit(drawn << 30) / F.col("n")
        grown = dealt.join(known, "shard").filter(draw).groupBy("shard").applyInPandas(grow, "shard bigint, tree binary, parts int").collect()
        whole |= {s for s, _ in large} - {r["shard"] for r in grown if r["parts"] > 1}
        trees = {}
        for r in grown:
            if r["parts"] > 1:
                trees[r["shard"]] = (shards, pickle.loads(r["tree"]))
                shards += r["parts"]
        if not trees:
            continue
        sent = spark.sparkContext.broadcast(trees)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                for s in np.unique(of).tolist():
                    own = fps[of == s]
                    first, tree = sent.value.get(s, (s, None))  # noqa: B023
                    for part, at in tree.route(own.view(np.uint64)) if tree else [(0, np.arange(len(own)))]:
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + part)), pa.array(own[at])], ["shard", "fp"])

        fresh = written(dealt.mapInArrow(lean(deal), "shard bigint, fp bigint"), "dealt")
        discard(dealt)
        dealt = fresh


def joined_labels(stars: DataFrame) -> DataFrame:
    """(fp, label): label, an fp, is the same for all fps that the stars (shard, root, fp) connect. fps are of any one type that has an order."""
    stars = written(stars.select(F.struct("shard", "root").alias("hub"), "root", "fp"), "hubs")
    total = stars.count()
    labels = stars.groupBy("fp").agg(F.min("root").alias("label"))
    sums, held = None, None
    while True:
        labels = written(labels, "labels")
        if held is not None:
            discard(*held)
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("fp", "label").cast("decimal(38,0)"))).first()
        if now == sums:
            discard(stars)
            return labels
        sums = now
        hubs = written(stars.join(labels, "fp").groupBy("hub").agg(F.min("label").alias("low"), F.count("*").alias("n")), "lows")
        held = (labels, hubs)
        low = attach(stars, hubs, "hub", "n", total).groupBy("fp").agg(F.min("low").alias("label"))
        # a label is itself a fingerprint: take over the label that it has by now
        up = labels.select(F.col("fp").alias("label"), F.col("label").alias("next"))
        labels = low.join(up, "label", "left").select("fp", F.least("label", F.coalesce("next", "label")).alias("label"))


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicate_classes(spark: SparkSession, docs: DataFrame, words: int = 3, radius: int = 3, shard_size: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links)."""
    fps = written(fingerprints(docs, words), "fps")
    total = fps.count()
    parts = near_components(spark, fps, radius, shard_size).select("fp", "size", "component_id")
    return attach(fps, parts, "fp", "size", total).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
