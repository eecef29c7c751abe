"""Near dedup: one document stays of each group that verified likeness connects.

Two documents are linked if their sets of word shingles have a Jaccard likeness of the similarity or more.
The nodes of the graph are the distinct sets. Candidates come from two searches:

- SimHash and vantage-point trees (simhash.near_components): a 64-bit fingerprint of the set; each node is a
  candidate with the least node of its component. This finds the closest copies.
- Banded sketches for the rest, which fingerprints within three bits can't reach (a pair right at 0.8 differs
  in about ten of 64 bits): a bucket is the nodes that share the least hashes of a band. All pairs of a
  bucket of up to FEW nodes are candidates, in a larger one each node with the head; then, in blocks, every
  node outside the bucket's largest group of linked nodes with every node not linked to it.

A candidate pair whose sketches agree in too few places is ruled out, the others are decided by their whole
sets of 64-bit shingle hashes. Two chances lose a pair, each at most about 1e-6 right at the similarity and
falling fast above it: it shares no band (miss), or its sketches agree five standard errors too little.

A large bucket of many nodes that nothing links costs the square of their number in comparisons of sketches,
in groups of bounded size; all else grows with the number of documents.

Nulls: a null text is an empty one, and empty texts are alike; a null doc_id counts as larger than any other.
Rows with the same doc_id and unlike texts are documents of their own. Equal rows: one stays. Empty tables
give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, discard, lean, unused, written
from .simhash import WORD, joined_labels, near_components

#: Pairs of a bucket of up to so many nodes are listed; larger buckets are compared block by block.
FEW = 16
MARKS = "doc_id bigint, digest bigint, same binary, fp bigint, sketch binary, keys array<bigint>"


def hashes(text: str | bytes | None, words: int) -> np.ndarray:
    """The set of word shingles as sorted 64-bit hashes."""
    found = WORD.findall((text.encode() if isinstance(text, str) else text or b"").lower())
    grams = [b" ".join(found)] if len(found) <= words else list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)))


def shingles(text: str | None, words: int) -> set:
    """The set of word shingles, A-Z lower-cased (fewer words: the whole sequence)."""
    found = WORD.findall((text or "").encode().lower())
    return set(zip(*(found[i:] for i in range(words)))) if len(found) > words else {tuple(found)}


def likeness(a: str | None, b: str | None, words: int) -> float:
    """Jaccard likeness of the sets of word shingles."""
    x, y = shingles(a, words), shingles(b, words)
    return len(x & y) / len(x | y)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have at least the similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def set_fingerprint(h: np.ndarray) -> int:
    """The SimHash of a set: each bit is 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """So many bands that a pair right at the similarity shares none with a chance of at most miss, wherever the edits are."""
    return max(1, math.ceil(math.log(miss) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1


def least_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The least values of the set under n random hash functions."""
    odd = np.random.default_rng(17).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max)
    step = max(1, (1 << 19) // n)
    for lo in range(0, len(h), step):
        low = np.minimum(low, ((odd[:, None] * h[None, lo : lo + step]) >> np.uint64(32)).min(axis=1))
    return low


def agreement_floor(similarity: float, n: int) -> float:
    """The share of n places in which sketches of sets right at the similarity agree at least, but for five standard errors."""
    return similarity - 5 * math.sqrt(similarity * (1 - similarity) / n)


def marks_of(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """MARKS of every row of docs (doc_id, digest, text): a digest of its set, the set's fingerprint, a byte of each least hash, a key a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                out: list[tuple] = []
                for t in b.column(2):
                    h = hashes(t.as_py(), words)
                    low = least_hashes(h, bands * rows)
                    keys = [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(bands, rows))]
                    out.append((xxhash.xxh3_128_digest(h.tobytes()), set_fingerprint(h), low.astype(np.uint8).tobytes(), np.array(keys, np.uint64).view(np.int64)))
                same, fp, sketch, keys = zip(*out)
                own = [pa.array(same, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *own], ["doc_id", "digest", "same", "fp", "sketch", "keys"])

    return docs.select("doc_id", "digest", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), MARKS)


def tree_pairs(nodes: DataFrame, total: int, radius: int) -> DataFrame:
    """(a, b): every node that fingerprints within the radius connect to others, with the least of them."""
    parts = near_components(nodes.sparkSession, nodes.select(F.col("same").alias("doc_id"), "fp"), radius).select("fp", "size", F.col("component_id").alias("a"))
    return attach(nodes.select("same", "fp"), parts, "fp", "size", total).filter("a <> same").select("a", F.col("same").alias("b"))


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, same, head, members) of every key of two nodes and more; head is the least of them."""
    every = nodes.select("same", F.explode("keys").alias("key"))
    heads = every.groupBy("key").agg(F.min("same").alias("head"), F.count("*").alias("members")).filter("members > 1")
    # the rows of a large bucket are dealt over tasks by the adaptive skew join
    return every.join(written(heads, "heads"), "key")


def bucket_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): all pairs of small buckets, and of large ones each node with the head."""
    lists = shared.filter(F.col("members") <= FEW).groupBy("key").agg(F.sort_array(F.collect_set("same")).alias("ids")).select("ids").distinct()
    pairs = F.expr(f"flatten(transform(ids, (a, i) -> transform(slice(ids, i + 2, {FEW}), b -> struct(a as a, b as b))))")
    small = lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    large = shared.filter((F.col("members") > FEW) & (F.col("same") != F.col("head"))).select(F.col("head").alias("a"), F.col("same").alias("b"))
    return small.unionByName(large)


def agreeing(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The pairs whose sketches agree in at least that share of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= floor))

    left, right = (nodes.select(F.col("same").alias(c), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(lean(run), "a binary, b binary")


def hashed_sets(docs: DataFrame, words: int) -> DataFrame:
    """(same, hashes): hashes() of every text, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([hashes(t.as_py(), words).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["same", "hashes"])

    return docs.select("same", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "same binary, hashes array<bigint>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole sets are alike; no set leaves the JVM for it."""
    left, right = (sets.select(F.col("same").alias(c), F.col("hashes").alias(f"h{c}")) for c in ("a", "b"))
    both = F.size(F.array_intersect("ha", "hb"))
    sizes = F.size("ha") + F.size("hb")
    near = F.least(F.size("ha"), F.size("hb")) >= similarity * F.greatest(F.size("ha"), F.size("hb")) - 1e-9
    alike_ = F.when(near, both >= similarity * (sizes - both) - 1e-9).otherwise(F.lit(False))
    return pairs.join(left, "a").join(right, "b").filter(alike_).select("a", "b")


def block_links(left: pd.DataFrame, right: pd.DataFrame, similarity: float, floor: float) -> list[tuple[bytes, bytes]]:
    """Pairs of a row of the one and a row of the other side that are alike, as many as connect their labels."""
    parent: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    other = np.stack([np.frombuffer(s, np.uint8) for s in right["sketch"]])
    names, codes = np.unique(np.array(right["label"].tolist(), object), return_inverse=True)
    sets = [np.asarray(h, np.int64) for h in right["hashes"]]
    ids = right["same"].tolist()
    for same, label, sketch, own in zip(left["same"], left["label"], left["sketch"], left["hashes"]):
        mine, agree = np.asarray(own, np.int64), (other == np.frombuffer(sketch, np.uint8)).mean(axis=1)
        own_root = find(label)
        open_labels = np.array([find(x) != own_root for x in names])
        at = np.flatnonzero((agree >= floor) & open_labels[codes])
        for k in at[np.argsort(-agree[at], kind="stable")]:
            x, y = find(label), find(names[codes[k]])
            if x != y and alike(mine, sets[k], similarity):
                parent[x] = y
                out.append((same, ids[k]))
    return out


def rest_links(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float, floor: float, block: int) -> DataFrame:
    """(a, b): links between the nodes of large buckets that have unlike labels as yet; every such pair is compared.

    In a bucket the label that most nodes have is the major one. Nodes of other labels, the minors, meet the
    majors and each other in groups of two blocks.
    """
    named = shared.filter(F.col("members") > FEW).join(labels.withColumnRenamed("fp", "same"), "same", "left")
    named = written(named.select("key", "same", F.coalesce("label", "same").alias("label")), "named")
    counts = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("majors"), F.sum("n").alias("n"))
    most = most.filter("n > majors").withColumn("minors", F.col("n") - F.col("majors"))
    rows = attach(named, written(most, "most"), "key", "n", named.count())
    parts = lambda c: F.ceil(F.col(c) / block).cast("bigint")
    rows = rows.withColumns({"p": parts("majors"), "q": parts("minors"), "minor": F.col("label") != F.col("major")})
    rows = rows.withColumn("own", F.pmod(F.xxhash64("same"), F.when(F.col("minor"), F.col("q")).otherwise(F.col("p"))))
    # group (i, j): the minors of block i with the majors of block j < p, or with the minors of block j - p >= i
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    zero, own = F.lit(0).cast("bigint"), F.col("own")
    as_left = F.transform(F.concat(upto(zero, F.col("p") - 1), upto(F.col("p") + own, F.col("p") + F.col("q") - 1)), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("first")))
    as_right = lambda at, last: F.transform(upto(zero, last), lambda i: F.struct(i.alias("i"), at.alias("j"), F.lit(False).alias("first")))
    rows = rows.withColumn("at", F.when(F.col("minor"), F.concat(as_left, as_right(F.col("p") + own, own))).otherwise(as_right(own, F.col("q") - 1)))
    rows = rows.select("key", "same", "label", "at").join(sets, "same").withColumn("at", F.explode("at"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["first"]], group[~group["first"]]
        found = block_links(left, right, similarity, floor) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=object)

    return rows.select("key", "at.*", "same", "label", "sketch", "hashes").groupBy("key", "i", "j").applyInPandas(compare, "a binary, b binary").distinct()


def kept_of(marks: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    """(doc_id, digest, go): go is true for documents that a lesser one of their group replaces, false for rows that repeat the one that stays."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "digest")
    sets = marks.groupBy("same").agg(F.min(order).alias("low"), F.count("*").alias("n"))
    sets = written(sets.join(labels.withColumnRenamed("fp", "same"), "same", "left").withColumn("label", F.coalesce("label", "same")), "sets")
    groups = sets.groupBy("label").agg(F.min("low").alias("keep"), F.sum("n").alias("rows"), F.count("*").alias("sets")).filter("rows > 1")
    of_set = attach(sets.select("same", "n", "label"), written(groups, "groups"), "label", "sets", total).select("same", "n", "keep")
    rows = attach(marks.select("same", "doc_id", "digest"), written(of_set, "kept"), "same", "n", total)
    stays = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("digest") == F.col("keep.digest"))
    flags = rows.groupBy("doc_id", "digest", (~stays).alias("go")).agg(F.count("*").alias("n"))
    return flags.filter("go or n > 1").select("doc_id", "digest", "go")


def near_dedup(
    spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3, rows: int = 6, miss: float = 1e-6, block: int = 256
) -> DataFrame:
    """docs with one row of each group of near copies, that with the smallest doc_id; all columns stay.

    radius: of the fingerprints' search. rows: least hashes a band. miss: the chance that a pair right at the
    similarity shares no band; the number of bands follows from it. block: nodes a block of a large bucket is
    meant to hold; it doesn't change the result.
    """
    id_, digest, row_id, row_digest, go = unused(docs.columns, "id", "digest", "row_id", "row_digest", "go")
    ident = {id_: docs["doc_id"].cast("bigint"), digest: F.xxhash64(F.coalesce(docs["text"], F.lit("")))}
    slim = docs.select(*(c.alias(n) for c, n in zip(ident.values(), ("doc_id", "digest"))), docs["text"].alias("text"))

    bands = bands_for(similarity, rows, miss)
    floor = agreement_floor(similarity, bands * rows)
    marks = written(marks_of(slim, words, bands, rows), "marks")
    total = marks.count()
    nodes = written(marks.dropDuplicates(["same"]), "nodes")
    shared = written(buckets(nodes), "shared")
    near = tree_pairs(nodes, total, radius).unionByName(bucket_pairs(shared)).distinct()
    near = written(agreeing(near, nodes, floor), "near")

    ends = near.select(F.explode(F.array("a", "b")).alias("same"))
    needed = ends.unionByName(shared.filter(F.col("members") > FEW).select("same")).distinct()
    whose = nodes.select("same", "doc_id", "digest", "sketch").join(needed, "same").select("same", "sketch", F.col("doc_id").alias("id"), F.col("digest").alias("of"))
    texts = slim.join(whose, slim["doc_id"].eqNullSafe(whose["id"]) & (slim["digest"] == whose["of"])).select("same", "text").dropDuplicates(["same"])
    hashed = written(hashed_sets(texts, words), "hashes")
    sets = hashed.join(nodes.select("same", "sketch"), "same")

    stars = lambda links: links.select(F.lit(0).alias("shard"), F.col("a").alias("root"), F.explode(F.array("a", "b")).alias("fp")).distinct()
    links = written(stars(verified(near, sets, similarity)), "links")
    labels = joined_labels(links)
    rest = written(stars(rest_links(shared, labels, sets, similarity, floor, block)), "rest")
    if not rest.isEmpty():
        labels = joined_labels(links.unionByName(rest))

    flags = written(kept_of(marks, labels, total), "flags")
    discard(marks, nodes, shared, near, hashed, links, rest)
    flags = flags.toDF(row_id, row_digest, go)
    marked = docs.withColumns(ident).join(flags, F.col(id_).eqNullSafe(F.col(row_id)) & (F.col(digest) == F.col(row_digest)), "left")
    alone = marked.filter(F.col(go).isNull())
    if not flags.filter(~F.col(go)).isEmpty():
        alone = alone.unionByName(marked.filter(~F.col(go)).dropDuplicates([id_, digest]))
    return alone.select(*(F.col(f"`{c}`") for c in docs.columns))
