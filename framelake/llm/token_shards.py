"""Token ids in Re-Pair compressed shards.

Documents are sorted by doc_id over range partitions, encoded, and cut into shards of about shard_ids
ids. In each shard the frequent id pairs are replaced by nonterminals, round after round, until no pair is
left that occurs min_count times: a round counts all pairs, takes the rule_limit most frequent of those, and
replaces their occurrences, the more frequent pair first where two overlap. Shards are rows of a Parquet
table in the shared folder; a lost task is simply run again.

A shard (little-endian): the magic word RPR1; five uint32 (documents, ids, rules, symbols, first
nonterminal); per document its doc_id (int64), whether it is null (uint8) and its number of ids (uint32);
per rule its left and right symbol (uint32 each) and its expansion length (uint32); the symbols (uint32).
Expansion lengths give every symbol's place, so a range of ids is decoded without what stands before.

Nulls: a null text is an empty one, and has the end id alone; a null doc_id sorts first. Equal doc_ids
stay, in the order of a hash of their texts, by which they are dealt out too. An empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

MAGIC = b"RPR1"
COUNT_BITS = 18


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA6B)) >> np.uint32(32 - COUNT_BITS)).astype(np.intp)


def _frequent(s: np.ndarray, min_count: int, rule_limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frequent pairs (left << 32 | right), most frequent first; the places where one stands, and its rank there."""
    slot = _slots(s[:-1], s[1:])
    rough = np.bincount(slot, minlength=1 << COUNT_BITS)
    # a slot's count is an upper bound of its pairs' counts; most slots that count less than this one needn't be looked at
    tail = np.bincount(np.minimum(rough, 4096))[::-1].cumsum()[::-1]
    least = max(min_count, int(np.searchsorted(-tail, -2 * rule_limit, "right")))
    place = np.flatnonzero((rough >= least).take(slot))
    near = s[place].astype(np.uint64) << np.uint64(32) | s[place + 1]
    order = np.sort(near)
    first = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else place
    count = np.diff(np.append(first, len(order)))
    enough = np.flatnonzero(count >= min_count)
    best = enough[np.argsort(-count[enough], kind="stable")[:rule_limit]]
    chosen = order[first[best]]
    if not len(chosen):
        return chosen, place[:0], place[:0]
    # of pairs that share a slot the most frequent is found; the others wait for a later round
    table = np.full(1 << COUNT_BITS, -1, np.int32)
    own = _slots((chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32))
    table[own[::-1]] = np.arange(len(chosen) - 1, -1, -1, dtype=np.int32)
    at = table[slot[place]]
    hit = (at >= 0) & (chosen[at] == near)
    return chosen, place[hit], at[hit]


def _places(place: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Which of the places (with their ranks) to replace, none next to each other: every other one of a run of one pair, unless a neighbour ranks before."""
    if not len(place):
        return np.zeros(0, bool)
    joined = np.diff(place) == 1  # the next frequent place is the next place
    same = joined & (r[1:] == r[:-1])
    begins = np.concatenate([[True], ~same])
    start = np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))
    before = np.concatenate([[False], joined & (r[:-1] < r[1:])])
    after = np.concatenate([joined & (r[1:] < r[:-1]), [False]])
    # a run whose left neighbour ranks before gives its first place up
    give = before[start]
    return ((np.arange(len(place)) - start - give) % 2 == 0) & ~(begins & give) & ~after


def compress(ids: np.ndarray, base: int, min_count: int = 16, rule_limit: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k makes nonterminal base + k of two symbols."""
    s, rules = ids.astype(np.uint32), []
    made = 0
    while len(s) > 1:
        chosen, place, rank = _frequent(s, min_count, rule_limit)
        take = _places(place, rank)
        at = place[take]
        if not len(at):
            break
        used, name = np.unique(rank[take], return_inverse=True)
        rules.append(np.stack([chosen[used] >> np.uint64(32), chosen[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        s[at] = (base + made + name).astype(np.uint32)
        made += len(used)
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), s


def _phrases(rules: np.ndarray, base: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in rules.tolist():
        out.append(np.concatenate([out[x - base] if x >= base else np.array([x], np.uint32) for x in (a, b)]))
    return out


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1))
    return np.array(out, np.uint32)


def pack(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    base = int(ids.max()) + 1 if len(ids) else 1
    rules, symbols = compress(ids, base)
    null = np.array([d is None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [named, null, np.array(sizes, "<u4"), rules.astype("<u4"), lengths_of(rules, base).astype("<u4"), symbols.astype("<u4")]
    return MAGIC + struct.pack("<5I", len(doc_ids), len(ids), len(rules), len(symbols), base) + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read back."""

    def __init__(self, blob: bytes) -> None:
        if blob[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, self.n_ids, n_rules, n_symbols, self.base = struct.unpack_from("<5I", blob, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        named, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(named, null)]
        self.sizes = take("<u4", docs).astype(np.int64)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths, self.symbols = take("<u4", n_rules), take("<u4", n_symbols)
        phrases = _phrases(self.rules, self.base)
        self.phrase_ids = np.concatenate([np.arange(self.base, dtype=np.uint32), *phrases])
        every = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        self.phrase_at = np.cumsum(every) - every
        self.every = every
        self.stops = np.cumsum(every[self.symbols])

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to stop; only the symbols that hold them are expanded."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = int(np.searchsorted(self.stops, start, "right")), int(np.searchsorted(self.stops, stop, "left")) + 1
        s = self.symbols[lo:hi]
        n = self.every[s]
        begin = np.cumsum(n) - n
        out = self.phrase_ids[np.repeat(self.phrase_at[s] - begin, n) + np.arange(int(n.sum()))]
        skip = start - (int(self.stops[lo - 1]) if lo else 0)
        return out[skip : skip + stop - start]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, shard_ids: int = 1 << 20, partitions: int | None = None) -> DataFrame:
    """The written table (part, seq, n_ids, shard); part and seq follow the order of doc_id."""
    spark = docs.sparkSession
    end = struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(tokenizer)
        names: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            blob = pack(names, [len(h) // 4 for h in held], ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_ids", "shard"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                for name, ids in zip(b.column(0).to_pylist(), enc.ids([t or "" for t in b.column(1).to_pylist()])):
                    names.append(name)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= shard_ids:
                        yield shard()
                        names, held, size, seq = [], [], 0, seq + 1
        if names:
            yield shard()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    by_id = by_id.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return written(by_id.mapInArrow(encode, "part int, seq int, n_ids bigint, shard binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    parts = shards.groupBy("part").agg(F.sum("n_ids")).orderBy("part").collect()  # one row a partition
    offsets, before = {}, 0
    for part, n in parts:
        offsets[part] = before
        before += n
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, before, blob = (batch.column(c)[i].as_py() for c in range(3))
                shard = Shard(blob)
                raw = shard.ids().astype("<u4").tobytes()
                stops = np.cumsum(shard.sizes)
                starts = stops - shard.sizes
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
                cols = [pa.array(shard.doc_ids, pa.int64()), pa.array(offsets[part] + before + starts), pa.array(shard.sizes), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = shards.drop("n_ids").join(F.broadcast(places), ["part", "seq"]) if len(parts) < 1000 else shards.drop("n_ids").join(places, ["part", "seq"])
    return placed.select("part", "before", "shard").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer, end_id))
