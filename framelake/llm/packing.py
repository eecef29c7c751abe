"""Best-fit packing by a grouping genetic algorithm.

A chromosome is a whole packing, its genes are the bins. Crossover injects the well-filled bins of one
parent, whole, into the other, drops the bins that then hold a document twice, and best-fits the displaced
documents; mutation empties the worst-filled bins. Pieces are dealt by their places in the table of pieces
(equal rows too) into problems of about problem_size pieces, or, for documents in the order of a schedule, by
windows of that order, by which sequences are numbered then. Each problem evolves on islands, each a row and a
task of its own; after each epoch every island sends its elite to the next one on the ring, through a join of
the table of islands. Only lengths travel, never texts or ids.

Fewer bins are better, then fuller ones. A packing is evolved until the epochs end or none can be better: it
has as many bins as its total length needs at least, all but one of them full.

Nulls: a null text is an empty one (the end id alone); a null doc_id keeps its place as null. Equal rows
are packed each. An empty table gives an empty table. Documents longer than the capacity are cut.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, written
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text and position: the place, from 0, of each row in the files of docs (read from written files), in the files' order."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    starts, at = [], 0
    for name, n in sorted(tuple(r) for r in rows.groupBy("__file").count().collect()):
        starts.append((name, at))
        at += n
    firsts = docs.sparkSession.createDataFrame(starts, "__file string, __first bigint")
    return rows.join(F.broadcast(firsts), "__file").select("doc_id", "text", (F.col("__first") + F.col("__row")).alias("position"))


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece of each document's ids, with the end id: doc_id, piece, start, length, ids_crc32; position, if docs has it."""
    carried = ["position"] if "position" in docs.columns else []
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, held=1_000_000)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                rows = []
                places = [b.column(2 + k).to_pylist() for k in range(len(carried))]
                for row, (name, ids) in enumerate(zip(b.column(0).to_pylist(), enc.ids([t or "" for t in b.column(1).to_pylist()]))):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((name, k, at // 4, len(part) // 4, zlib.crc32(part), *(p[row] for p in places)))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "piece", "start", "length", "ids_crc32", *carried])

    schema = PIECES + (", position bigint" if carried else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carried).mapInArrow(lean(run), schema)


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts items (in the given order) each into the bin that it leaves the least room in; bins and room grow in place."""
    free = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        need = lengths[i]
        at = bisect_left(free, (need, -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
            room.append(capacity)
        room[b] = r - need
        if room[b]:
            insort(free, (room[b], b))


def packed(order: np.ndarray, lengths: list[int], capacity: int) -> np.ndarray:
    """The bin of each item by best fit in the given order."""
    bins: list[list[int]] = []
    best_fit(order.tolist(), lengths, bins, [], capacity)
    return _genes(bins, len(lengths))


def _genes(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, members in enumerate(bins):
        out[members] = b
    return out


def _bins(genes: np.ndarray) -> list[list[int]]:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(order) else []


def fitness(genes: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then fuller ones (mean square of the fill)."""
    fill = np.bincount(genes, lengths)
    fill = fill[fill > 0]
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 0.0


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """b with half of a's well-filled bins injected, and what they displace packed anew; then its worst bins too."""
    n = len(a)
    fill = np.bincount(a, lengths)
    good = np.flatnonzero(fill >= 0.98 * capacity)
    good = good if len(good) else np.array([int(fill.argmax())])
    inject = rng.choice(good, max(1, len(good) // 2), replace=False)
    moved = np.isin(a, inject)
    spoiled = np.unique(b[moved])
    fill_b = np.bincount(b, lengths)
    kept = np.setdiff1d(np.flatnonzero(fill_b), spoiled)
    worst = kept[np.argsort(fill_b[kept])[: max(1, len(kept) // 50)]]
    loose = ~moved & (np.isin(b, spoiled) | np.isin(b, worst))
    child = np.where(moved, a, b + a.max() + 1)
    fixed = np.flatnonzero(~loose)
    names, child[fixed] = np.unique(child[fixed], return_inverse=True)
    room = (capacity - np.bincount(child[fixed], lengths[fixed], len(names))).astype(int).tolist()
    bins: list[list[int]] = [[] for _ in room]
    items = np.flatnonzero(loose)
    items = items[np.argsort(-lengths[items], kind="stable")]
    best_fit(items.tolist(), lengths.tolist(), bins, room, capacity)
    for k, members in enumerate(bins):
        if members:
            child[members] = k
    return child.astype(np.int32)


def best_possible(lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """The fitness of as few bins as the total length needs at least, all but one full."""
    least = -(-int(lengths.sum()) // capacity)
    rest = int(lengths.sum()) - (least - 1) * capacity
    return -least, ((least - 1) + (rest / capacity) ** 2) / least - 1e-12 if least else 0.0


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> tuple[list[np.ndarray], int]:
    """(the population after some generations, best first; crossovers made); ends early at the best possible packing."""
    score = lambda g: fitness(g, lengths, capacity)
    aim = best_possible(lengths, capacity)
    ranked = sorted(((score(g), k, g) for k, g in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
    made = 0
    for _ in range(generations):
        if len(ranked) < 2 or ranked[0][0] >= aim:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], lengths, capacity, rng)
        made += 1
        ranked = sorted([*ranked, (score(child), len(population) + made, child)], key=lambda x: (x[0], -x[1]), reverse=True)[: len(population)]
    return [g for _, _, g in ranked], made


def _dump(population: list[np.ndarray]) -> bytes:
    return zlib.compress(np.stack(population).astype("<i4").tobytes(), 1)


def _load(blob: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(zlib.decompress(blob), "<i4").reshape(-1, max(n, 1))[:, :n])


#: first: the bins of best fit in falling order of lengths; crossovers: made so far; elite: the best packing, of so many bins and mean square fill.
ISLANDS = "problem bigint, island int, lengths binary, population binary, elite binary, bins bigint, fill double, first bigint, crossovers bigint"


def dealt_pieces(parts: DataFrame, problem_size: int) -> tuple[DataFrame, int]:
    """(a written table of pieces with problem, number of problems)."""
    problems = max(1, -(-parts.count() // problem_size))
    if "position" in parts.columns:
        documents = (parts.agg(F.max("position")).first()[0] or 0) + 1
        return parts.withColumn("problem", F.expr(f"position * {problems} div {documents}")), problems
    file = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    return parts.withColumn("problem", F.pmod(F.xxhash64(F.lit(17), file, F.col("_metadata.row_index")), F.lit(problems))), problems


def evolved(dealt: DataFrame, problems: int, capacity: int = 4096, islands: int = 2, epochs: int = 2, generations: int = 32, population: int = 4) -> DataFrame:
    """ISLANDS after all epochs, for the pieces (problem, length) of each problem."""

    def gathered(group: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(group["length"].to_numpy(np.int64))[::-1]
        return pd.DataFrame({"problem": group["problem"].iloc[:1], "lengths": [own.astype("<i4").tobytes()]})

    def row(problem: int, island: int, blob: bytes, before: list[np.ndarray], first: int, done: int, epoch: int) -> tuple:
        own = np.frombuffer(blob, "<i4").astype(np.int64)
        after, made = evolve(own, before, capacity, generations, np.random.default_rng((problem, island, epoch)))
        bins, fill = fitness(after[0], own, capacity)
        return problem, island, blob, _dump(after), _dump(after[:1]), -bins, fill, first, done + made

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ISLANDS.split(", ")])

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for problem, blob, k in zip(batch["problem"], batch["lengths"], batch["island"]):
                own, rng = np.frombuffer(blob, "<i4").astype(np.int64), np.random.default_rng((problem, k))
                packings = []
                for m in range(population):
                    noise = rng.normal(0, 0.02 * m + 0.01 * k * (m > 0), len(own))
                    packings.append(packed(np.argsort(-own * (1 + noise), kind="stable"), own.tolist(), capacity))
                    if fitness(packings[0], own, capacity) >= best_possible(own, capacity):
                        break
                first = len(np.unique(packings[0]))
                yield frame([row(problem, k, blob, packings, first, 0, 0)])

    def go_on(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    n = len(r.lengths) // 4
                    # the elite of the island before takes the place of the worst
                    before = [*_load(r.population, n)[:-1], _load(r.guest, n)[0]]
                    yield frame([row(r.problem, r.island, r.lengths, before, r.first, r.crossovers, epoch)])

        return run

    # a task per problem, then per island (4096 tasks at most): little data, but all the work
    lengths = dealt.select("problem", "length").repartition(min(problems, 4096), "problem").groupBy("problem").applyInPandas(gathered, "problem bigint, lengths binary")
    tasks = min(problems * islands, 4096)
    at = lambda df: df.repartition(tasks, "problem", "island")
    each = written(lengths, "problems").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    state = written(at(each).mapInPandas(lean(begin), ISLANDS), "islands")
    for epoch in range(1, epochs):
        guests = state.select("problem", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.col("elite").alias("guest"))
        state = written(at(state.join(guests, ["problem", "island"])).mapInPandas(lean(go_on(epoch)), ISLANDS), "islands")
    return state


def pack_pieces(parts: DataFrame, capacity: int = 4096, problem_size: int = 8192, **options) -> DataFrame:
    """parts (a written table of pieces) with sequence_id and offset, gapless from 0 in each sequence. options: those of evolved()."""
    scheduled = "position" in parts.columns
    dealt, problems = dealt_pieces(parts, problem_size)
    state = evolved(dealt, problems, capacity, **options)
    best = state.groupBy("problem").agg(F.max_by("elite", F.struct(-F.col("bins"), "fill", -F.col("island"))).alias("genes"))
    order = ["doc_id", "piece", "start", "ids_crc32"]

    def place(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left.sort_values(["length", *order], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        genes = _load(right["genes"].iloc[0], len(own))[0]
        n = own["length"].to_numpy(np.int64)
        if scheduled and len(genes):
            # sequences are numbered in the order of their pieces' mean places
            names, genes = np.unique(genes, return_inverse=True)
            mean = np.bincount(genes, own["position"].to_numpy(float)) / np.bincount(genes)
            rank = np.empty(len(names), np.int64)
            rank[np.argsort(mean, kind="stable")] = np.arange(len(names))
            genes = rank[genes]
        by_bin = np.argsort(genes, kind="stable")
        run = np.cumsum(n[by_bin]) - n[by_bin]
        head = np.concatenate([[True], np.diff(genes[by_bin]) != 0]) if len(genes) else np.zeros(0, bool)
        offset = np.empty(len(n), np.int64)
        offset[by_bin] = run - np.maximum.accumulate(np.where(head, run, 0))
        return own.drop(columns=["problem", *(["position"] if scheduled else [])]).assign(sequence_id=(int(key[0]) << 32) + genes.astype(np.int64), offset=offset)

    schema = PIECES + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("problem").cogroup(best.groupBy("problem")).applyInPandas(place, schema)


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, scheduled: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    scheduled: the files of docs stand in an order that the sequences are to follow.
    """
    return pack_pieces(written(pieces(placed(docs) if scheduled else docs, tokenizer, end_id, capacity), "pieces"), capacity)
