"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The documents of a source stand in hashed order and are cut into blocks; a document belongs to the block it
starts in. In the ideal, fluid mix every source that has blocks left gets on at a speed in proportion to its
weight; when a source runs out, the others go on with theirs. Block j of a source is released at the slot in
which the fluid mix starts on it, and due before the slot by which the fluid mix is done with it, both by
exact fractions of the weights. Each slot goes to the released block with the earliest deadline. As the fluid
mix itself is a schedule within these windows that fills every slot, so is this one: at no slot has a source
had a block more or less than its target. Sources of weight 0 follow all others, in proportion to their sizes.

The driver sees one total per source and plans the slots of all blocks. A block has block_chars code points,
or, where that would make more than max_blocks, the max_blocks-th part of the total; so the plan has
max_blocks slots at most, and one more per source (24 bytes each, broadcast).

A source of any size is ranked in pieces: its documents are dealt into hash ranges of about range_rows
rows, summed up within each, and the ranges' totals are summed up before. A document counts as many code
points as its text has and one more, so empty documents take up room as well.

Nulls: rows without a source are a source of their own; a null text is an empty one; a null doc_id is
hashed as null. Equal rows stay, each with its place. Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks of a source in a row of the plan.
RUN = 1024


def whole(weights: list[float]) -> list[int]:
    """The weights as whole numbers in the very same proportions."""
    exact = [Fraction(w) for w in weights]
    scale = lcm(*(x.denominator for x in exact))
    return [int(x * scale) for x in exact]


def windows(blocks: list[int], weights: list[int], base: int = 0) -> list[Iterator[tuple[int, int]]]:
    """For each source the (release, deadline) of its blocks in order. Weights are over 0; base is the first slot."""
    order = sorted(range(len(blocks)), key=lambda i: (Fraction(blocks[i], weights[i]), i))

    def of(own: int) -> Iterator[tuple[int, int]]:
        w, at, done, speed = weights[own], 0, 0, sum(weights)
        for j in range(blocks[own] + 1):
            # the sources that run out before the fluid mix comes to block j have had all their blocks
            while at < len(order) and blocks[order[at]] * w <= j * weights[order[at]]:
                done, speed, at = done + blocks[order[at]], speed - weights[order[at]], at + 1
            top = done * w + j * speed
            if j:
                yield base + start, base - (-top // w)
            start = top // w

    return [of(i) for i in range(len(blocks))]


def earliest_deadline_first(spans: list[Iterator[tuple[int, int]]], base: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(source, release, deadline, slot) of every block, slot by slot."""
    waiting, ready = [], []

    def follow(i: int) -> None:
        span = next(spans[i], None)
        if span:
            heapq.heappush(waiting, (span[0], i, span[1]))

    for i in range(len(spans)):
        follow(i)
    slot = base
    while waiting or ready:
        while waiting and waiting[0][0] <= slot:
            released, i, due = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, released))
        due, i, released = heapq.heappop(ready)
        yield i, released, due, slot
        follow(i)
        slot += 1


def plan_of(blocks: list[int], weights: list[float]) -> list[list[tuple[int, int, int]]]:
    """(release, deadline, slot) of every block of every source."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in blocks]
    base = 0
    for late in (False, True):
        own = [i for i, w in enumerate(weights) if (w <= 0) == late]
        if own:
            parts = [blocks[i] for i in own]
            spans = windows(parts, parts if late else whole([weights[i] for i in own]), base)
            for k, *span in earliest_deadline_first(spans, base):
                out[own[k]].append(tuple(span))
            base += sum(parts)
    return out


PLAN = "source string, run bigint, slots array<struct<release:bigint,deadline:bigint,slot:bigint>>"


def planned(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_chars: int = 1 << 16, max_blocks: int = 1 << 20, range_rows: int = 4_000, carried: tuple[str, ...] = ("*",)
) -> tuple[DataFrame, int]:
    """(row (a struct of the carried columns of docs, by default all), chars, start (code points of its source before it), block, release, deadline, slot; the number of slots).

    weights: target weight per source, 0 for those not named; without them a source's total to the given power.
    carried: what moves along with each row.
    """
    spark = docs.sparkSession
    name = lambda s: "none" if s is None else f"={s}"
    rows = docs.select(
        F.struct(*carried).alias("row"),
        F.coalesce(F.concat(F.lit("="), docs["source"]), F.lit("none")).alias("source"),
        (F.length(F.coalesce(docs["text"], F.lit(""))) + 1).cast("bigint").alias("chars"),
        F.xxhash64(F.lit(41), docs["doc_id"], docs["text"]).alias("hash"),
        docs["doc_id"].alias("id"),
    )
    totals = sorted(tuple(r) for r in rows.groupBy("source").agg(F.sum("chars").alias("chars"), F.count("*").alias("n")).collect())
    block_chars = max(block_chars, -(-sum(c for _, c, _ in totals) // max_blocks))
    blocks = [-(-c // block_chars) for _, c, _ in totals]
    named = {name(s): float(w) for s, w in (weights or {}).items()}
    goal = [named.get(s, 0.0) if weights else c**power for s, c, _ in totals]
    plan = [(s, lo // RUN, slots[lo : lo + RUN]) for (s, _, _), slots in zip(totals, plan_of(blocks, goal)) for lo in range(0, len(slots), RUN)]
    plan = F.broadcast(spark.createDataFrame(plan, PLAN))
    # hash ranges: 2^bits of them for a source of n rows
    bits = F.broadcast(spark.createDataFrame([(s, max(0, (n // range_rows).bit_length())) for s, _, n in totals], "source string, bits int"))

    rows = rows.join(bits, "source")
    rows = rows.withColumn("range", F.when(F.col("bits") == 0, F.lit(0).cast("bigint")).otherwise(F.expr("shiftrightunsigned(hash, 64 - bits)"))).drop("bits")
    within = Window.partitionBy("source", "range").orderBy("hash", "id", "chars").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("source", "range").agg(F.sum("chars").alias("sum"))
    ranges = ranges.select("source", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    rows = rows.withColumn("within", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    rows = rows.join(ranges, ["source", "range"]).withColumn("start", F.col("before") + F.col("within"))
    rows = rows.withColumn("block", F.expr(f"start div {block_chars}")).withColumn("run", F.expr(f"block div {RUN}"))
    rows = rows.join(plan, ["source", "run"]).withColumn("at", F.expr(f"element_at(slots, cast(block % {RUN} as int) + 1)"))
    return rows.select("row", "chars", "start", "block", "at.release", "at.deadline", "at.slot"), sum(blocks)


def mixed_schedule(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, source, chars, block, release, deadline, slot, start (place in its source)."""
    return planned(docs, carried=("doc_id", "source"), **options)[0].select("row.doc_id", "row.source", "chars", "block", "release", "deadline", "slot", "start")


def mixed(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """docs in the order of the schedule, with their own columns; written files keep that order."""
    rows, slots = planned(docs, **options)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # slots are alike in size, so that equal ranges of them need no sample of the texts
    ordered = rows.repartitionById(n, F.expr(f"cast(slot * {n} div {max(slots, 1)} as int)")).sortWithinPartitions("slot", "start")
    return ordered.select("row.*")
