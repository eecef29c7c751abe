"""Runs, residences, transitions, bursts, windows and blocks: operators on ordered states and indices.

All are gaps-and-islands over windows keyed by entity or run: one shuffle by the key, one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguous_runs(rows: DataFrame, key: str, index: str) -> DataFrame:
    """key, start, stop (exclusive): maximal runs of consecutive indices; repeated ones count once."""
    w = Window.partitionBy(key).orderBy(index)
    at = rows.select(key, index).distinct().withColumn("__island", F.col(index) - F.row_number().over(w))
    return at.groupBy(key, "__island").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop")).drop("__island")


def split_runs(runs: DataFrame, target: int | Column) -> DataFrame:
    """runs cut into max(1, length div target) blocks, the first length mod k of them one longer: block, start, stop."""
    t = F.lit(target) if isinstance(target, int) else target
    size = F.col("stop") - F.col("start")
    out = runs.withColumn("__n", size).withColumn("__k", F.greatest(F.lit(1), F.floor(size / t)).cast("bigint"))
    out = out.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__k") - 1)))
    base, extra = "__n div __k", "__n % __k"
    out = out.withColumn("__from", F.expr(f"start + block * ({base}) + least(block, {extra})"))
    out = out.withColumn("stop", F.expr(f"__from + ({base}) + if(block < {extra}, 1, 0)"))
    return out.withColumn("start", F.col("__from")).drop("__n", "__k", "__from")


def state_residence(rows: DataFrame, key: str, order: str, state: str, time: str | None = None) -> DataFrame:
    """key, state, first, last, n_frames, span, [duration], left_censored, right_censored: maximal intervals of one state."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    out = rows.withColumn("__new", change).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = Window.partitionBy(key)
    out = out.withColumn("__top", F.max("__island").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    aggs = [F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n_frames")]
    if time:
        aggs.append((F.max(time) - F.min(time)).alias("duration"))
    out = out.groupBy(key, F.col(state).alias("state"), "__island", "__top").agg(*aggs)
    out = out.withColumns({"span": F.col("n_frames") - 1, "left_censored": F.col("__island") == 1, "right_censored": F.col("__island") == F.col("__top")})
    return out.drop("__island", "__top")


def state_transitions(rows: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """source, target, adjacent, changed for all pairs of states: adjacent counts the diagonal, changed leaves it out."""
    w = Window.partitionBy(key).orderBy(order)
    steps = rows.select(F.lag(state).over(w).alias("source"), F.col(state).alias("target")).filter("source is not null")
    seen = steps.groupBy("source", "target").agg(F.count("*").alias("n"))
    states = rows.select(F.col(state).alias("s")).distinct()
    # states are few: the grid is their square
    grid = states.select(F.col("s").alias("source")).join(F.broadcast(states.select(F.col("s").alias("target"))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(seen, ["source", "target"], "left").select("source", "target", n.alias("adjacent"), F.when(F.col("source") == F.col("target"), 0).otherwise(n).cast("bigint").alias("changed"))


def entity_presence(rows: DataFrame, entity: str, index: str) -> DataFrame:
    """entity, episodes, frames, first, last, longest_gap: when an entity is there; a gap is what is missing between episodes."""
    runs = contiguous_runs(rows, entity, index)
    w = Window.partitionBy(entity).orderBy("start")
    gap = F.col("start") - F.lag("stop").over(w)
    return runs.withColumn("__gap", gap).groupBy(entity).agg(
        F.count("*").alias("episodes"), F.sum(F.col("stop") - F.col("start")).alias("frames"), F.min("start").alias("first"),
        (F.max("stop") - 1).alias("last"), F.coalesce(F.max("__gap"), F.lit(0)).alias("longest_gap"),
    )


def event_bursts(anchors: DataFrame, run: str, kind: str, index: str, severity: str, uid: str, merge_gap: int = 1) -> DataFrame:
    """run, kind, start, stop, anchors, severity, anchor: anchors of one run and kind that lie at most merge_gap + 1 apart.

    The burst's anchor has the largest severity, then the smallest index, then the smallest uid.
    """
    w = Window.partitionBy(run, kind).orderBy(index, uid)
    fresh = F.when(F.col(index) - F.lag(index).over(w) <= merge_gap + 1, 0).otherwise(1)
    out = anchors.withColumn("__new", fresh).withColumn("__burst", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((-F.coalesce(severity, F.lit(-1.0))).alias("s"), F.col(index).alias("i"), F.col(uid).alias("u")))
    out = out.groupBy(run, kind, "__burst").agg(F.min(index).alias("start"), F.max(index).alias("stop"), F.count("*").alias("anchors"), F.max(severity).alias("severity"), best.alias("__b"))
    return out.withColumn("anchor", F.col("__b.u")).drop("__burst", "__b")


def window_attach(bursts: DataFrame, frames: DataFrame, run: str, index: str, before: int, after: int, width: int = 64) -> DataFrame:
    """bursts with every frame of their run from start - before to stop + after.

    A range join through bins of width indices: equi on (run, bin), then the exact bounds.
    """
    lo, hi = F.col("start") - before, F.col("stop") + after
    cover = bursts.withColumn("__bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    own = frames.withColumn("__bin", F.floor(F.col(index) / width))
    return cover.join(own, [run, "__bin"]).filter((F.col(index) >= lo) & (F.col(index) <= hi)).drop("__bin")


def interval_membership(rows: DataFrame, blocks: DataFrame, key: str, index: str) -> DataFrame:
    """rows with the block (start <= index < stop) of their key: the last start at or before each, by one ordered pass."""
    mark = blocks.select(key, F.col("start").alias(index), F.struct("start", "stop", "block").alias("__b"), F.lit(0).alias("__side"))
    own = rows.withColumn("__row", F.struct(*[F.col(c) for c in rows.columns]))
    own = own.select(key, index, F.lit(1).alias("__side"), "__row")
    both = mark.unionByName(own, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(index, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__b", F.last("__b", ignorenulls=True).over(w)).filter("__side = 1")
    inside = F.col(index) < F.col("__b.stop")
    return both.select("__row.*", F.when(inside, F.col("__b.block")).alias("block"))


def round_robin(rows: DataFrame, order: Sequence[str], labels: int) -> DataFrame:
    """rows with their position in the order, and position mod labels. Positions come from ranges of the order, not one task."""
    return with_position(rows, order).withColumn("label", F.pmod(F.col("position"), F.lit(labels)))


def _tie(rows: DataFrame) -> Column:
    """A hash of all columns that have one (maps don't)."""
    return F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])


def _range_of(key: Column, bounds: list) -> Column:
    """How many of the ordered bounds (foldable columns) are at or before the key; two levels, so 2 sqrt(n) comparisons."""
    if not bounds:
        return F.lit(0)
    fan = math.isqrt(len(bounds) - 1) + 1
    rows = [bounds[k : k + fan] for k in range(0, len(bounds), fan)]
    upto = lambda a: F.size(F.filter(a, lambda x: x <= key))
    heads = upto(F.array(*[r[0] for r in rows]))
    inside = upto(F.element_at(F.array(*[F.array(*r) for r in rows]), heads))
    return F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * fan + inside)


def with_position(rows: DataFrame, order: Sequence[str], keys: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """position: 0, 1, ... in the order, within keys or over all rows; rows that tie follow a hash of all their columns.

    Over all rows, they are dealt into ranges (as many as shuffle partitions, 4096 at most) between bounds
    from a sample of about 64 rows a range; the ranges' counts, a row each, are summed up and added to the
    rank within the range. Ties of the order are parted by the hash, so that no range grows with a key.
    """
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order, _tie(rows))
        return rows.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))
    n = min(ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)
    tied = rows.withColumn("__tie", _tie(rows))
    full = [*order, "__tie"]
    total = rows.count()
    drawn = sorted_keys(tied.sample(fraction=min(1.0, 64 * n / max(total, 1)), seed=5).select(*full))
    kinds = [tied.schema[c].dataType for c in full]
    cuts = dict.fromkeys(drawn[len(drawn) * k // n] for k in range(1, n)) if drawn else {}
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(row, kinds, full)]) for row in cuts]
    placed = tied.withColumn("__part", _range_of(F.struct(*full), bounds))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*full)
    ranked = placed.withColumn("__rank", F.row_number().over(w) - 1)
    out = ranked.join(F.broadcast(counts), "__part").withColumn("position", (F.col("__before") + F.col("__rank")).cast("bigint"))
    return out.drop("__part", "__rank", "__before", "__tie")


def sorted_keys(sample: DataFrame) -> list[tuple]:
    """The rows of a bounded sample in Spark's own order."""
    return [tuple(r) for r in sample.orderBy(*sample.columns).collect()]


def purged_kfold(items: DataFrame, folds: int, radius: int) -> DataFrame:
    """fold, position, role (eval, purged or train) of items with a position 0 .. n - 1 each. Folds with no train row are left out.

    Each fold's eval is position mod folds; what lies within radius of an eval position, and isn't one, is
    purged. That is arithmetic on the position: the nearest eval positions are the multiples around it.
    """
    n = items.agg(F.count("*").alias("__n"))
    out = items.join(F.broadcast(n)).withColumn("__k", F.least(F.lit(folds), F.col("__n").cast("int")))
    out = out.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    off = F.pmod(F.col("position") - F.col("fold"), F.col("__k"))
    below = F.col("position") - off  # the eval position at or before, if it isn't negative
    near = ((off <= radius) & (below >= 0)) | ((F.col("__k") - off <= radius) & (below + F.col("__k") < F.col("__n")))
    out = out.withColumn("role", F.when(off == 0, "eval").when(near, "purged").otherwise("train"))
    trains = F.sum((F.col("role") == "train").cast("int"))
    good = out.groupBy("fold").agg(trains.alias("__t")).filter("__t > 0").select("fold")
    return out.join(F.broadcast(good), "fold", "left_semi").drop("__n", "__k")


def last_known(rows: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with the last non-null value before each: an as-of match within one table."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: Sequence[str], tolerance: float | None = None) -> DataFrame:
    """left with the values of the last row of right at or before its time, within tolerance if given. One union, one ordered pass."""
    r = right.select(key, time, F.struct(F.col(time).alias("__t"), *values).alias("__r"), F.lit(0).alias("__side"))
    own = left.select(key, time, F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(own, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    near = F.lit(True) if tolerance is None else F.col(time) - F.col("__r.__t") <= tolerance
    return both.select("__row.*", *[F.when(near, F.col(f"__r.{v}")).alias(v) for v in values])


def core_residence(rows: DataFrame, key: str, order: str, core: str) -> DataFrame:
    """key, core, first, last, frames, exit: stays in a core, outsiders (null) counting with the core they left until another is entered.

    exit: jump (another core follows), or censored at the end; who comes back to the same core hasn't left it.
    """
    w = Window.partitionBy(key).orderBy(order)
    held = rows.withColumn("__held", F.last(core, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("__held is not null")
    stays = state_residence(held.drop(core), key, order, "__held")
    out = stays.withColumn("exit", F.when(F.col("right_censored"), "censored").otherwise("jump"))
    return out.select(key, F.col("state").alias("core"), "first", "last", F.col("n_frames").alias("frames"), "exit")


def passages(rows: DataFrame, key: str, order: str, core: str) -> DataFrame:
    """key, left_at, from, to, entered_at, kind: each time a core is left: jump, return_excursion or right_censored_exit."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("__next", F.first(core, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = out.withColumn("__next_at", F.min(F.when(F.col(core).isNotNull(), F.col(order))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    out = out.withColumn("__after", F.lead(core).over(w)).withColumn("__more", F.lead(order).over(w))
    left = out.filter(F.col(core).isNotNull() & F.col("__more").isNotNull() & ~F.col("__after").eqNullSafe(F.col(core)))
    kind = F.when(F.col("__next").isNull(), "right_censored_exit").when(F.col("__next") == F.col(core), "return_excursion").otherwise("jump")
    return left.select(key, F.col(order).alias("left_at"), F.col(core).alias("source"), F.col("__next").alias("target"), F.col("__next_at").alias("entered_at"), kind.alias("kind"))


def weighted_occupancy(rows: DataFrame, state: str, weight: str) -> DataFrame:
    """state, occupancy: the share of the weight."""
    out = rows.groupBy(F.col(state).alias("state")).agg(F.sum(weight).alias("__w"))
    return out.select("state", (F.col("__w") / F.sum("__w").over(Window.partitionBy(F.lit(0)))).alias("occupancy"))


def represented_time(rows: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """weight: half the time from the frame before to the one after; at the ends half the one step there is."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.col(time) - F.lag(time).over(w), F.lit(0.0))
    after = F.coalesce(F.lead(time).over(w) - F.col(time), F.lit(0.0))
    return rows.withColumn("weight", (before + after) / 2)


def hysteresis(rows: DataFrame, key: Sequence[str], order: str, distance: str, form: float, keep: float) -> DataFrame:
    """bonded: a contact forms below form and breaks at or above keep (keep >= form); between them it stays as it was, at first apart."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col(distance) < form, True).when(F.col(distance) >= keep, False)
    return rows.withColumn("__sign", sign).withColumn("bonded", F.coalesce(F.last("__sign", ignorenulls=True).over(w), F.lit(False))).drop("__sign")
