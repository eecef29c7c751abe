"""Selecting candidates that cover weighted witnesses: greedy order, its state, repair by swaps, reports.

covers: family, witness, candidate; weights: family, witness, w; units: candidate, unit; obligations:
obligation, candidate, minimum (so many of its candidates are to be selected).

A selection's picks depend on each other, but every measure of a candidate only falls while others are
picked. So what a candidate was worth before bounds what it is worth now: a round works out all candidates'
worth by aggregates over the distributed edges, brings the edges of the best ones (a pool of at most
pool_edges edges, or one candidate) to the driver, and picks there as long as the best of the pool beats the
bound of all others. A problem of up to pool_edges edges takes one round. Worths are compared to nine decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.durable import discard, kept

PLACES = 9
REASONS = ("obligation", "worst_family", "representative")


def multiplicity(covers: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, witness, n: how many chosen candidates (candidate) cover a witness; those that none covers are left out."""
    own = covers.join(chosen.select("candidate").distinct(), "candidate", "left_semi").distinct()
    return own.groupBy("family", "witness").agg(F.count("*").alias("n"))


def selected(chosen: DataFrame, more: DataFrame) -> DataFrame:
    """The chosen candidates with more of them; none counts twice."""
    return chosen.select("candidate").unionByName(more.select("candidate")).distinct()


def deselected(chosen: DataFrame, gone: DataFrame) -> DataFrame:
    return chosen.select("candidate").distinct().join(gone.select("candidate"), "candidate", "left_anti")


def selection_state(covers: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, mass, share, utility of a selection, replayed from its members alone: covered weight, its share, and the sum of w times the harmonic number of its covers."""
    n = multiplicity(covers, chosen)
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("bigint"), "n"), F.lit(0.0), lambda acc, k: acc + 1 / k)
    each = weights.join(n, ["family", "witness"], "left")
    out = each.groupBy("family").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("w")).otherwise(F.lit(0.0))).alias("mass"), F.sum("w").alias("total"), F.sum(F.when(F.col("n").isNotNull(), F.col("w") * harmonic).otherwise(F.lit(0.0))).alias("utility")
    )
    return out.select("family", "mass", (F.col("mass") / F.col("total")).alias("share"), "utility")


def obligation_report(obligations: DataFrame, chosen: DataFrame) -> DataFrame:
    """obligation, minimum, capacity (candidates it has), selected, deficit, feasible."""
    picks = chosen.select("candidate").distinct().withColumn("__in", F.lit(1))
    each = obligations.select("obligation", "candidate", "minimum").distinct().join(picks, "candidate", "left")
    out = each.groupBy("obligation").agg(F.max("minimum").alias("minimum"), F.count_distinct("candidate").alias("capacity"), F.count("__in").alias("selected"))
    return out.withColumns({"deficit": F.greatest(F.col("minimum") - F.col("selected"), F.lit(0)), "feasible": F.col("capacity") >= F.col("minimum")})


def hard_safe(obligations: DataFrame, chosen: DataFrame) -> DataFrame:
    """candidate, safe of each chosen candidate: whether its removal leaves no obligation shorter of its minimum than it is."""
    picks = chosen.select("candidate").distinct()
    need = obligation_report(obligations, picks).select("obligation", (F.col("selected") <= F.col("minimum")).alias("tight"))
    of = obligations.select("obligation", "candidate").distinct().join(need, "obligation").groupBy("candidate").agg(F.bool_or("tight").alias("tight"))
    return picks.join(of, "candidate", "left").select("candidate", (~F.coalesce("tight", F.lit(False))).alias("safe"))


def csr_gather(matrix: DataFrame, wanted: DataFrame, most: int = 256) -> DataFrame:
    """place, row, k, column: the columns of the wanted rows (place, row), in order of the row's array. matrix: row, columns (array).

    A row that over most places want is copied, once for about so many of them, so that its places are dealt over
    tasks. There are under one in most of the places of such rows; they are broadcast by name and number of copies.
    Places are dealt by number: they are few bytes beside what is made of them, so that by size they would go to a task or two.
    """
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(wanted.groupBy("row").agg(F.ceil(F.count("*") / most).cast("int").alias("__copies")).filter("__copies > 1"))
    copies = F.coalesce("__copies", F.lit(1))
    own = wanted.join(hot, "row", "left").withColumn("__copy", F.pmod(F.xxhash64("place"), copies).cast("int"))
    rows = matrix.join(hot, "row", "left").withColumn("__copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__copies")
    own, rows = own.repartition(tasks, "row", "__copy"), rows.repartition(tasks, "row", "__copy")
    return own.join(rows, ["row", "__copy"]).select("place", "row", F.posexplode("columns").alias("k", "column"))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each of a column's values."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Pool:
    """The edges of some candidates, with worths that follow every pick. edges: family (a place among families), witness, candidate, w, n, as columns, never as rows of objects."""

    def __init__(self, edges: pa.Table, ids: np.ndarray, families: list, obligations: pd.DataFrame, units: dict) -> None:
        self.ids, self.families = ids, families
        family = edges["family"].to_numpy().astype(np.int64)
        self.c = np.searchsorted(ids, edges["candidate"].to_numpy())
        _, self.x = np.unique(_codes(edges["witness"]) * max(len(families), 1) + family, return_inverse=True)
        self.x = self.x.ravel()
        cells = self.x.max() + 1 if len(self.x) else 0
        self.w, self.f, self.hits = np.zeros(cells), np.zeros(cells, int), np.zeros(cells, np.int64)
        self.w[self.x], self.f[self.x], self.hits[self.x] = edges["w"].to_numpy(), family, edges["n"].to_numpy()
        by = np.argsort(self.c, kind="stable")
        self.cell_of, self.at_c = self.x[by], np.searchsorted(self.c[by], np.arange(len(ids) + 1))
        by = np.argsort(self.x, kind="stable")
        self.cand_of, self.at_x = self.c[by], np.searchsorted(self.x[by], np.arange(cells + 1))
        shape = (len(families), len(ids))
        n, w = self.hits[self.x], self.w[self.x]
        self.fresh, self.thin, self.degree = np.zeros(shape), np.zeros(shape), np.zeros(shape)
        np.add.at(self.fresh, (family, self.c), np.where(n == 0, w, 0.0))
        np.add.at(self.thin, (family, self.c), 1 / (n + 1))
        np.add.at(self.degree, (family, self.c), 1.0)
        self.spread = np.bincount(self.c, w / (n + 1), len(ids))
        self.unit = [units.get(int(i)) for i in ids]
        self.left = np.ones(len(ids), bool)
        self.duties: list[list] = [[] for _ in ids]
        for i, o in zip(np.searchsorted(ids, obligations["candidate"].to_numpy()), obligations["obligation"]):
            self.duties[i].append(o)

    def diversity(self, own: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(self.degree[:, own] > 0, self.thin[:, own] / self.degree[:, own], 0.0).sum(axis=0)
        return mean / np.maximum((self.degree[:, own] > 0).sum(axis=0), 1)

    def take(self, i: int) -> None:
        """Follows a pick: only who shares its witnesses changes."""
        for cell in self.cell_of[self.at_c[i] : self.at_c[i + 1]]:
            others, f, n = self.cand_of[self.at_x[cell] : self.at_x[cell + 1]], self.f[cell], self.hits[cell]
            if not n:
                self.fresh[f, others] -= self.w[cell]
            self.spread[others] += self.w[cell] / (n + 2) - self.w[cell] / (n + 1)
            self.thin[f, others] += 1 / (n + 2) - 1 / (n + 1)
            self.hits[cell] += 1
        self.left[i] = False


def _key(values: Sequence[float]) -> tuple:
    return tuple(round(float(v), PLACES) + 0.0 for v in values)


class Picker:
    """What the driver keeps of a selection: picks, masses, counts of units and obligations."""

    def __init__(self, families: list, totals: np.ndarray, threshold: float, minimum: dict) -> None:
        self.families, self.totals, self.threshold, self.minimum = families, totals, threshold, minimum
        self.mass, self.used, self.met = np.zeros(len(families)), {}, dict.fromkeys(minimum, 0)
        self.picks: list[tuple[int, str]] = []

    def unmet(self) -> set:
        return {o for o, n in self.met.items() if n < self.minimum[o]}

    def covering(self) -> bool:
        return bool(self.unmet()) or bool((self.mass < self.threshold * self.totals - 1e-12).any())

    def worst(self) -> int:
        return int(np.argmin(np.round(self.mass / self.totals, PLACES))) if len(self.totals) else 0

    def best(self, pool: Pool) -> tuple[int, tuple, str] | None:
        """(place in the pool, key, reason) of the best candidate left; the key is what the bounds are compared with."""
        own = np.flatnonzero(pool.left)
        if not len(own):
            return None
        used = lambda at: -np.array([self.used.get(pool.unit[i], 0) for i in at], float)
        measures: list[Callable] = [lambda at: pool.spread[at], used, pool.diversity]
        hard, reason = np.zeros(len(pool.ids)), REASONS[2]
        if self.covering():
            unmet, b = self.unmet(), self.worst()
            if unmet:
                hard = np.array([sum(o in unmet for o in d) for d in pool.duties], float)
            measures = [lambda at: hard[at], lambda at: pool.fresh[b, at], lambda at: pool.fresh[:, at].sum(axis=0), used, lambda at: pool.spread[at], pool.diversity]
        key = []
        for measure in measures:
            v = np.round(measure(own), PLACES)
            key.append(v.max())
            own = own[v == v.max()]
        best = int(own[0])
        if self.covering():
            reason = REASONS[0] if hard[best] else REASONS[1]
        return best, _key([*key, -pool.ids[best]]), reason

    def note(self, pool: Pool, i: int, reason: str) -> None:
        for cell in pool.cell_of[pool.at_c[i] : pool.at_c[i + 1]]:
            if not pool.hits[cell]:
                self.mass[pool.f[cell]] += pool.w[cell]
        for o in pool.duties[i]:
            self.met[o] = self.met.get(o, 0) + 1
        if pool.unit[i] is not None:
            self.used[pool.unit[i]] = self.used.get(pool.unit[i], 0) + 1
        self.picks.append((int(pool.ids[i]), reason))


def _worths(edges: DataFrame, hits: DataFrame, families: list, duties: DataFrame, unmet: list, units: DataFrame, used: dict, picks: list) -> DataFrame:
    """candidate, hard, fresh (by family), total, used (negative), spread, diversity, edges: a row each candidate that isn't picked."""
    spark = edges.sparkSession
    n = F.coalesce("n", F.lit(0))
    fresh = F.when(F.col("n").isNull(), F.col("w")).otherwise(F.lit(0.0))
    per = edges.join(hits, ["family", "witness"], "left").groupBy("candidate", "family").agg(
        F.sum(fresh).alias("fresh"), F.sum(F.col("w") / (n + 1)).alias("spread"), F.avg(1 / (n + 1)).alias("thin"), F.count("*").alias("edges")
    )
    named = F.map_from_entries(F.collect_list(F.struct(F.col("family").cast("string"), "fresh")))
    out = per.groupBy("candidate").agg(named.alias("__m"), F.sum("fresh").alias("total"), F.sum("spread").alias("spread"), F.avg("thin").alias("diversity"), F.sum("edges").alias("edges"))
    out = out.withColumn("fresh", F.array(*[F.coalesce(F.try_element_at("__m", F.lit(str(f))), F.lit(0.0)) for f in families])).drop("__m")
    open_ = spark.createDataFrame([(o,) for o in unmet], duties.select("obligation").schema)
    hard = duties.join(open_, "obligation", "left_semi").groupBy("candidate").agg(F.count("*").cast("double").alias("hard"))
    counts = spark.createDataFrame([(u, -float(k)) for u, k in used.items()], f"unit {dict(units.dtypes)['unit']}, used double")
    usage = units.join(counts, "unit").select("candidate", "used")
    gone = spark.createDataFrame([(p,) for p in picks], f"candidate {dict(edges.dtypes)['candidate']}")
    out = out.join(gone, "candidate", "left_anti").join(hard, "candidate", "left").join(usage, "candidate", "left")
    return out.withColumns({"hard": F.coalesce("hard", F.lit(0.0)), "used": F.coalesce("used", F.lit(0.0))})


def _orders(families: list) -> list[list[str]]:
    """The measures of each order: one for each family as the worst, then that of the fill."""
    cover = [["hard", f"fresh[{b}]", "total", "used", "spread", "diversity"] for b in range(len(families))]
    return [*cover, ["spread", "used", "diversity"]]


def greedy_coverage(
    covers: DataFrame, weights: DataFrame, units: DataFrame, k: int, threshold: float = 0.95, obligations: DataFrame | None = None, prefix: Sequence[int] = (), pool_edges: int = 1_000_000
) -> DataFrame:
    """rank, candidate, reason of up to k picks.

    While an obligation is unmet or a family is under the threshold, a pick serves the most unmet
    obligations, then has the largest uncovered weight in the family with the smallest share, then over all
    families, then the unit picked least, then the largest sum of w / (n + 1) over its witnesses, then the
    largest mean of 1 / (n + 1), then the smallest id. Beyond it the sum, unit, mean and id decide, in this order.
    prefix: candidates that are picked already, in their order (a selection that goes on); ranks follow theirs.
    """
    spark = covers.sparkSession
    edges = kept(covers.select("family", "witness", "candidate").distinct().join(weights, ["family", "witness"]))
    per = sorted(tuple(r) for r in edges.select("family", "witness", "w").distinct().groupBy(F.col("family").cast("string")).agg(F.sum("w")).collect())
    families, totals = [f for f, _ in per], np.array([t for _, t in per], float)
    kind = dict(edges.dtypes)["candidate"]
    if obligations is None:
        obligations = spark.createDataFrame([], f"obligation bigint, candidate {kind}, minimum int")
    duties = obligations.select("obligation", "candidate").distinct().join(edges.select("candidate").distinct(), "candidate", "left_semi")
    minimum = {r[0]: int(r[1]) for r in obligations.groupBy("obligation").agg(F.max("minimum")).collect()}
    picker = Picker(families, totals, threshold, minimum)
    hits = kept(edges.select("family", "witness").limit(0).withColumn("n", F.lit(0).cast("bigint")))
    asked, size = list(prefix), edges.count()

    def pooled(ids: list[int] | None) -> Pool:
        own, mine, of = edges, duties, units.select("candidate", "unit")
        if ids is not None:
            some = F.broadcast(spark.createDataFrame([(i,) for i in ids], f"candidate {kind}"))
            own, mine, of = (df.join(some, "candidate", "left_semi") for df in (edges, duties, of))
        place = (F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family").cast("string")) - 1).cast("int")
        rows = own.join(hits, ["family", "witness"], "left").select(place.alias("family"), "witness", F.col("candidate").cast("bigint").alias("candidate"), F.col("w").cast("double").alias("w"), F.coalesce("n", F.lit(0)).alias("n")).toArrow()
        named = np.unique(rows["candidate"].to_numpy()) if ids is None else np.array(sorted(ids), np.int64)
        return Pool(rows, named, families, mine.toPandas(), dict(zip(*(c.to_pylist() for c in of.toArrow().columns))))

    def advanced(new: list[int]) -> DataFrame:
        """hits with the picks' witnesses."""
        some = F.broadcast(spark.createDataFrame([(i,) for i in new], f"candidate {kind}"))
        more = edges.join(some, "candidate", "left_semi").groupBy("family", "witness").agg(F.count("*").alias("n"))
        out = kept(hits.unionByName(more).groupBy("family", "witness").agg(F.sum("n").alias("n")))
        discard(hits)
        return out

    while asked and size > pool_edges:
        # replay what is picked already, a pool's worth at a time
        part, asked = asked[:64], asked[64:]
        pool = pooled(part)
        for c in part:
            i = int(np.searchsorted(pool.ids, c))
            picker.note(pool, i, "given")
            pool.take(i)
        hits = advanced(part)
    done = len(prefix)
    while len(picker.picks) < done + k:
        picks = [c for c, _ in picker.picks]
        bounds: list[tuple | None] = []
        if size <= pool_edges:
            pool = pooled(None)
            for c in asked:
                i = int(np.searchsorted(pool.ids, c))
                picker.note(pool, i, "given")
                pool.take(i)
            bounds = [None] * (len(families) + 1)
        else:
            worth = kept(_worths(edges, hits, families, duties, sorted(picker.unmet()), units, picker.used, picks))
            ids: dict[int, None] = {}
            share = pool_edges / (len(families) + 1)
            tops = []
            for order in _orders(families):
                down = [F.round(F.expr(m), PLACES).desc() for m in order]
                tops.append([tuple(r) for r in worth.orderBy(*down, "candidate").limit(4096).select("candidate", "edges", *[F.expr(m) for m in order]).collect()])
            for rows in tops:
                held, bound = 0, None
                for c, n, *values in rows:
                    if held and held + n > share:
                        bound = _key([*values, -c])
                        break
                    held += n
                    ids[int(c)] = None
                else:
                    if len(rows) == 4096:
                        c, _, *values = rows[-1]
                        del ids[int(c)]
                        bound = _key([*values, -c])
                bounds.append(bound)
            discard(worth)
            if not ids:
                break
            pool = pooled(list(ids))
        before = len(picker.picks)
        while len(picker.picks) < done + k:
            found = picker.best(pool)
            if found is None:
                break
            bound = bounds[picker.worst() if picker.covering() else len(families)]
            if bound is not None and found[1] < bound:
                break
            picker.note(pool, found[0], found[2])
            pool.take(found[0])
        new = [c for c, _ in picker.picks[before:]]
        if not new or all(b is None for b in bounds):
            break
        hits = advanced(new)
    discard(edges, hits)
    rows = [(r, c, reason) for r, (c, reason) in enumerate(picker.picks) if r >= done]
    return spark.createDataFrame(rows, f"rank int, candidate {kind}, reason string")


def lazy_greedy(covers: DataFrame, weights: DataFrame, k: int, pool_edges: int = 1_000_000) -> DataFrame:
    """rank, candidate, gain of a plain greedy cover by uncovered weight, ties to the smaller id, by the same certified rounds."""
    spark = covers.sparkSession
    edges = kept(covers.select("family", "witness", "candidate").distinct().join(weights, ["family", "witness"]))
    kind, out, left = dict(edges.dtypes)["candidate"], [], edges
    while len(out) < k:
        gains = left.groupBy("candidate").agg(F.round(F.sum("w"), PLACES).alias("gain"), F.count("*").alias("edges"))
        top = [tuple(r) for r in gains.orderBy(F.desc("gain"), "candidate").limit(4096).collect()]
        held, ids, bound = 0, [], None
        for c, g, n in top:
            if held and held + n > pool_edges or len(ids) == 4095:
                bound = (g, -c)
                break
            held += n
            ids.append(c)
        if not ids:
            break
        some = F.broadcast(spark.createDataFrame([(c,) for c in ids], f"candidate {kind}"))
        rows = left.join(some, "candidate", "left_semi").select("candidate", "family", "witness", F.col("w").cast("double").alias("w")).toArrow()
        _, x = np.unique(_codes(rows["witness"]) * len(rows) + _codes(rows["family"]), return_inverse=True)
        x, w = x.ravel(), rows["w"].to_numpy()
        names, c = np.unique(rows["candidate"].to_numpy(), return_inverse=True)
        open_, gain = np.ones(x.max() + 1, bool), np.bincount(c, w, len(names))
        by_x = np.argsort(x, kind="stable")
        at_x, by_c = np.searchsorted(x[by_x], np.arange(len(open_) + 1)), np.argsort(c, kind="stable")
        at_c = np.searchsorted(c[by_c], np.arange(len(names) + 1))
        free, ended = np.ones(len(names), bool), bound is None
        while len(out) < k and free.any():
            value = np.where(free, np.round(gain, PLACES), -1.0)
            i = int(value.argmax())
            if bound is not None and (value[i], -int(names[i])) < bound:
                break
            if value[i] <= 0:
                ended = True
                break
            out.append((len(out), int(names[i]), float(value[i])))
            free[i] = False
            for e in by_c[at_c[i] : at_c[i + 1]]:
                if open_[x[e]]:
                    open_[x[e]] = False
                    same = by_x[at_x[x[e]] : at_x[x[e] + 1]]
                    gain[c[same]] -= w[e]
        if ended:
            # candidates without any uncovered weight left come last, by id
            if len(out) < k:
                done = spark.createDataFrame([(p,) for _, p, _ in out], f"candidate {kind}")
                rest = edges.select("candidate").distinct().join(done, "candidate", "left_anti").orderBy("candidate").limit(k - len(out)).collect()
                out += [(len(out) + j, int(r[0]), 0.0) for j, r in enumerate(rest)]
            break
        gone = edges.join(spark.createDataFrame([(p,) for _, p, _ in out], f"candidate {kind}"), "candidate", "left_semi").select("family", "witness").distinct()
        fresh = kept(edges.join(gone, ["family", "witness"], "left_anti"))
        if left is not edges:
            discard(left)
        left = fresh
    discard(edges, *([left] if left is not edges else []))
    return spark.createDataFrame(out, f"rank int, candidate {kind}, gain double")


def repair_swaps(covers: DataFrame, weights: DataFrame, ranking: DataFrame, protected: int, obligations: DataFrame | None = None) -> DataFrame:
    """rank, candidate after swaps: members of rank >= protected give way to outsiders while the covered weight strictly grows.

    A round takes the swap that gains the most, ties to the smaller rank, then the smaller outsider; it ends
    by itself, as the weight grows with each. Members that an obligation can't spare stay. A swap gains what the
    outsider covers anew, and what only the member covered and the outsider covers too, less what only the
    member covered: two aggregates over the edges a round, of which the driver sees a row each.
    """
    spark = covers.sparkSession
    edges = kept(covers.select("family", "witness", "candidate").distinct().join(weights, ["family", "witness"]))
    kind = dict(edges.dtypes)["candidate"]
    order = [int(r["candidate"]) for r in ranking.orderBy("rank").collect()]
    while True:
        chosen = spark.createDataFrame(list(enumerate(order)), f"rank int, candidate {kind}")
        movable = chosen.filter(F.col("rank") >= protected)
        if obligations is not None:
            movable = movable.join(hard_safe(obligations, chosen).filter("safe"), "candidate", "left_semi")
        own = edges.join(F.broadcast(chosen), "candidate")
        count = own.groupBy("family", "witness").agg(F.count("*").alias("n"), F.min("rank").alias("owner"))
        outside = edges.join(F.broadcast(chosen), "candidate", "left_anti").join(count, ["family", "witness"], "left")
        sole = own.join(count.filter("n = 1").select("family", "witness"), ["family", "witness"], "left_semi")
        loss = movable.join(sole.groupBy("rank").agg(F.sum("w").alias("loss")), "rank", "left").select("rank", F.coalesce("loss", F.lit(0.0)).alias("loss"))
        # what an outsider covers anew (owner null), and of what only one member covers
        worth = outside.filter("n is null or n = 1").groupBy("candidate", F.when(F.col("n") == 1, F.col("owner")).alias("owner")).agg(F.sum("w").alias("w"))
        fresh = outside.groupBy("candidate").agg(F.sum(F.when(F.col("n").isNull(), F.col("w")).otherwise(F.lit(0.0))).alias("fresh"))
        both = worth.filter("owner is not null").join(F.broadcast(loss), F.col("owner") == F.col("rank")).join(fresh, "candidate")
        gain = F.round(F.col("fresh") + F.col("w") - F.col("loss"), PLACES)
        best = both.agg(F.max(F.struct(gain.alias("gain"), (-F.col("rank")).alias("r"), (-F.col("candidate")).alias("c")))).first()[0]
        top = fresh.agg(F.max(F.struct(F.round("fresh", PLACES).alias("fresh"), (-F.col("candidate")).alias("c")))).first()[0]
        low = loss.agg(F.min(F.struct(F.round("loss", PLACES).alias("loss"), "rank"))).first()[0]
        options = [(best["gain"], best["r"], best["c"])] if best else []
        if top and low:
            options.append((round(top["fresh"] - low["loss"], PLACES), -low["rank"], top["c"]))
        if not options or max(options)[0] <= 0:
            discard(edges)
            return spark.createDataFrame(list(enumerate(order)), f"rank int, candidate {kind}")
        _, r, c = max(options)
        order[-r] = -c
