"""Preparing datasets: fingerprints, duplicates, groups, roles, leakage, sampling, weights and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.durable import discard, kept
from framelake.operators.islands import with_position


def geometry_fingerprint(points: DataFrame, box: tuple[float, float, float], places: int = 6) -> DataFrame:
    """frame, fingerprint: SHA-256 over the atoms' species and wrapped, rounded fractions, in atom order.

    An atom's digest is made first, so a frame's group holds 64 characters an atom.
    """
    from framelake.functions.columns import wrap_with_tolerance

    parts = [F.format_string(f"%.{places}f", F.bround(wrap_with_tolerance(F.col(a) / edge, 10.0**-places), places) + F.lit(0.0)) for a, edge in zip("xyz", box)]
    atom = points.select("frame", "atom", F.sha2(F.concat_ws(",", F.col("species").cast("string"), *parts), 256).alias("d"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("atom", "d"))), lambda s: s["d"])
    return atom.groupBy("frame").agg(F.sha2(F.concat_ws("", ordered), 256).alias("fingerprint"))


def duplicate_groups(catalog: DataFrame, fingerprint: str, run: str, uid: str, first: Column, last: Column) -> DataFrame:
    """fingerprint, n, runs, cross_source, restart, smallest uid, of groups of two and more.

    restart: the group joins the first frame of a run with the last of another.
    """
    g = catalog.withColumns({"__f": first, "__l": last}).groupBy(fingerprint).agg(
        F.count("*").alias("n"), F.count_distinct(run).alias("runs"), F.min(uid).alias("representative"), F.bool_or("__f").alias("__f"), F.bool_or("__l").alias("__l")
    )
    g = g.filter("n >= 2")
    return g.select(fingerprint, "n", "runs", (F.col("runs") > 1).alias("cross_source"), (F.col("__f") & F.col("__l") & (F.col("runs") > 1)).alias("restart"), "representative")


def staged_file_groups(files: DataFrame, size: str, digest: Column, path: str) -> DataFrame:
    """size, digest, n, first: files of equal content; only those that share their size are digested."""
    alike = files.groupBy(size).agg(F.count("*").alias("__n")).filter("__n > 1").select(size)
    out = files.join(alike, size, "left_semi").withColumn("digest", digest)
    return out.groupBy(size, "digest").agg(F.count("*").alias("n"), F.min(path).alias("first")).filter("n > 1")


def connected_components(nodes: DataFrame, edges: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """node, component (its smallest node): min-label rounds over edges in both directions, with pointer jumps.

    Each round's labels are a durable table, and replace the round's before. The number of rounds grows with
    the logarithm of a chain's length. Labels and edges stay distributed.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = kept(both.unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).filter("u <> v").distinct())
    held = kept(nodes.select(F.col(node).alias("u"), F.col(node).alias("label")))
    labels = held.select("u", "label")
    while True:
        low = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        step = labels.join(low, "u", "left").select("u", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = labels.select(F.col("u").alias("label"), F.col("label").alias("up"))
        fresh = kept(step.join(jump, "label", "left").select("u", "old", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = fresh.filter("label <> old").limit(1).count()
        discard(held)
        held, labels = fresh, fresh.select("u", "label")
        if not moved:
            discard(both)
            return labels.select(F.col("u").alias(node), F.col("label").alias("component"))


def leakage_findings(units: DataFrame, catalog: DataFrame, windows: DataFrame, fingerprint: str) -> DataFrame:
    """code, subject, roles: what crosses incompatible roles; one "pass" row if nothing does.

    units: uid, role; catalog: uid and the fingerprint; windows: event, uid (protected together).
    """
    roles = ["development", "monitor", "calibration", "locked"]
    placed = units.filter(F.col("role").isin(roles))
    names = F.concat_ws(",", F.array_sort(F.collect_set("role")))
    crossing = lambda df, key, code: (
        df.groupBy(key).agg(F.count_distinct("role").alias("__n"), names.alias("roles")).filter("__n > 1").select(F.lit(code).alias("code"), F.col(key).cast("string").alias("subject"), "roles")
    )
    copies = crossing(catalog.join(placed, "uid"), fingerprint, "duplicate_crosses_roles")
    split = crossing(windows.join(placed, "uid"), "event", "window_split")
    missing = catalog.join(units, "uid", "left_anti").select(F.lit("unclassified").alias("code"), F.col("uid").cast("string").alias("subject"), F.lit("").alias("roles"))
    found = copies.unionByName(split).unionByName(missing)
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("pass").alias("code"), F.lit("").alias("subject"), F.lit("").alias("roles"))
    return found.unionByName(none)


def missing_purge(units: DataFrame, radius: int) -> DataFrame:
    """run, position of units within radius of a protected unit of their run that are neither protected nor purged."""
    near = units.filter(F.col("role").isin("monitor", "calibration", "locked"))
    near = near.select("run", F.explode(F.sequence(F.col("position") - radius, F.col("position") + radius)).alias("position")).distinct()
    rest = units.filter(~F.col("role").isin("monitor", "calibration", "locked", "purged"))
    return rest.join(near, ["run", "position"], "left_semi").select("run", "position")


def hash_fraction(seed: int, name: Column) -> Column:
    """(the first 8 bytes of SHA-256 of seed, NUL, name, as an integer, plus a half) over 2^64."""
    digest = F.sha2(F.concat(F.lit(f"{seed}\0"), name), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") + 0.5) / float(1 << 64)


def balanced_quotas(strata: DataFrame, key: str, size: str, requested: int, seed: int) -> DataFrame:
    """key, size, quota: equal allocation within sizes; the remainder goes in the order of a hash of the key.

    Water-filling: with strata sorted by size, the level at which full passes end follows from running
    sums; one row a stratum, so one task takes them.
    """
    every = Window.partitionBy(F.lit(0))
    by_size = every.orderBy(size, key)
    s = strata.withColumn("__i", F.row_number().over(by_size)).withColumn("__n", F.count("*").over(every))
    s = s.withColumn("__before", F.coalesce(F.sum(size).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    target = F.least(F.lit(requested).cast("bigint"), F.sum(size).over(every))
    # the largest level such that all strata filled to it stay within the target
    s = s.withColumn("__target", target).withColumn("__level", F.expr("(__target - __before) div (__n - __i + 1)"))
    s = s.withColumn("__fits", F.col("__level") < F.col(size))
    first = F.min(F.when(F.col("__fits"), F.struct(F.col("__i"), F.col("__level").alias("level")))).over(every)
    level = F.coalesce(first["level"], F.max(size).over(every))
    s = s.withColumn("__level", level).withColumn("__base", F.least(F.col(size), F.col("__level")))
    s = s.withColumn("__rest", F.col("__target") - F.sum("__base").over(every))
    mark = F.sha2(F.concat(F.lit(f"{seed}\0quota\0"), F.col(key).cast("string")), 256)
    open_ = F.col(size) > F.col("__base")
    s = s.withColumn("__place", F.sum(open_.cast("int")).over(every.orderBy(mark, key).rowsBetween(Window.unboundedPreceding, 0)))
    extra = F.when(open_ & (F.col("__place") <= F.col("__rest")), 1).otherwise(0)
    return s.select(key, size, (F.col("__base") + extra).cast("bigint").alias("quota"))


def systematic_sample(rows: DataFrame, key: str, order: Sequence[str], quotas: DataFrame, size: str, seed: int) -> DataFrame:
    """rows at positions floor((i + u) n / k) of their stratum, u from a hash of the stratum's key."""
    name = F.concat(F.lit("target:"), F.col(key).cast("string"))
    wanted = quotas.filter("quota > 0").withColumn("__u", F.when(F.col("quota") == F.col(size), F.lit(0.0)).otherwise(hash_fraction(seed, name)))
    wanted = wanted.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("quota") - 1)))
    at = F.least(F.col(size) - 1, F.floor((F.col("__i") + F.col("__u")) * F.col(size) / F.col("quota")))
    wanted = wanted.select(key, at.cast("bigint").alias("position"))
    return with_position(rows, order, [key]).join(wanted, [key, "position"], "left_semi")


def configuration_weights(rows: DataFrame, condition: str, uid: str, anchor: Column, protected: Column, degraded: Column, anchor_x: float = 2.0, protected_x: float = 1.5, degraded_x: float = 0.5) -> DataFrame:
    """uid, weight: one over the condition's count, times the multipliers, with mean one."""
    counts = rows.groupBy(condition).agg(F.count("*").alias("__n"))
    raw = rows.join(counts, condition).withColumn("__w", 1 / F.col("__n"))
    raw = raw.withColumn("__w", F.col("__w") * F.when(anchor, anchor_x).when(protected, protected_x).otherwise(1.0) * F.when(degraded, degraded_x).otherwise(1.0))
    mean = raw.agg(F.avg("__w").alias("__m"))
    return raw.join(F.broadcast(mean)).select(uid, (F.col("__w") / F.col("__m")).alias("weight"))


def clipped_weights(weights: DataFrame, lo: float, hi: float, rounds: int = 32) -> DataFrame:
    """weights within [lo, hi] with mean one: what clipping takes goes to the others alike, until none is left over.

    All weights that aren't clipped shift by the same amount, so a round is one aggregate, and only the
    shift is carried along.
    """
    shift = 0.0
    for _ in range(rounds):
        w = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("weight") + shift))
        free = ((w > lo + 1e-14) & (w < hi - 1e-14)).cast("int")
        mean, open_, n = weights.agg(F.avg(w), F.sum(free), F.count("*")).first()
        if not n or abs(1 - mean) <= 1e-12:
            break
        if not open_:
            raise ValueError("the bounds can't keep a mean of one")
        shift += (1 - mean) * n / open_
    return weights.withColumn("weight", F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("weight") + shift)))


def select_representative(rows: DataFrame, key: str, admissible: Column, order: Sequence[str]) -> DataFrame:
    """key and the fields of order of its least admissible row; null where none is."""
    best = F.min(F.when(admissible, F.struct(*order)))
    return rows.groupBy(key).agg(best.alias("b")).select(key, *[F.col(f"b.{c}").alias(c) for c in order])


def fold_acceptance(folds: DataFrame, campaign: str, metric: str, threshold: float) -> DataFrame:
    """campaign, folds, accepted, verdict: accepted only if all folds are within the threshold."""
    good = F.col(metric) <= threshold
    out = folds.groupBy(campaign).agg(F.count("*").alias("folds"), F.sum(good.cast("bigint")).alias("accepted"))
    return out.withColumn("verdict", F.when(F.col("accepted") == F.col("folds"), "accepted").when(F.col("accepted") == 0, "rejected").otherwise("mixed"))


def merged_obligations(rows: DataFrame, locus: str, incidence: str, minimum: str) -> DataFrame:
    """locus, incidence, minimum: equal loci with one incidence merge to the larger minimum; a locus with several is a conflict."""
    out = rows.groupBy(locus).agg(F.min(incidence).alias("incidence"), F.max(minimum).alias("minimum"), F.count_distinct(incidence).alias("__n"))
    return out.select(locus, "incidence", "minimum", (F.col("__n") > 1).alias("conflict"))


def covered_mass(covers: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, mass, total, share: the weight of the witnesses that a chosen candidate covers."""
    hit = covers.join(chosen.select("candidate"), "candidate", "left_semi").select("family", "witness").distinct().withColumn("__hit", F.lit(1))
    out = weights.join(hit, ["family", "witness"], "left")
    out = out.groupBy("family").agg(F.sum(F.when(F.col("__hit") == 1, F.col("w")).otherwise(F.lit(0.0))).alias("mass"), F.sum("w").alias("total"))
    return out.withColumn("share", F.col("mass") / F.col("total"))


def qualify_prefixes(covers: DataFrame, weights: DataFrame, ranking: DataFrame, sizes: Sequence[int], threshold: float) -> DataFrame:
    """size, family, share, qualified of nested prefixes of a ranking (rank from 0): a witness counts from the first rank that covers it."""
    first = covers.join(ranking, "candidate").groupBy("family", "witness").agg(F.min("rank").alias("at"))
    own = weights.join(first, ["family", "witness"], "left")
    sums = [F.sum(F.when(F.col("at") < k, F.col("w")).otherwise(F.lit(0.0))).alias(f"m{k}") for k in sizes]
    per = own.groupBy("family").agg(F.sum("w").alias("total"), *sums)
    out = per.select("family", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), F.col(f"m{k}").alias("mass")) for k in sizes])).alias("e"))
    return out.select(F.col("e.size").alias("size"), "family", (F.col("e.mass") / F.col("total")).alias("share"), (F.col("e.mass") / F.col("total") >= threshold).alias("qualified"))


def required_rework(before: DataFrame, after: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, rework: new, removed, the first field (in order of depth) that differs, or none."""
    a = before.select(key, *[F.col(f).alias(f"a_{f}") for f in fields], F.lit(1).alias("__a"))
    b = after.select(key, *[F.col(f).alias(f"b_{f}") for f in fields], F.lit(1).alias("__b"))
    what = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "removed")
    for f in fields:
        what = what.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), f)
    return a.join(b, key, "full_outer").select(key, what.otherwise("none").alias("rework"))


def outer_roles(units: DataFrame, condition: str, order: Sequence[str], cycle: int = 10, purge: int = 1) -> DataFrame:
    """units with position (in their condition) and role: of every cycle one monitor, one calibration and one locked unit.

    They stand apart by a third of the cycle; units within purge of one of them are purged, the rest
    develops. A condition of under a cycle's units develops as a whole.
    """
    placed = with_position(units, order, [condition])
    size = F.count("*").over(Window.partitionBy(condition))
    third = cycle // 3
    at = F.col("position") % cycle
    marks = {"monitor": third // 2, "calibration": third // 2 + third, "locked": third // 2 + 2 * third}
    role = None
    for name, m in marks.items():
        role = F.when(at == m, name) if role is None else role.when(at == m, name)
    near = sum((F.when(F.abs(at - m) <= purge, 1).otherwise(0) for m in marks.values()), F.lit(0)) > 0
    placed = placed.withColumn("__n", size)
    return placed.withColumn("role", F.when(F.col("__n") < cycle, "development").otherwise(role.when(near, "purged").otherwise("development"))).drop("__n")


def family_support(covers: DataFrame) -> DataFrame:
    """family, witnesses, least, median, most: how many candidates cover a witness."""
    per = covers.groupBy("family", "witness").agg(F.count_distinct("candidate").alias("d"))
    return per.groupBy("family").agg(F.count("*").alias("witnesses"), F.min("d").alias("least"), F.percentile("d", 0.5).alias("median"), F.max("d").alias("most"))


def representative_utility(covers: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """family, utility: the sum over witnesses of weight times the harmonic number of their chosen covers."""
    n = covers.join(chosen.select("candidate"), "candidate", "left_semi").groupBy("family", "witness").agg(F.count_distinct("candidate").alias("n"))
    harmonic = F.aggregate(F.sequence(F.lit(1).cast("bigint"), "n"), F.lit(0.0), lambda acc, k: acc + 1 / k)
    return n.join(weights, ["family", "witness"]).withColumn("u", F.col("w") * harmonic).groupBy("family").agg(F.sum("u").alias("utility"))


def removal_loss(covers: DataFrame, weights: DataFrame, chosen: DataFrame) -> DataFrame:
    """candidate, lost_mass, lost_utility of taking each chosen candidate out: what only it covers, and its share of the harmonic sums."""
    own = covers.join(chosen.select("candidate"), "candidate", "left_semi").distinct()
    n = own.groupBy("family", "witness").agg(F.count("*").alias("n")).join(weights, ["family", "witness"])
    both = own.join(n, ["family", "witness"])
    return both.groupBy("candidate").agg(F.sum(F.when(F.col("n") == 1, F.col("w")).otherwise(F.lit(0.0))).alias("lost_mass"), F.sum(F.col("w") / F.col("n")).alias("lost_utility"))


def top_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """rows with rank from 1: the first k of each key's rows in the order. Spark keeps k rows a key and task before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def first_rows(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in the order: each task's first k, then those of all."""
    return rows.orderBy(*order).limit(k)


def run_spread_sample(rows: DataFrame, run: str, order: Sequence[str], requested: int, seed: int) -> DataFrame:
    """About as many rows from each run, evenly spread over its order."""
    sizes = rows.groupBy(run).agg(F.count("*").alias("__size"))
    quotas = balanced_quotas(sizes, run, "__size", requested, seed)
    return systematic_sample(rows, run, order, quotas, "__size", seed)


def label_domains(rows: DataFrame, uid: str, core: Sequence[str]) -> DataFrame:
    """domain (a digest of the core fields), n, first uid: rows that may be learned from together. No pair is compared."""
    from framelake.functions.columns import canonical_digest

    return rows.groupBy(canonical_digest(*[F.col(c) for c in core]).alias("domain")).agg(F.count("*").alias("n"), F.min(uid).alias("first"))


def compare_labels(rows: DataFrame, a: str, b: str, core: Sequence[str], soft: Sequence[str]) -> DataFrame:
    """rows with outcome of two label structs: identical, compatible (only soft fields differ) or incompatible."""
    same = lambda names: sum((F.when(F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")), 0).otherwise(1) for n in names), F.lit(0)) == 0
    return rows.withColumn("outcome", F.when(~same(core), "incompatible").when(same(soft), "identical").otherwise("compatible"))


def state_catalog(edges: DataFrame, frame: str, parts: Sequence[str]) -> DataFrame:
    """frame, state: states are numbered by the first frame that has their set of edges. A frame's set is digested, not carried."""
    digest = edges.groupBy(frame).agg(F.sha2(F.concat_ws(";", F.array_sort(F.collect_set(F.concat_ws(",", *parts)))), 256).alias("__d"))
    first = digest.groupBy("__d").agg(F.min(frame).alias("__f"))
    named = with_position(first, ["__f"]).select("__d", F.col("position").alias("state"))
    return digest.join(named, "__d").select(frame, "state")
