"""Second-tier operators: kernels by hand, registered functions, symmetric nets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import registration as R
from framelake.operators import graphs as G
from framelake.operators import normalize as N
from framelake.operators import pairs as P
from framelake.operators import selection as S
from framelake.operators import stats as T

CUBE = (10.0, 10.0, 10.0)
CUBIC = [(0, 0, (1, 0, 0)), (0, 0, (0, 1, 0)), (0, 0, (0, 0, 1))]
DIAMOND = [(0, 1, (0, 0, 0)), (0, 1, (1, 0, 0)), (0, 1, (0, 1, 0)), (0, 1, (0, 0, 1))]


def test_registered_functions(spark):
    R.register(spark)
    assert [r.lag for r in spark.sql("SELECT * FROM lag_grid(5, 2)").collect()] == [0, 1, 2]
    assert spark.sql("SELECT j0(0D) AS a, j0(2.404825557695773D) AS b").first()[:] == pytest.approx((1.0, 0.0), abs=1e-9)
    assert spark.sql("SELECT correlation_time(cast(id % 2 AS double)) AS t FROM range(100)").first().t >= 0.5
    x = np.array([5.0, 39.0, 45.0, 100.0])
    grid = (np.arange(20_000) + 0.5) * np.pi / 20_000
    assert R.bessel_j0(x) == pytest.approx(np.cos(x[:, None] * np.sin(grid)).mean(axis=1), abs=2e-7)


def test_ring_plane_across_the_box(spark):
    pts = spark.createDataFrame([(0, k, 0, x, y, 3.0) for k, (x, y) in enumerate([(9.5, 1.0), (0.5, 1.0), (0.5, 2.0), (9.5, 2.0)])], "frame bigint, atom bigint, species int, x double, y double, z double")
    rings = spark.createDataFrame([(7, k, k) for k in range(4)], "ring bigint, atom bigint, place bigint")
    r = P.ring_planes(pts, rings, CUBE).first()
    assert (r.cx, r.cy, r.cz, abs(r.nz), r.flatness) == pytest.approx((10.0, 1.5, 3.0, 1.0, 0.0), abs=1e-9)


def test_ring_plane_of_members_on_a_line(spark, tmp_path):
    """Two members have no plane of their own; the normal is that of the query's SQL, down to its rounding."""
    import duckdb

    from framelake.registry import ORACLE_SQL, QUERIES

    rng = np.random.default_rng(4)
    rows = [(k, 0, [float(x) for x in rng.normal(size=8).astype("float32")]) for k in range(24 * 3 + 9)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    names = ["frame", "ring", "cx", "cy", "cz", "nx", "ny", "nz", "flatness"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL['ring_planes']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["ring_planes"](spark, str(tmp_path)).select(*names).collect())
    assert np.array(got) == pytest.approx(np.array(want), abs=1e-9, nan_ok=True)


def test_rebuilds(spark):
    rows = [(k, f, 0, 0.2 * (k + 1) * f, 0.0, 0.0) for k in range(2) for f in range(6)]
    pts = spark.createDataFrame(rows, "run bigint, frame bigint, atom bigint, x double, y double, z double")
    got = P.rebuild_frames(pts, CUBE, 0.7).orderBy("run", "frame").collect()
    assert [r.rebuilt for r in got] == [True, False, True, False, True, False, True, True, True, True, True, True]


def test_nets_with_known_symmetry():
    assert G.automorphisms(CUBIC) == 48 and G.automorphisms(DIAMOND) == 48
    assert G.edge_contacts(CUBIC) == 0 and G.edge_contacts([*CUBIC, (0, 0, (1, 1, 0)), (0, 0, (1, -1, 0))]) > 0
    with pytest.raises(ValueError):
        G.automorphisms([(0, 1, (0, 0, 0)), (0, 2, (0, 0, 0)), *CUBIC])


def test_lazy_and_plain_greedy_agree_and_repair_improves(spark):
    rng = np.random.default_rng(0)
    edges = sorted({("f", int(w), int(c)) for w, c in rng.integers(0, [60, 15], (150, 2))})
    covers = spark.createDataFrame(edges, "family string, witness bigint, candidate bigint")
    weights = spark.createDataFrame([("f", w, float(1 + w % 4)) for w in range(60)], "family string, witness bigint, w double")
    got = [r.candidate for r in S.lazy_greedy(covers, weights, 6).orderBy("rank").collect()]
    cells = {c: {w for _, w, d in edges if d == c} for c in range(15)}
    seen, want = set(), []
    for _ in range(6):
        best = min((c for c in cells if c not in want), key=lambda c: (-sum(1 + w % 4 for w in cells[c] - seen), c))
        want.append(best)
        seen |= cells[best]
    assert got == want
    mass = lambda cs: sum(1 + w % 4 for w in set().union(*[cells[c] for c in cs]))
    bad = sorted(cells, key=lambda c: (len(cells[c]), c))[:4]
    fixed = [r.candidate for r in S.repair_swaps(covers, weights, spark.createDataFrame([(c, k) for k, c in enumerate(bad)], "candidate bigint, rank int"), 1).orderBy("rank").collect()]
    assert fixed[0] == bad[0] and mass(fixed) > mass(bad)


def test_displacements_repeat_and_stay_within_reach(spark):
    pts = spark.range(50).select(F.lit(0).alias("frame"), F.col("id").alias("atom"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z"))
    a, b = (N.displace(pts, "xyz", 0.1, 5).collect() for _ in range(2))
    assert a == b and all(abs(r.x - 1) <= 0.1 and r.x != 1.0 for r in a)


def test_virial_becomes_stress(spark):
    rows = spark.createDataFrame([([2.0, 1.0, 0.0, 3.0, 4.0, 0.0, 0.0, 0.0, 6.0], 2.0)], "s array<double>, v double")
    r = T.convert_stress(rows, "s", "ev_per_a3", volume="v").first()
    assert (r.xx, r.yy, r.zz, r.xy) == (1.0, 2.0, 3.0, 1.0)


def greedy_by_hand(covers, weight, unit, duty, minimum, k, threshold):
    """The order by plain sets, from the definition."""
    families = sorted({f for f, _, _ in covers})
    cells = {}
    for f, x, c in covers:
        cells.setdefault(c, set()).add((f, x))
    total = {f: sum(w for (g, _), w in weight.items() if g == f) for f in families}
    picks, n, used, met = [], {}, {}, dict.fromkeys(minimum, 0)
    while len(picks) < k and len(picks) < len(cells):
        share = {f: sum(weight[x] for x in n if x[0] == f) / total[f] for f in families}
        unmet = {o for o in minimum if met[o] < minimum[o]}
        covering = bool(unmet) or min(share.values()) < threshold - 1e-12
        worst = min(families, key=lambda f: (round(share[f], 9), f))

        def key(c):
            new = [x for x in cells[c] if x not in n]
            spread = round(sum(weight[x] / (n.get(x, 0) + 1) for x in cells[c]), 9)
            by = [[1 / (n.get(x, 0) + 1) for x in cells[c] if x[0] == f] for f in families]
            thin = round(sum(sum(v) / len(v) for v in by if v) / sum(bool(v) for v in by), 9)
            balance = -used.get(unit[c], 0)
            if not covering:
                return spread, balance, thin, -c
            return len(duty.get(c, set()) & unmet), round(sum(weight[x] for x in new if x[0] == worst), 9), round(sum(weight[x] for x in new), 9), balance, spread, thin, -c

        best = max((c for c in cells if c not in picks), key=key)
        picks.append(best)
        for x in cells[best]:
            n[x] = n.get(x, 0) + 1
        used[unit[best]] = used.get(unit[best], 0) + 1
        for o in duty.get(best, ()):
            met[o] += 1
    return picks


@pytest.mark.parametrize("seed", range(2))
def test_greedy_coverage_against_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    covers = sorted({(f"f{f}", int(x), int(c)) for f, x, c in zip(rng.integers(0, 3, 260), rng.integers(0, 40, 260), rng.integers(0, 30, 260))})
    weight = {(f, x): float(rng.integers(1, 5)) / 4 for f, x, _ in covers}
    unit = {c: int(rng.integers(0, 4)) for _, _, c in covers}
    obligations = [(o, c, 1 + o % 2) for o in range(4) for c in sorted(unit) if rng.random() < 0.15]
    duty, minimum = {}, {o: m for o, _, m in obligations}
    for o, c, _ in obligations:
        duty.setdefault(c, set()).add(o)
    want = greedy_by_hand(covers, weight, unit, duty, minimum, 18, 0.7)
    tables = (
        spark.createDataFrame(covers, "family string, witness bigint, candidate bigint"), spark.createDataFrame([(f, x, w) for (f, x), w in weight.items()], "family string, witness bigint, w double"),
        spark.createDataFrame(list(unit.items()), "candidate bigint, unit bigint"),
    )
    duties = spark.createDataFrame(obligations, "obligation bigint, candidate bigint, minimum int")
    # one pool, pools of a few candidates, and a selection that goes on
    for options in ({}, {"pool_edges": 90}):
        assert [r.candidate for r in S.greedy_coverage(*tables, 18, 0.7, duties, **options).orderBy("rank").collect()] == want
    rest = S.greedy_coverage(*tables, 11, 0.7, duties, prefix=want[:7], pool_edges=(4_000_000, 90)[seed]).orderBy("rank").collect()
    assert [(r["rank"], r.candidate) for r in rest] == list(enumerate(want))[7:]


def test_small_pools_give_the_same_order(spark):
    rng = np.random.default_rng(4)
    covers = spark.createDataFrame(sorted({("f", int(w), int(c)) for w, c in rng.integers(0, [80, 40], (300, 2))}), "family string, witness bigint, candidate bigint")
    weights = covers.select("family", "witness").distinct().withColumn("w", (1 + F.col("witness") % 3).cast("double"))
    whole, parts = ([tuple(r) for r in S.lazy_greedy(covers, weights, 25, **o).orderBy("rank").collect()] for o in ({}, {"pool_edges": 30}))
    assert whole == parts and len(whole) == 25
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], "id bigint, v array<double>")
    whole, parts = ([tuple(r) for r in P.farthest_points(v, 20, **o).orderBy("rank").collect()] for o in ({}, {"pool": 25}))
    assert whole == parts and len(whole) == 20
    copies = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(9)], "id bigint, v array<double>")
    assert [r.id for r in P.farthest_points(copies, 5).orderBy("rank").collect()] == [0, 1]


def test_obligations_keep_members_from_being_swapped(spark):
    covers = spark.createDataFrame([("f", 1, 1), ("f", 2, 2), ("f", 3, 3), ("f", 4, 3)], "family string, witness bigint, candidate bigint")
    weights = spark.createDataFrame([("f", k, 1.0) for k in (1, 2, 3, 4)], "family string, witness bigint, w double")
    ranking = spark.createDataFrame([(0, 1), (1, 2)], "rank int, candidate bigint")
    duty = spark.createDataFrame([(9, 2, 1)], "obligation bigint, candidate bigint, minimum int")
    ids = lambda df: [r.candidate for r in df.orderBy("rank").collect()]
    assert ids(S.repair_swaps(covers, weights, ranking, 1)) == [1, 3] and ids(S.repair_swaps(covers, weights, ranking, 1, duty)) == [1, 2]


def test_positions_of_many_keys_are_dealt_evenly(spark):
    from framelake.operators import islands as I

    rows = spark.range(2_200_000).select((F.col("id") * 48_271 % 2_147_483_647).alias("k"))
    got = I.with_position(rows, ["k"], ranges=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert got.agg(F.max("position"), F.count("*")).first()[:] == (2_199_999, 2_200_000)
    bounds = got.groupBy(F.expr("position div 275000").alias("e")).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("e").collect()
    assert all(a.hi < b.lo for a, b in zip(bounds, bounds[1:])) and len(sizes) >= 1


def test_ranges_hold_at_most_twice_their_share(spark, monkeypatch):
    from framelake.operators import islands as I

    hot = spark.range(600_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    seen = []
    real = I._range_of
    monkeypatch.setattr(I, "_range_of", lambda key, bounds: seen.append(bounds) or real(key, bounds))
    out = I.with_position(hot, ["k"], ranges=16)
    tied = hot.withColumn("__tie", I._tie(hot))
    sizes = [r["count"] for r in tied.groupBy(real(F.struct("k", "__tie"), seen[0]).alias("p")).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 600_000 / 16
    assert out.agg(F.count_distinct("position")).first()[0] == 600_000


def test_translation_rank_by_hand(spark):
    """Against the rank of all closed walks' shifts, from potentials along a depth-first tree."""
    from framelake.operators import graphs as G

    rng = np.random.default_rng(5)
    edges = [(g, *sorted(rng.integers(0, 6, 2).tolist()), *rng.integers(-1, 2, 3).tolist()) for g in range(30) for _ in range(6)]
    got = {(r.graph, r.vertex): r["rank"] for r in G.net_components(spark.createDataFrame(edges, "graph bigint, u bigint, v bigint, sx int, sy int, sz int")).collect()}
    for g in range(30):
        own = [(u, v, np.array(s)) for h, u, v, *s in edges if h == g]
        left = {x for u, v, _ in own for x in (u, v)}
        while left:
            root = min(left)
            spot, stack = {root: np.zeros(3, int)}, [root]
            while stack:
                x = stack.pop()
                for u, v, s in own:
                    for a, b, t in ((u, v, s), (v, u, -s)):
                        if a == x and b not in spot:
                            spot[b] = spot[a] + t
                            stack.append(b)
            loops = [spot[u] + s - spot[v] for u, v, s in own if u in spot]
            assert got[g, root] == np.linalg.matrix_rank(np.array(loops))
            left -= set(spot)
