"""What the second round's findings were about."""

import itertools
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framelake.functions.columns import rounded_length
from framelake.operators import graphs as G
from framelake.operators import lag as L
from framelake.operators import pairs as P
from framelake.operators import selection as S
from framelake.sources import trajectories as T

CUBE = (10.0, 10.0, 10.0)


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.default_rng(2)
    rows = [(k % 2, k, k % 4, *map(float, p)) for k, p in enumerate(rng.uniform(0, 10, (400, 3)))]
    return spark.createDataFrame(rows, "frame bigint, atom bigint, species int, x double, y double, z double")


def test_triplets_leave_pairs_where_they_are(pts):
    """only the points are shuffled."""
    near = P.triplets(P.neighbors(pts, pts, CUBE, 1.5, home=True))
    assert shuffles(near) == 2
    plain = P.triplets(P.neighbors(pts, pts, CUBE, 1.5, method="dense"))
    key = lambda df: sorted((r.frame, r.i, r.a, r.b, round(r.cosine, 9)) for r in df.collect())
    assert key(near) == key(plain)


def test_bridges_are_counted_where_they_are_made(pts):
    """no join of the pairs with themselves; with bins and without."""
    a, b = pts.filter("species % 2 = 0"), pts.filter("species % 2 = 1")
    near = P.neighbors(a, b, CUBE, 2.0, home=True)
    around: dict = {}
    for r in near.collect():
        around.setdefault((r.frame, r.i), set()).add(r.j)
    want = sorted((f, i, k, len(x & around[g, k])) for (f, i), x in around.items() for g, k in around if g == f and k > i and x & around[g, k])
    for pairs in (near, near.drop(*P.HOME)):
        got = P.bridges(pairs)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert "Join" not in P.bridges(near.sparkSession.createDataFrame(near.limit(5).collect(), near.schema))._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_that_meet_in_many_bins_count_once(spark):
    """without a distinct, so that two boxes of one id count twice, as in SQL."""
    rows = [(1, 0.0, 3.5, 0.0, 3.5, 0.0, 3.5), (2, 0.5, 2.0, 0.5, 3.0, 0.5, 3.0), (2, 3.5, 4.0, 3.5, 4.0, 3.5, 4.0), (3, 9.0, 9.5, 0.0, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(rows, "id bigint, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    assert [tuple(r) for r in P.box_overlaps(boxes, 1.0).collect()] == [(1, 2), (1, 2)]


def test_changes_from_frame_to_frame(spark):
    """also where the last frame has no contact."""
    edges = spark.createDataFrame([(f, 1, 2, 0, 0, 0) for f in (0, 1)] + [(f, 3, 4, 0, 0, 0) for f in (1, 3)], "frame bigint, u bigint, v bigint, sx int, sy int, sz int")
    got = sorted((r.frame, r.u, r.change) for r in G.successive_changes(edges, 4).collect())
    assert got == [(0, 1, "kept"), (0, 3, "formed"), (1, 1, "broken"), (1, 3, "broken"), (2, 3, "formed"), (3, 3, "broken")]


def test_edges_come_to_the_driver_as_columns(spark, monkeypatch):
    """never as a row object each."""
    rng = np.random.default_rng(0)
    edges = sorted({("fg"[w % 2], int(w), int(c)) for w, c in rng.integers(0, [40, 12], (150, 2))})
    covers = spark.createDataFrame(edges, "family string, witness bigint, candidate bigint")
    weights = spark.createDataFrame([("fg"[w % 2], w, float(1 + w % 4)) for w in range(40)], "family string, witness bigint, w double")
    units = covers.select("candidate").distinct().selectExpr("candidate", "candidate % 3 as unit")
    seen, begin = [], S.Pool.__init__
    monkeypatch.setattr(S.Pool, "__init__", lambda self, table, *a: (seen.append(type(table)), begin(self, table, *a))[1])
    assert S.greedy_coverage(covers, weights, units, 5).count() == 5 and seen == [pa.Table]


def test_a_row_wanted_by_many_is_copied(spark):
    """its places go to more than one key of the join."""
    matrix = spark.createDataFrame([(1, [5, 6, 7]), (2, [8])], "row bigint, columns array<bigint>")
    wanted = spark.createDataFrame([(p, 1 if p < 90 else 2) for p in range(95)] + [(95, 3)], "place bigint, row bigint")
    got = sorted(tuple(r) for r in S.csr_gather(matrix, wanted, most=10).select("place", "row", "k", "column").collect())
    assert got == sorted([(p, 1, k, 5 + k) for p in range(90) for k in range(3)] + [(p, 2, 0, 8) for p in range(90, 95)])


def test_rings_are_counted_rather_than_walked(spark):
    """608,400 rings of one dense net, and nets with loops, double edges and images as by the search."""
    dense = spark.createDataFrame([(7, a, 100 + b, 0, 0, 0) for a in range(40) for b in range(40)], "graph bigint, u bigint, v bigint, sx int, sy int, sz int")
    assert [tuple(r) for r in G.primitive_rings(dense, 5).collect()] == [(7, 4, 780 * 780)]
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m, s = (int(rng.integers(*x)) for x in ((1, 9), (1, 22), (0, 3)))
        u, v, shifts = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(-s, s + 1, (m, 3))
        rings = [len(r) for r in G.shortest_rings(sorted({min((a, b, t), (b, a, tuple(-x for x in t))) for a, b, t in zip(u.tolist(), v.tolist(), map(tuple, shifts.tolist()))}), 5)]
        parts = [G.chordless_through(u, v, shifts, 2, k, 5) for k in range(2)]
        assert {k: sum(p[k] for p in parts) for k in (3, 4, 5)} == {k: k * rings.count(k) for k in (3, 4, 5)}


def test_triclinic_points_are_copied_with_their_fractions(pts):
    """F8: a pair is met once, and its condition is small enough to be compiled; as by all pairs, also where bins are a whole cutoff high."""
    cell = np.array([(10.0, 0.0, 0.0), (7.0, 9.0, 0.0), (1.0, -1.0, 8.0)])
    rows = pts.collect()
    images = np.array(list(itertools.product(range(-3, 4), repeat=3))) @ cell
    for cutoff in (0.9, 2.0, 3.4):
        out = P.triclinic_neighbors(pts, cell.ravel().tolist(), cutoff)
        got = {(r.i, r.j): r.r for r in out.collect()}
        assert len(got) == out.count()
        want = {}
        for frame in (0, 1):
            own = [r for r in rows if r.frame == frame]
            xyz = np.array([(r.x, r.y, r.z) for r in own])
            for k in range(len(own) - 1):
                d = np.sqrt((((xyz[k + 1 :] - xyz[k])[:, None] + images) ** 2).sum(axis=2).min(axis=1))
                want |= {(own[k].atom, own[k + 1 + n].atom): d[n] for n in np.flatnonzero(d < cutoff)}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = P.triclinic_neighbors(pts, cell.ravel().tolist(), 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join", 1)[1].split("\n")[0].lower().count("rint") < 20


@pytest.mark.parametrize("sizes", [(1024, 64), (3, 2)])
def test_harmonics_of_blocks(spark, pts, sizes):
    """ions meet rings block by block; no pair of ion and member is a row."""
    p = pts.filter("atom < 60")
    rings = p.selectExpr("frame + 2 * (atom div 20) as ring", "atom", "(atom div 2) % 10 as place")
    ions = p.filter("species = 1").selectExpr("frame", "atom as ion", "x", "y", "z")
    at, members = {r.atom: np.array((r.x, r.y, r.z)) for r in p.collect()}, {}
    for r in rings.collect():
        members.setdefault(r.ring, {})[r.place] = at[r.atom]
    want = {}
    for r in ions.collect():
        for ring, m in members.items():
            if ring % 2 == r.frame:
                d = np.array([m[k] for k in sorted(m)]) - at[r.ion]
                want |= {(r.ion, ring, k): h for k, h in enumerate(np.fft.fft(np.sqrt(((d - 10 * np.rint(d / 10)) ** 2).sum(axis=1)))[:4] / len(m))}
    got = P.coordination_fingerprints(ions, p, rings, CUBE, 3, *sizes)
    rows = {(r.ion, r.ring, r.k): r.amplitude * np.exp(1j * r.phase) for r in got.collect()}
    assert rows.keys() == want.keys() and all(abs(rows[k] - want[k]) < 1e-9 for k in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroups") == 1 and "FlatMapCoGroups" in plan.split("Aggregate", 1)[0]
    locked = {(r.ring, r.k): (r.samples, r.amplitude, r.resultant) for r in P.harmonic_locking(ions, p, rings, CUBE, 3, *sizes).collect()}
    for ring, k in {(ring, k) for _, ring, k in want}:
        own = np.array([h for (_, g, j), h in want.items() if (g, j) == (ring, k)])
        assert np.allclose(locked[ring, k], (len(own), np.abs(own).mean(), abs((own / np.abs(own)).mean())))
    one = P.coordination_fingerprints(ions.filter("ion in (1, 5)").withColumn("ring", ions.frame), p, rings, CUBE)
    assert sorted((r.ion, r.ring, r.k) for r in one.collect()) == [(i, 1, k) for i in (1, 5) for k in range(4)]


def test_many_lags_make_no_pairs(spark):
    """as by pairs, over batches, with nulls, strides and two columns; nothing is joined or exploded."""
    rng = np.random.default_rng(3)
    rows = [(a, f, None if rng.random() < 0.1 else float(rng.normal()), float(a)) for a, n in enumerate((300, 1, 90, 40, 7)) for f in range(n)]
    df = spark.createDataFrame(rows, "atom bigint, frame bigint, x double, y double")
    at = {(a, f): (x, y) for a, f, x, y in rows}
    lags = [0, 1, 2, *range(5, 140, 2), 299, 500]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = L.msd(df, ["x", "y"], lags, 3)
        got = {r.lag: (r.msd, r.pairs) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in lags:
        pairs = [(at[a, f], at[a, f + k]) for a, f in at if f % 3 == 0 and (a, f + k) in at]
        known = [(p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 for p, q in pairs if p[0] is not None and q[0] is not None]
        assert (k in got) == bool(pairs)
        if pairs:
            assert got[k][1] == len(pairs) and (got[k][0] is None if not known else abs(got[k][0] - np.mean(known)) < 1e-9)
    assert not {"Join", "Generate"} & set(out._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").split())


def test_a_dump_frame_is_split_once(spark, tmp_path):
    """a frame of 12,000 atoms; its column names aren't split off its text again for each."""
    n = 12_000
    body = "\n".join(f"{k} 1 {k % 7} 1 2" for k in range(n, 0, -1))
    (tmp_path / "dump").write_text(f"ITEM: TIMESTEP\n5\nITEM: NUMBER OF ATOMS\n{n}\nITEM: BOX BOUNDS pp pp pp\n0 10\n0 10\n0 10\nITEM: ATOMS id type xu yu zu\n{body}\n")
    begin = time.monotonic()
    got = T.dump_atoms(T.read_dump(spark, str(tmp_path / "dump"))).select("id", "atom", "fx").collect()
    assert sorted((r.id, r.atom, round(r.fx * 10)) for r in got) == [(k, k - 1, k % 7) for k in range(1, n + 1)]
    assert time.monotonic() - begin < 30


def test_components_are_reduced_before_they_are_moved(spark):
    """As by a walk of the whole graph, whatever the batches; what moves is no more than vertices and closed walks."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        n, m, far = int(rng.integers(2, 60)), int(rng.integers(1, 80)), int(rng.integers(0, 3))
        rows += [(g, int(a) - 5, int(b) - 5, *map(int, rng.integers(-far, far + 1, 3) * rng.integers(0, 2, 3))) for a, b in rng.integers(0, n, (m, 2))]
    df = spark.createDataFrame(rows, "graph bigint, u bigint, v bigint, sx int, sy int, sz int").repartition(3)
    want = sorted((g, *c) for g in range(12) for c in G.translation_ranks(sorted({min((u, v, tuple(s)), (v, u, tuple(-x for x in s))) for k, u, v, *s in rows if k == g})))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for most in (20, 1 << 21):
            assert sorted(tuple(r) for r in G.net_components(df, most).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    net = G._Net()
    for _ in range(40):
        net.add(*rng.integers(0, 50, (2, 5000)), rng.integers(-1, 2, (5000, 3)))
    assert len(net.edges()[0]) <= 53 and net.components() == [(0, 50, 3)]


def test_results_of_one_search_are_compared_in_place(pts):
    """as by the join, without one of pairs."""
    r, ends = F.col("r"), F.col("i") + F.col("j")
    near = P.neighbors(pts, pts, CUBE, 1.6)
    out = P.compare_within(near, F.when(r < 1.5, r), F.when(ends % 7 != 0, F.when(ends % 10 == 0, r + 0.01).otherwise(r)), 1e-6)
    other = near.filter(ends % 7 != 0).withColumn("r", F.when(ends % 10 == 0, r + 0.01).otherwise(r))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, P.compare(near.filter(r < 1.5), other, 1e-6).collect()))
    assert {x.status for x in out.select("status").distinct().collect()} == {"matched", "moved", "missing", "extra"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_lengths_are_rounded_as_in_sql(spark):
    """by scaling, halves up."""
    r = [0.0, 0.1234565, 0.5, 1.0000005, 1.49999999951, 1.2345678905, 2.5e-7, 7.0]
    got = spark.createDataFrame([(x,) for x in r], "r double").select(rounded_length(F.col("r"), 6), rounded_length(F.col("r"), 9)).collect()
    assert [tuple(x) for x in got] == [duckdb.sql(f"SELECT round({x!r}::DOUBLE, 6), round({x!r}::DOUBLE, 9)").fetchall()[0] for x in r]


def test_witnesses_stream_by_blocks(spark):
    """a witness goes to the cells there are alone, whatever the batches and blocks."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(0, 0.6, (120, 5)), np.full((30, 5), 0.3), [[40.0] * 5]])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id bigint, v array<double>")
    d = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2))
    want = {(int(i), int(j)) for i, j in np.argwhere(d <= 0.8)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        for block in (9, 32768):
            out = P.feature_neighbors(df, df, 0.8, block=block)
            rows = out.collect()
            assert len(rows) == len(want) and {(r.witness, r.candidate) for r in rows} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
