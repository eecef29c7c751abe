"""Nets with known answers: the simple cubic net, chains, a triangle."""

from fractions import Fraction

from framelake.operators import graphs as G

CUBIC = [(0, 0, (1, 0, 0)), (0, 0, (0, 1, 0)), (0, 0, (0, 0, 1))]
DIAMOND = [(0, 1, (0, 0, 0)), (0, 1, (1, 0, 0)), (0, 1, (0, 1, 0)), (0, 1, (0, 0, 1))]
EDGE = "graph bigint, u bigint, v bigint, sx int, sy int, sz int"


def test_rank_and_components(spark):
    rows = [(0, u, v, *s) for u, v, s in CUBIC] + [(1, 0, 1, 0, 0, 0), (1, 1, 2, 0, 0, 0), (1, 5, 5, 1, 0, 0)]
    got = {(r.graph, r.vertex, r.vertices, r["rank"]) for r in G.net_components(spark.createDataFrame(rows, EDGE)).collect()}
    assert got == {(0, 0, 1, 3), (1, 0, 3, 0), (1, 5, 1, 1)}


def test_rings_of_known_nets(spark):
    assert [len(r) for r in G.shortest_rings(CUBIC, 6)].count(4) == 3
    diamond = [len(r) for r in G.shortest_rings(DIAMOND, 6)]
    assert diamond == [6] * 4
    rows = [(0, u, v, *s) for u, v, s in CUBIC]
    assert {(r.size, r.n) for r in G.primitive_rings(spark.createDataFrame(rows, EDGE), 4).collect()} == {(4, 3)}


def test_gf2():
    a, b, c = frozenset({1, 2}), frozenset({2, 3}), frozenset({1, 3})
    assert G.gf2_rank([a, b, c]) == 2 and G.is_cancelled(c, [a, b]) and not G.is_cancelled(a, [b])


def test_barycentric_diamond():
    half = Fraction(1, 4)
    assert G.barycentric(DIAMOND)[1] == tuple(-half for _ in range(3))
    assert G.point_symmetries(CUBIC) == 48


def test_exact_predicates():
    tri = ((0, 0, 0), (1, 0, 0), (0, 1, 0))
    assert G.side(*tri, (0, 0, 1)) == 1 and G.side(*tri, (0, 0, -1)) == -1 and G.side(*tri, (3, 4, 0)) == 0
    assert G.segment_meets_triangle((0.2, 0.2, -1), (0.2, 0.2, 1), tri)
    assert not G.segment_meets_triangle((2, 2, -1), (2, 2, 1), tri)
    assert G.on_segment((0.5, 0.5, 0), (0, 0, 0), (1, 1, 0))


def test_contacts(spark):
    a = spark.createDataFrame([(0, 1, 0, 0, 0), (1, 2, 0, 0, 0)], "u bigint, v bigint, sx int, sy int, sz int")
    b = spark.createDataFrame([(0, 1, 0, 0, 0), (1, 2, 1, 0, 0)], "u bigint, v bigint, sx int, sy int, sz int")
    assert sorted(r.change for r in G.contact_changes(a, b).collect()) == ["broken", "formed", "kept"]


def test_lattice_actions_invert_and_compose(spark):
    import numpy as np
    import pytest

    turn, shear = [0, 1, 0, 0, 0, 1, 1, 0, 0], [1, 2, 0, 0, 1, 0, -1, 0, 1]
    assert G.composed(shear, G.unimodular_inverse(shear)) == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert np.array_equal(np.array(G.composed(turn, shear)).reshape(3, 3), np.array(shear).reshape(3, 3) @ np.array(turn).reshape(3, 3))
    with pytest.raises(ValueError):
        G.unimodular_inverse([2, 0, 0, 0, 1, 0, 0, 0, 1])
    action = spark.createDataFrame([(0, 1, 1, 0, -1), (1, 0, 0, 2, 0)], "vertex bigint, image bigint, tx int, ty int, tz int")
    edges = spark.createDataFrame([(0, 1, 1, 0, 0, 2, 1, 0), (0, 0, 0, 0, 1, 0, 0, 0)], "u bigint, v bigint, sx int, sy int, sz int, ax int, ay int, az int")
    got = {(r.u, r.v, r.sx, r.sy, r.sz, r.ax, r.ay, r.az) for r in G.map_edges(edges, action, turn).collect()}
    # u = 0 at (2, 1, 0) goes to 1 at (1, 0, 2) + (1, 0, -1); v = 1 at (3, 1, 0) goes to 0 at (1, 0, 3) + (0, 2, 0)
    assert (0, 1, 1, -2, -2, 1, 2, 3) in got and len(got) == 2
    points = spark.createDataFrame([(0, 2, 1, 0)], "vertex bigint, nx int, ny int, nz int")
    assert [tuple(r) for r in G.map_vertices(points, action, turn).collect()] == [(1, 2, 0, 1)]


def test_spectra_refuse_negatives_beyond_the_tolerance(spark):
    import pytest

    from framelake.operators import spectral as S

    rows = spark.createDataFrame([(0, 1.0), (1, -1e-13), (2, -0.1)], "k int, p double")
    assert [r.p for r in S.ruled_negatives(rows, "p", "clip_roundoff").orderBy("k").collect()] == [1.0, 0.0, -0.1]
    with pytest.raises(Exception, match="negative"):
        S.ruled_negatives(rows, "p", "error").collect()
    with pytest.raises(ValueError):
        S.ruled_negatives(rows, "p", "hide")


def test_unknown_observables_are_refused(spark):
    import pytest

    from framelake.operators import evidence as E

    with pytest.raises(KeyError, match="mass"):
        E.observed({}, ["mass"])
