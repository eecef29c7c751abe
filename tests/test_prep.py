"""Dataset preparation and densities: identities, ties, empty strata and guards."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from framelake.operators import density as D
from framelake.operators import islands as I
from framelake.operators import prep as P
from framelake.operators import selection as S


def quotas_by_hand(sizes, requested, seed):
    order = sorted(sizes, key=lambda k: (hashlib.sha256(f"{seed}\0quota\0{k}".encode()).hexdigest(), k))
    out, left = dict.fromkeys(sizes, 0), min(requested, sum(sizes.values()))
    while left:
        for k in order:
            if left and out[k] < sizes[k]:
                out[k] += 1
                left -= 1
    return out


@pytest.mark.parametrize("requested", [0, 1, 5, 9, 23, 100])
def test_balanced_quotas(spark, requested):
    sizes = {"a": 1, "b": 7, "c": 3, "d": 12, "e": 1}
    got = P.balanced_quotas(spark.createDataFrame(list(sizes.items()), "k string, size bigint"), "k", "size", requested, 3)
    assert {r.k: r.quota for r in got.collect()} == quotas_by_hand(sizes, requested, 3)


def test_state_sequence(spark):
    rows = spark.createDataFrame([(0, i, 0.1 * i, s) for i, s in enumerate([0, 0, 1, 1, 0])], "run bigint, pos bigint, t double, s int")
    stays = I.state_residence(rows, "run", "pos", "s", "t").orderBy("first").collect()
    assert [(r.state, r.first, r.last, r.n_frames, r.span, r.left_censored, r.right_censored) for r in stays] == [(0, 0, 1, 2, 1, True, False), (1, 2, 3, 2, 1, False, False), (0, 4, 4, 1, 0, False, True)]
    assert stays[2].duration == 0.0
    moves = {(r.source, r.target): (r.adjacent, r.changed) for r in I.state_transitions(rows, "run", "pos", "s").collect()}
    assert moves == {(0, 0): (1, 0), (0, 1): (1, 1), (1, 0): (1, 1), (1, 1): (1, 0)}


def test_folds_without_training_are_left_out(spark):
    items = spark.createDataFrame([(i,) for i in range(3)], "position bigint")
    assert I.purged_kfold(items, 3, 5).count() == 0
    roles = {(r.fold, r.position): r.role for r in I.purged_kfold(spark.createDataFrame([(i,) for i in range(7)], "position bigint"), 3, 1).collect()}
    assert {f for f, _ in roles} == {1, 2}  # fold 0 evaluates 0, 3 and 6, and so purges all the others
    assert [roles[1, p] for p in range(7)] == ["purged", "eval", "purged", "purged", "eval", "purged", "train"]
    roles = {(r.fold, r.position): r.role for r in I.purged_kfold(spark.createDataFrame([(i,) for i in range(7)], "position bigint"), 5, 1).collect()}
    assert [roles[0, p] for p in range(7)] == ["eval", "purged", "train", "train", "purged", "eval", "purged"]


def test_positions_over_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = I.with_position(rows, ["k"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(5000)) and [r.k for r in got] == sorted(r.k for r in got)


def test_components_of_a_chain_and_loners(spark):
    nodes = spark.range(60).select(F.col("id").alias("n"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(3, 3)], "a bigint, b bigint")
    got = {r.n: r.component for r in P.connected_components(nodes, edges, "n", "a", "b").collect()}
    assert got == {i: 10 if 10 <= i <= 40 else i for i in range(60)}


def test_leakage_pass_row(spark):
    units = spark.createDataFrame([(1, "monitor"), (2, "development")], "uid bigint, role string")
    catalog = spark.createDataFrame([(1, "x"), (2, "y")], "uid bigint, fp string")
    windows = spark.createDataFrame([], "event bigint, uid bigint")
    assert [r.code for r in P.leakage_findings(units, catalog, windows, "fp").collect()] == ["pass"]


def test_clipped_weights_keep_their_mean(spark):
    w = spark.createDataFrame([(float(x),) for x in (0.1, 0.2, 0.9, 1.1, 2.7)], "weight double")
    got = sorted(r.weight for r in P.clipped_weights(w, 0.5, 1.5).collect())
    assert sum(got) / 5 == pytest.approx(1.0) and got[0] == 0.5 and got[-1] == 1.5
    with pytest.raises(ValueError):
        P.clipped_weights(w, 1.2, 1.5)


def test_greedy_coverage_order(spark):
    covers = spark.createDataFrame([("f", 1, 10), ("f", 2, 10), ("f", 2, 20), ("f", 3, 30), ("f", 4, 20)], "family string, witness bigint, candidate bigint")
    weights = spark.createDataFrame([("f", k, 1.0) for k in (1, 2, 3, 4)], "family string, witness bigint, w double")
    units = spark.createDataFrame([(10, 0), (20, 0), (30, 1)], "candidate bigint, unit bigint")
    got = [r.candidate for r in S.greedy_coverage(covers, weights, units, 3, 1.0).orderBy("rank").collect()]
    assert got == [10, 30, 20]


def test_density_keeps_its_mass(spark):
    pts = spark.createDataFrame([(0.1, 9.99, 5.0), (3.3, 3.3, 3.3), (-1.0, 11.0, 0.0)], "x double, y double, z double")
    box, shape = (10.0, 10.0, 10.0), (9, 10, 11)
    v = D.cloud_in_cell(pts, box, shape)
    assert v.agg(F.sum("mass")).first()[0] == pytest.approx(3.0, rel=5e-13)
    assert D.kernel_density(v, box, shape, 0.8).agg(F.sum("mass")).first()[0] == pytest.approx(3.0, rel=1e-12)
    with pytest.raises(ValueError):
        D.gaussian_stencil(box, shape, 3.0)
    mass, mean, cov = D.stencil_moments(D.gaussian_stencil(box, (40, 40, 40), 0.5), box, (40, 40, 40))
    assert mass == pytest.approx(1.0) and abs(mean).max() < 1e-12 and cov[0, 0] == pytest.approx(0.25, rel=0.05)
    assert D.shape_ladder(box, 5.0, 1000) == [(2, 2, 2), (4, 4, 4), (8, 8, 8)]


def test_hash_fraction(spark):
    want = (int.from_bytes(hashlib.sha256(b"7\0abc").digest()[:8], "big") + 0.5) / 2**64
    got = spark.range(1).select(P.hash_fraction(7, F.lit("abc"))).first()[0]
    assert math.isclose(got, want, rel_tol=1e-15)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run bigint, pos bigint, s int")
    assert I.contiguous_runs(none, "run", "pos").count() == 0
    assert I.state_residence(none, "run", "pos", "s").count() == 0
    assert I.with_position(none, ["pos"]).count() == 0
