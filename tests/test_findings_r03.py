"""What the third round's findings were about."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import pairs as P
from framelake.operators import selection as S
from framelake.registry import QUERIES

CUBE = (10.0, 10.0, 10.0)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def pts(spark):
    """Random points, a lattice whose angles lie on the bounds of bins, and some at one place."""
    rng = np.random.default_rng(3)
    at = [*rng.uniform(0, 10, (300, 3)), *(np.array(list(itertools.product(range(5), repeat=3))) * 0.75 + 4), *[[1.0, 9.9, 0.1]] * 3]
    rows = [(k % 2, k, k % 4, *map(float, p)) for k, p in enumerate(at)]
    return spark.createDataFrame(rows, "frame bigint, atom bigint, species int, x double, y double, z double")


def around(rows, cutoff):
    """frame and center: the neighbours' atoms, displacements and distances, by all pairs."""
    out = {}
    for frame in sorted({r.frame for r in rows}):
        own = [r for r in rows if r.frame == frame]
        xyz, ids = np.array([(r.x, r.y, r.z) for r in own]), np.array([r.atom for r in own])
        for k, r in enumerate(own):
            d = xyz - xyz[k]
            d = d - np.rint(d / 10) * 10
            far = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
            near = (far < cutoff) & (ids != r.atom)
            out[frame, r.atom] = ids[near], d[near], far[near]
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_angles_are_counted_without_triplets(spark, sf, pts, block):
    """to the last angle, also on the bounds of bins and at no distance; no pair or triplet is a row."""
    want = {}
    for (frame, i), (_, d, r) in around(pts.collect(), 2.4).items():
        for a, b in itertools.combinations(range(len(r)), 2):
            with np.errstate(invalid="ignore"):
                c = (d[a, 0] * d[b, 0] + d[a, 1] * d[b, 1] + d[a, 2] * d[b, 2]) / (r[a] * r[b])
            c = 1.0 if np.isnan(c) else c
            bin_ = min(17, int(np.floor(np.degrees(np.arccos(min(1.0, max(-1.0, c)))) / 10)))
            want[frame, i, bin_] = want.get((frame, i, bin_), 0) + 1
    got = P.angle_counts(pts, pts, CUBE, 2.4, 18, block)
    assert {(r.frame, r.i, r.bin): r.n for r in got.collect()} == want and got.count() == len(want)
    plan = plan_of(QUERIES["bond_angle_histogram"](spark, sf))
    assert "collect_list" not in plan and "posexplode" not in plan


def test_many_angles_at_one_center():
    """more neighbours than a block of rows, of few directions or of many."""
    rng, bounds = np.random.default_rng(5), np.arange(1, 18) * 10.0
    for n in (2, 47, 97, 193, 1300):
        for v in (rng.normal(size=(n, 3)), rng.integers(-2, 3, (n, 3)).astype(float), rng.normal(size=(n, 3)) * [1, 0.01, 0]):
            r = np.sqrt(v[:, 0] * v[:, 0] + v[:, 1] * v[:, 1] + v[:, 2] * v[:, 2])
            a, b = np.triu_indices(n, 1)
            with np.errstate(invalid="ignore"):
                c = (v[a, 0] * v[b, 0] + v[a, 1] * v[b, 1] + v[a, 2] * v[b, 2]) / (r[a] * r[b])
            at = np.floor(np.degrees(np.arccos(np.clip(np.where(np.isnan(c), 1.0, c), -1, 1))) / 10).astype(int)
            assert P._angle_counts(list(v.T), r, bounds).tolist() == np.bincount(np.minimum(at, 17), minlength=18).tolist()


@pytest.mark.parametrize("block", [1024, 7])
def test_bridges_are_products(spark, sf, pts, block):
    """what two centers share is counted in arrays; no pair of neighbours is a row."""
    near = {k: set(ids[ids % 2 == 1].tolist()) for k, (ids, _, _) in around([r for r in pts.withColumn("frame", pts.frame * 0).collect()], 1.2).items() if k[0] == 0 and k[1] % 2 == 0}
    want = {(0, i, j, len(near[0, i] & near[0, j])) for (_, i), (_, j) in itertools.combinations(sorted(near), 2) if near[0, i] & near[0, j]}
    p = pts.withColumn("frame", pts.frame * 0)
    got = P.bridges_within(p.filter("atom % 2 = 0"), p.filter("atom % 2 = 1"), CUBE, 1.2, block).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "collect_list" not in plan_of(QUERIES["framework_bridges"](spark, sf))


def test_gathered_rows_are_made_in_many_tasks(spark):
    """however few bytes the places have."""
    matrix = spark.createDataFrame([(r, list(range(50))) for r in range(7)], "row bigint, columns array<bigint>")
    wanted = spark.range(4000).selectExpr("id as place", "id % 7 as row")
    out = S.csr_gather(matrix, wanted, most=100)
    parts = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in parts) == 200_000
