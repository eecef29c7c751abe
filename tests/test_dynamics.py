"""Closed forms and cross-checks of the time-lag, spectral and kernel operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import kernels as K
from framelake.operators import lag as L
from framelake.operators import normalize as N
from framelake.operators import spectral as S


def walk(spark, frames=20, atoms=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(atoms, frames)).cumsum(axis=1)
    return x, spark.createDataFrame([(a, f, float(x[a, f]), 0.1 * f) for a in range(atoms) for f in range(frames)], "atom bigint, frame bigint, x double, t double")


def test_static_and_steady_motion(spark):
    rows = spark.createDataFrame([(a, f, 5.0, 2.0 * f) for a in range(3) for f in range(8)], "atom bigint, frame bigint, still double, steady double")
    still = {r.lag: r.msd for r in L.msd(rows, ["still"], range(5)).collect()}
    steady = {r.lag: r.msd for r in L.msd(rows, ["steady"], range(5)).collect()}
    assert set(still.values()) == {0.0}
    assert steady == {k: 4.0 * k * k for k in range(5)}


def test_msd_by_leads_joins_and_fft_agree(spark):
    x, rows = walk(spark)
    lead = {r.lag: r.msd for r in L.msd(rows, ["x"], range(15)).collect()}
    joined = {r.lag: r.msd for r in L.msd(rows, ["x"], range(100)).collect()}
    fft = {r.lag: r.msd for r in S.fft_msd(rows, "atom", "frame", ["x"], 15).collect()}
    for k in range(15):
        want = np.mean((x[:, k:] - x[:, : 20 - k]) ** 2)
        assert lead[k] == pytest.approx(want) and joined[k] == pytest.approx(want) and fft[k] == pytest.approx(want, abs=1e-9)
    assert lead[0] == 0.0 and max(joined) == 19


def test_gap_in_frames_gives_no_pair(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (0, 3, 9.0)], "atom bigint, frame bigint, x double")
    assert {r.lag: r.pairs for r in L.msd(rows, ["x"], [1]).collect()} == {1: 1}


def test_velocities(spark):
    rows = spark.createDataFrame([(0, k, float(t), float(t * t)) for k, t in enumerate([0.0, 1.0, 3.0, 4.0, 7.0])], "atom bigint, frame bigint, t double, x double")
    got = [r.v_x for r in N.velocities(rows, ["x"]).orderBy("frame").collect()]
    assert got == pytest.approx(list(np.gradient(np.array([0.0, 1, 9, 16, 49]), [0.0, 1, 3, 4, 7], edge_order=2)))
    two = rows.filter("frame < 2")
    assert [r.v_x for r in N.velocities(two, ["x"]).orderBy("frame").collect()] == [1.0, 1.0]


def test_unwrap_takes_ties_to_even_and_needs_order(spark):
    rows = spark.createDataFrame([(0, k, f) for k, f in enumerate([0.75, 0.0, 0.5, 0.25, 0.875])], "atom bigint, frame bigint, f double")
    # 0.0 -> 0.5 is a tie: the half rounds to 0, so the step stays + 0.5
    assert [r.u_f for r in N.unwrap(rows, ["f"]).orderBy("frame").collect()] == [0.75, 1.0, 1.5, 1.25, 0.875]
    with pytest.raises(N.SemanticsError):
        N.require_trajectory("ensemble")


def test_select_atoms_guards(spark):
    rows = spark.createDataFrame([(0, 1), (1, 2)], "atom bigint, species int")
    with pytest.raises(ValueError):
        N.select_atoms(rows)
    twice = spark.createDataFrame([(0,), (0,)], "atom bigint")
    with pytest.raises(Exception, match="twice"):
        N.select_atoms(rows, atoms=twice).collect()


def test_correlation_by_fft_and_pairs(spark):
    x, rows = walk(spark, 33)
    direct = {r.lag: (r.total, r.origins) for r in L.correlation(rows, ["x"], range(10)).collect()}
    fft = {r.lag: r.total for r in S.fft_correlation(rows, "atom", "frame", ["x"], 10).collect()}
    for k in range(10):
        want = float((x[:, k:] * x[:, : 33 - k]).sum())
        assert direct[k][0] * direct[k][1] == pytest.approx(want) and fft[k] == pytest.approx(want)


def test_isotropic_scattering_at_rest_is_one(spark):
    _, rows = walk(spark)
    out = {r.lag: r.f for r in L.scattering_isotropic(rows.withColumns({"y": F.col("x"), "z": F.col("x")}), ["x", "y", "z"], [0, 1], 0.7).collect()}
    assert out[0] == 1.0 and abs(out[1]) < 1


def test_welch_power_of_a_tone(spark):
    n, seg = 256, 64
    y = np.sin(2 * np.pi * 8 * np.arange(n) / seg)
    rows = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(y)], "key bigint, i bigint, y double")
    got = {r.k: r.power for r in S.welch(rows, "key", "i", "y", seg).collect()}
    assert max(got, key=got.get) == 8
    assert sum(got.values()) / seg == pytest.approx(0.5, rel=1e-6)


def test_correlation_time_within_lags():
    """A slow series' positive pairs go on beyond the bound, which cuts them off."""
    y = np.sin(np.arange(400) / 60)
    assert K.correlation_time(y)[0] > 21
    x = y - y.mean()
    c = [np.mean(x[: len(x) - k] * x[k:]) for k in range(21)]
    assert K.correlation_time(y, 20)[0] == pytest.approx(0.5 + sum(c[1:]) / c[0])


def test_correlation_time_cases(spark):
    assert K.correlation_time(np.array([1.0, 2.0]))[2] == "insufficient"
    assert K.correlation_time(np.ones(10))[2] == "constant"
    tau, eff, status = K.correlation_time(np.tile([1.0, -1.0], 50))
    assert status == "ok" and tau == 0.5 and eff == 100.0


def test_segments_find_a_step():
    y = np.concatenate([np.zeros(10), np.full(10, 5.0)])
    assert K.segments(y, 1.0) == [0, 10]
    assert K.segments(y, 1e6) == [0]


def test_plateau_needs_points(spark):
    _, rows = walk(spark)
    with pytest.raises(Exception, match="too few"):
        L.plateau(rows.filter("atom = 0"), "t", "x", 0.0, 0.3).collect()


def test_net_charge_is_refused(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "frame bigint, atom bigint, v double")
    with pytest.raises(Exception, match="net charge"):
        L.charge_current(rows, "v", F.lit(1.0), F.lit(0), 1e-12).collect()
