"""Special functions, hulls, alignments, seriation and dense models."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from chromaloom.functions import numeric as nm
from chromaloom.functions.coords import parse_region, resolution_name
from chromaloom.operators import matrix as mx
from chromaloom.operators import models as md
from chromaloom.operators import seriation as se


def test_distributions():
    assert nm.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert nm.t_two_sided(0, 5) == pytest.approx(1)
    assert nm.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert nm.chi_square_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert nm.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert math.isnan(nm.t_two_sided(math.nan, 3))


def test_hull_volume():
    cube = np.array([[x, y, z] for x in (0, 2) for y in (0, 2) for z in (0, 2)], float)
    assert nm.hull_volume(np.concatenate([cube, np.random.default_rng(0).uniform(0, 2, (200, 3))])) == pytest.approx(8)
    assert nm.hull_volume(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]])) == 0


def test_alignment_undoes_a_rotation():
    rng = np.random.default_rng(1)
    p = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    assert nm.kabsch(p, p @ q + 5)[1] == pytest.approx(0, abs=1e-7)
    assert nm.kabsch(p, p * [1, 1, -1])[1] > 0.1


def test_library_size():
    assert nm.library_size(100, 100) is None
    assert nm.library_size(0, 0) is None
    n = nm.library_size(1_000_000, 800_000)
    assert abs(n * (1 - math.exp(-1_000_000 / n)) - 800_000) < 2


def test_seriation_finds_a_hidden_order():
    s, truth = se.toeplitz(40, 3)
    for perm in (se.baseline(s), se.order(s, 8, 4), se.eta_trick(s)):
        assert sorted(perm) == list(range(40))
        assert se.kendall(perm, truth) > 0.95
    c, circle = se.toeplitz(30, 4, circular=True)
    assert max(se.kendall_circular(se.baseline(c, True), t) for t in (circle, circle[::-1])) > 0.9
    assert se.p_sum(s, truth) <= se.p_sum(s, np.random.default_rng(0).permutation(40))
    assert sorted(se.tour(np.random.default_rng(0).normal(size=(12, 2)))) == list(range(12))
    path, cost = se.align(np.arange(10.0)[:, None], np.arange(10.0)[:, None])
    assert cost == pytest.approx(0) and path[0] == (0, 0)


def test_dense_models():
    rng = np.random.default_rng(2)
    a = rng.poisson(3, (12, 12)).astype(float)
    a = a + a.T
    walked = md.random_walk(a, 0.5)
    off = a - np.diag(np.diag(a))
    assert np.allclose(walked, 0.5 * np.linalg.inv(np.eye(12) - 0.5 * off / off.sum(0)), atol=1e-5)
    assert np.allclose(md.box_mean(a, 1)[5, 5], a[4:7, 4:7].mean())
    even, bias = md.balance(a)
    assert np.ptp(even.sum(1)) / even.sum(1).mean() < 1e-3 and np.isclose(bias.mean(), 1)
    limit = md.walk_limit(a)
    assert np.allclose(limit, limit.T) and np.isclose(limit.sum(), 1e5)
    p = a / a.sum(1, keepdims=True)
    series = sum(np.exp(-4.0 * t) * np.linalg.matrix_power(p, t) for t in range(1, 40))
    assert np.allclose(md.propensity_distance(a), np.abs(series[:, None] - series[None]).sum(2), atol=1e-10)
    with pytest.raises(ValueError):
        md.balance(np.triu(a))
    back = md.dense(md.long(a, 10), 10)
    assert np.allclose(back, a)


def test_poisson_fit_finds_the_informative_feature():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = rng.poisson(np.exp(0.8 * x[:, 1] + 0.3)).astype(float)
    w, b, r = md.fit_poisson(x, y)
    assert w.argmax() == 1 and (w >= 0).all() and r > 0.4


def test_literals_and_edges():
    r = parse_region("chr1a:30,000-50,001").snapped(20_000)
    assert (r.start, r.end) == (20_000, 60_000)
    assert parse_region("chrX").whole and parse_region(["chr1", 1, 5]).end == 5
    with pytest.raises(ValueError):
        parse_region("chr1:5")
    assert mx.log_bin_edges(10, 2.0) == [0, 1, 2, 4, 8, 10]
    assert resolution_name(20_000) == "20k" and resolution_name(1_000_000) == "1m"


def test_constant_band_scores(spark):
    px = spark.createDataFrame([("c", "chr1", i * 10, i * 10, v) for i, v in enumerate([1.0, 2.0, 3.0])] + [("c", "chr1", i * 10, i * 10 + 10, 5.0) for i in range(2)] + [("c", "chr1", 0, 20, None)], "cell string, chrom string, bin1 bigint, bin2 bigint, value double")
    z = {(r["bin1"], r["bin2"]): r["z"] for r in mx.band_scores(px, 10).collect()}
    assert z[(0, 0)] == pytest.approx(-1.224745, abs=1e-6) and z[(0, 10)] == 0 and z[(0, 20)] is None


def test_dbscan_and_kmeans(spark):
    rng = np.random.default_rng(0)
    pts = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3)), [[20, 20, 20]]])
    df = spark.createDataFrame(pd.DataFrame({"cell": "c", "chrom": "chr1", "pos": np.arange(41) * 10, "x": pts[:, 0], "y": pts[:, 1], "z": pts[:, 2]}))
    got = {r["pos"]: r["cluster"] for r in md.dbscan(df, 1.0, 5).collect()}
    assert len({got[p * 10] for p in range(20)}) == 1 and len({got[p * 10] for p in range(20, 40)}) == 1
    assert got[0] != got[200] and got[400] is None
    assert md.kmeans(df, 3).select("cluster").distinct().count() == 3


def test_arrays_equal_single_values():
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.normal(size=200) * 5, [0.0, np.inf, -np.inf, np.nan, 1.0, 1e-12, 1e6]])
    df = np.concatenate([rng.choice([1.0, 2.5, 7, 30, 400.25], 200), [3, 3, 3, 3, np.nan, 5, 5]])
    from chromaloom.functions.numeric import t_two_sided, t_two_sided_many

    assert np.allclose(t_two_sided_many(t, df), [t_two_sided(float(a), float(b)) for a, b in zip(t, df)], rtol=1e-12, equal_nan=True)


def test_holm_ranks_ties_by_the_columns_given(spark):
    from chromaloom.operators.primitives import adjust_p

    rows = [(i, p) for i, p in enumerate([0.02, 0.01, 0.02, 0.5, 0.02, 0.01])]
    df = spark.createDataFrame(rows, "id bigint, p double")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    want = {r[0]: (len(rows) - i) * r[1] for i, r in enumerate(order)}
    got = {r["id"]: r["q"] for r in adjust_p(df, "p", [], "holm", ties=["id"]).collect()}
    assert got == want
    twice = sorted(r["q"] for r in adjust_p(df.union(df), "p", [], "holm", ties=["id"]).collect())
    assert twice == sorted((12 - i) * p for i, (_, p) in enumerate(sorted(rows + rows, key=lambda r: (r[1], r[0]))))
    with_key = df.selectExpr("1 AS k", "*")
    assert {r["id"]: r["q"] for r in adjust_p(with_key, "p", ["k"], "holm", ties=["id"]).collect()} == want
