"""Neighbourhoods by tiles against all pairs, on dense and odd points; no row for each pair where an aggregate is asked."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.operators import models as md
from chromaloom.operators import spatial as sp

SCHEMA = "cell string, chrom string, pos bigint, x double, y double, z double, feature double"


def _points(n: int = 1500, seed: int = 5) -> list[tuple]:
    rng = np.random.default_rng(seed)
    xyz = rng.normal(0, 1, (n, 3))
    rows = [(f"c{i % 2}", f"chr{i % 3}", i, *map(float, xyz[i]), None if i % 11 == 0 else float(i % 7)) for i in range(n)]
    rows += [("c0", "chr0", n + i, 0.1, 0.2, 0.3, 5.0) for i in range(700)]  # more than a tile at one place
    rows += [("c0", "chr9", 1, math.nan, 0.0, 0.0, 9.0), ("c0", "chr9", 2, None, 0.0, 0.0, 9.0), (None, "chr9", 3, 0.0, 0.0, 0.0, 9.0), ("c1", "chr9", 4, 50.0, 0.0, 0.0, 3.0)]
    return rows


def _brute(rows: list[tuple], radius: float) -> dict:
    known = [r for r in rows if r[0] and all(v is not None and math.isfinite(v) for v in r[3:6])]
    xyz, cell = np.array([r[3:6] for r in known]), np.array([r[0] for r in known])
    d = xyz[:, None] - xyz[None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    near = (d2 <= radius * radius) & (cell[:, None] == cell[None])
    return {"rows": known, "near": near, "d2": np.where(cell[:, None] == cell[None], d2, np.inf)}


@pytest.mark.parametrize("how", ["sum", "mean", "max", "min", "count"])
def test_feature_in_radius_of_dense_points(spark, how):
    rows = _points()
    found = {r[:3]: r[3] for r in map(tuple, sp.feature_in_radius(spark.createDataFrame(rows, SCHEMA), "feature", 0.7, how, name="v").select("cell", "chrom", "pos", "v").collect())}
    assert len(found) == len(rows)
    b = _brute(rows, 0.7)
    f = np.array([math.nan if r[6] is None else r[6] for r in b["rows"]])
    for i, r in enumerate(b["rows"]):
        near = b["near"][i].copy()
        near[i] = False
        v = f[near & ~np.isnan(f)]
        want = {"sum": v.sum(), "count": len(v)}[how] if how in ("sum", "count") else {"mean": np.mean, "max": np.max, "min": np.min}[how](v) if len(v) else None
        assert found[r[:3]] == (pytest.approx(want) if want is not None else None)
    assert found[("c0", "chr9", 1)] == (0 if how in ("sum", "count") else None)


def test_no_row_for_each_pair(spark):
    df = spark.createDataFrame(_points(), SCHEMA)
    for out in (sp.density(df, 0.7), sp.feature_in_radius(df, "feature", 0.7, name="v"), sp.k_nearest(df, 3, 2.0), md.energy(df, 1.0, 0.5), sp.ripley(df, 0.7, 10.0)):
        assert "_shift" not in out._jdf.queryExecution().analyzed().toString()  # copies of rows for all neighbouring cubes


def test_counts_pairs_shells_and_energy(spark):
    rows = _points(800)
    df = spark.createDataFrame(rows, SCHEMA)
    b = _brute(rows, 0.7)
    n = {r[:3]: r[3] for r in map(tuple, sp.density(df, 0.7).select("cell", "chrom", "pos", "n_near").collect())}
    assert n == {r[:3]: int(b["near"][i].sum()) for i, r in enumerate(b["rows"])}
    pairs = {tuple(r) for r in sp.proximity_pairs(df, 0.7).select("cell", "chrom1", "pos1", "chrom2", "pos2").collect()}
    i, j = np.nonzero(b["near"])
    assert pairs == {(b["rows"][p][0], *b["rows"][p][1:3], *b["rows"][q][1:3]) for p, q in zip(i, j, strict=True) if b["rows"][p][1:3] < b["rows"][q][1:3]}
    assert sp.proximity_pairs(df, 0.7).count() == len(pairs)
    shells = {(r["cell"], r["shell"]): r["count"] for r in sp.shell_correlation(df, 0.25, 1.0, 10.0).collect()}
    d = np.sqrt(b["d2"])
    for c in ("c0", "c1"):
        own = np.array([r[0] == c for r in b["rows"]])
        shell = np.maximum(np.ceil(d[own] / 0.25) - 1, 0)
        assert [shells[(c, s)] for s in range(4)] == [int((shell == s).sum()) for s in range(4)]
    got = {r["cell"]: r["energy"] for r in md.energy(df, 1.0, 0.5).collect()}
    for c in ("c0", "c1"):
        at = np.flatnonzero([r[0] == c for r in b["rows"]])
        d2 = b["d2"][np.ix_(at, at)][np.triu_indices(len(at), 1)]
        d6 = np.maximum(d2[(d2 <= 1) & (d2 > 0)], 0.25) ** 3
        assert got[c] == pytest.approx((1 / d6**2 - 1 / d6).sum())


def test_nearest_of_dense_points(spark):
    rows = _points(600)
    b = _brute(rows, 1.0)
    found = {}
    for r in sp.k_nearest(spark.createDataFrame(rows, SCHEMA), 3, 2.0).collect():
        found.setdefault((r["cell"], r["chrom"], r["pos"]), {})[r["turn"]] = (r["r_chrom"], r["r_pos"])
    for i, r in enumerate(b["rows"]):
        order = sorted((b["d2"][i, j], *o[1:3]) for j, o in enumerate(b["rows"]) if o[0] == r[0] and j != i)[:3]
        assert [found[r[:3]][k] for k in (1, 2, 3)] == [o[1:] for o in order]


def test_dbscan_of_dense_points_writes_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.normal(0, 0.3, (1500, 3)), rng.normal(4, 0.3, (500, 3)), rng.uniform(-6, 8, (120, 3))])
    rows = [("c0", f"chr{i % 3}", i, *map(float, p), 1.0) for i, p in enumerate(xyz)]
    written, real = [], md.written
    monkeypatch.setattr(md, "written", lambda df: written.append(real(df)) or written[-1])
    got = {r["pos"]: r["cluster"] for r in md.dbscan(spark.createDataFrame(rows, SCHEMA), 0.8, 5).collect()}
    assert max(w.count() for w in written) < 20 * len(rows)
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= 0.8 * 0.8
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(xyz)), -1)
    names = [f"c0|chr{i % 3}|{i:012d}" for i in range(len(xyz))]
    rank = np.argsort(np.argsort(names))
    best = np.where(core, rank, len(xyz))
    while True:
        new = np.where(core, np.where(near & core[None], best[None], len(xyz)).min(1), len(xyz))
        if (new == best).all():
            break
        best = new
    border = np.where(near & core[None], best[None], len(xyz)).min(1)
    by_rank = {r: n for r, n in zip(rank, names, strict=True)}
    assert label.max() > 0 and got == {i: by_rank.get(border[i]) for i in range(len(xyz))}


def test_pairwise_all_deals_a_cell_out(spark):
    df = spark.createDataFrame(_points(300), SCHEMA)
    out = sp.pairwise_distances(df, df)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    counts = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    sizes = [r["count"] for r in df.where("cell IS NOT NULL").groupBy("cell").count().collect()]
    assert sum(counts) == sum(s * s for s in sizes) and max(counts) < sum(counts) / 20


def test_first_axis_without_the_matrix(monkeypatch):
    p = np.random.default_rng(2).normal(0, 1, (500, 3)) * [3.0, 1.5, 1.0]
    whole = md._first_axis(p)
    monkeypatch.setattr(md, "WHOLE_MOST", 100)
    found = md._first_axis(p)
    assert np.allclose(found * np.sign(found @ whole), whole, atol=1e-8)


def test_autocorrelation_deals_simulations_out(spark):
    out = md.corrected_correlation(spark.createDataFrame(_points(300), SCHEMA), 0.5, 3.0, 4)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().analyzed().toString()  # pairs go by tiles, not by cell
    assert out.count() == 18 and out.where("cell IS NULL").count() == 6


def test_running_frames_begin_at_an_end(spark):
    """A frame that begins at the row is gone through anew for each row: quadratic in a chromosome or partition."""
    from chromaloom.operators.primitives import adjust_p

    df = spark.createDataFrame(_points(60), SCHEMA)
    out = md.interpolate(df)
    p = df.selectExpr("pos", "1 / (1 + pos) AS p")
    for frame in (out, adjust_p(p, "p", []), adjust_p(p, "p", ["pos"])):
        assert "currentrow$(), unboundedfollowing$()" not in frame._jdf.queryExecution().analyzed().toString()
