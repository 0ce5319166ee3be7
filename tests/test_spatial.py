"""Boundaries of the three-dimensional operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chromaloom.operators import differential as diff
from chromaloom.operators import features as feat
from chromaloom.operators import multicell as mc
from chromaloom.operators import spatial as sp
from chromaloom.operators.coverage import pairs_coverage
from chromaloom.functions.coords import Region

POINTS = "cell string, chrom string, pos bigint, x double, y double, z double, feature double"


def points(spark, rows):
    return spark.createDataFrame([("c", "chr1", i * 10, *map(float, r), float(i)) for i, r in enumerate(rows)], POINTS)


def test_gyration(spark):
    assert sp.gyration(points(spark, [(0, 0, 0), (3, 4, 0), (0, 0, 1)]), ["cell"]).first()["rg"] == pytest.approx(2.403700850)


def test_no_neighbours(spark):
    df = points(spark, [(0, 0, 0), (9, 9, 9)])
    values = [sp.feature_in_radius(df, "feature", 1.0, a, name="v").orderBy("pos").first()["v"] for a in ("sum", "mean", "count")]
    assert values == [0.0, None, 0.0]
    with pytest.raises(ValueError):
        sp.feature_in_radius(df, "feature", 1.0, "mode")


def test_distance_exactly_at_the_threshold(spark):
    df = points(spark, [(0, 0, 0), (3, 0, 0)])
    assert sp.proximity_pairs(df, 3.0).count() == 1
    assert mc.distance_matrix(df, Region("chr1", 0, 100), threshold=3.0).first()["value"] == 0


def test_first_shell_holds_each_point(spark):
    shells = {r["shell"]: r["count"] for r in sp.shell_correlation(points(spark, [(0, 0, 0), (1, 0, 0), (4, 0, 0)]), 1.0, 3.0, 1.0).collect()}
    assert shells == {0: 5, 1: 0, 2: 2}


def test_farthest_point_is_in_no_shell(spark):
    out = sp.radial_distribution(points(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0)]), "feature", 4).orderBy("bin").collect()
    assert [r["mean"] for r in out] == [0.0, 1.0, 0.0, 0.0][: len(out)] or sum(r["mean"] for r in out) == pytest.approx(1.0)


def test_rotation(spark):
    r = sp.rotate(points(spark, [(1, 0, 0)]), (0, 0, 90)).first()
    assert (r["x"], r["y"]) == pytest.approx((0, 1), abs=1e-12)
    assert sp.rotation_matrix(0, 0, 0) == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_rmsd_of_a_moved_copy(spark):
    df = points(spark, [(0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3)])
    moved = sp.rotate(df, (10, 20, 30)).withColumn("x", F.col("x") + 4)
    assert mc.rmsd(df, moved) == pytest.approx(0, abs=1e-6)
    assert mc.rmsd(df, df.limit(0)) is None


def test_fragments(spark):
    f = spark.createDataFrame([("k", 0, 10), ("k", 10, 20), ("k", 21, 30)], "k string, start bigint, end bigint")
    assert sorted((r["start"], r["end"]) for r in feat.merge_overlaps(f, ["k"]).collect()) == [(0, 20), (21, 30)]
    s = spark.createDataFrame([(0, 10, "+"), (0, 10, "-")], "start bigint, end bigint, strand string")
    assert sorted((r["start"], r["end"]) for r in feat.three_prime_ends(s).collect()) == [(0, 1), (9, 10)]


def test_coverage_takes_the_middle_of_near_pairs(spark):
    rows = [("c", "chr1", 100, "chr1", 1100), ("c", "chr1", 100, "chr1", 1101), ("c", "chr1", 100, "chr2", 5)]
    df = spark.createDataFrame(rows, "cell string, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint")
    assert {(r["pos"], r["count"]) for r in pairs_coverage(df, 100).collect()} == {(600, 1), (100, 2)}


def test_false_discovery(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.005,)], "p double")
    assert [r["q"] for r in diff.false_discovery(df, "p").orderBy("p").collect()] == pytest.approx([0.02, 0.02, 0.04, 0.04])


def test_markers_probabilities(spark):
    rows = [(f"c{i}", "chr1", 0, float(v)) for i, v in enumerate([1, 2, 3, 4, 6, 7, 8, 9])]
    values = spark.createDataFrame(rows, "cell string, chrom string, pos bigint, value double")
    groups = spark.createDataFrame([(f"c{i}", 1 if i < 4 else 2) for i in range(8)], "cell string, `group` int")
    r = diff.find_markers(values, groups).first()
    assert r["t"] == pytest.approx(-5.477226, abs=1e-6) and r["p"] == pytest.approx(0.001551, abs=1e-5)
    u = diff.find_markers(values, groups, "manwhitneyu").first()
    assert u["u"] == 0 and u["p"] == pytest.approx(0.030383, abs=1e-5)


def test_k_nearest_widens_its_search(spark):
    df = points(spark, [(0, 0, 0), (1, 0, 0), (50, 0, 0)])
    near = {(r["pos"], r["turn"]): r["distance"] for r in sp.k_nearest(df, 2, 0.5).collect()}
    assert near[(20, 1)] == 49 and near[(20, 2)] == 50 and near[(0, 1)] == 1
    assert math.isclose(sp.knn_density(df, 2, 0.5).where("pos = 0").first()["knn_density"], 1 / 25.5, rel_tol=1e-9)
