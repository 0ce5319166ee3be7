"""Cells as objects, domains, repeated tests, and the kernels that work in blocks."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chromaloom.cells import Cell, MultiCell, load_cells, template_names
from chromaloom.functions.numeric import kabsch
from chromaloom.operators import differential as diff
from chromaloom.operators import domains as dm
from chromaloom.operators import multicell as mc
from chromaloom.operators.primitives import adjust_p, chains, interval_join, islands
from chromaloom.sources import writers as wr


def particles(spark, cells=("a", "b", "c"), n=6, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(c, f"chr{1 + i % 2}a", 20_000 * (i // 2), *map(float, rng.normal(size=3)), float(i)) for c in cells for i in range(n)]
    return spark.createDataFrame(rows, "cell string, chrom string, pos bigint, x double, y double, z double, signal double")


def test_cells_as_objects(spark, tmp_path):
    data = particles(spark)
    cells = MultiCell.of(data, 20_000)
    assert cells.names == ("a", "b", "c") and len(cells) == 3 and cells.features == ["signal"]
    assert isinstance(cells[1], Cell) and len(cells[1]) == 6 and "b" in repr(cells[1]) and cells[1:].names == ("b", "c")
    assert cells.subset(["c", "a"]).names == ("c", "a")
    with pytest.raises(KeyError):
        cells.get_cell("none")
    with pytest.raises(ValueError):
        cells[0].feature_vector("none")
    with_table = cells.with_table("t", data.select("cell", "signal"))
    assert with_table.table_names() == ["t"] and cells.table_names() == [] and with_table.without_table("t").table_names() == []
    with pytest.raises(KeyError):
        cells.table("t")
    base = str(tmp_path / "cells")
    wr.store_structures(data, base)
    (tmp_path / "cells" / "d").mkdir()
    (tmp_path / "cells" / "d" / "d.3dg").write_text("not a structure\n")
    found = load_cells(spark, f"{base}/*/*.3dg", 20_000)
    assert found.names == ("a", "b", "c") and found.get_data("chr1a:0-20000").count() == 3
    assert load_cells(spark, f"{base}/*/*.3dg", 20_000, ["b", "zz"]).names == ("b",)
    with pytest.raises(ValueError):
        wr.write_xyz(data, str(tmp_path / "x"))
    names = template_names(spark.createDataFrame([("k",), ("q",)], "n string"), "n", spark.createDataFrame([("k", 1), ("k", 1)], "key string, v int"), "key", "v")
    assert {(r["n"], r["value"]) for r in names.collect()} == {("k", 1), ("q", None)}


def test_boundaries_equal_all_segmentations():
    rng = np.random.default_rng(1)
    m = rng.poisson(3.0, (6, 6)).astype(float)
    m = np.triu(m) + np.triu(m, 1).T
    good = np.array([True, True, True, False, True, True])
    s = dm.segment_scores(m, 1.3, good)
    a = np.where(good[:, None] & good[None], m, 0)
    k, total = a.sum(0), a.sum()
    plain = lambda i, j: sum((a[p, q] - 1.3 * k[p] * k[q] / total) / total for p in range(i, j) for q in range(i, j))
    weights, at = 0.0, np.zeros(7)
    for r in range(6):
        for inner in itertools.combinations(range(1, 6), r):
            cuts = [0, *inner, 6]
            w = np.exp(4.0 * sum(plain(i, j) for i, j in itertools.pairwise(cuts)))
            weights += w
            at[cuts] += w
    assert np.allclose(dm.boundary_marginals(s, 4.0), at / weights)


def test_hidden_states_are_found():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 2, 1, 0, 2], 40)
    x = np.stack([rng.normal(truth * 5.0, 0.5), rng.normal(-truth, 0.3)], 1)
    model = dm.GaussianHmm(3).fit(x)
    assert (model.states_of(x) == truth).mean() > 0.98 and np.allclose(model.step.sum(1), 1)


def test_all_pairs_of_structures(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(8, 3))
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    shapes = {"a": base, "b": -base @ turn + 5, "c": rng.normal(size=(9, 3))}
    rows = [(c, "chr1", i, *map(float, p)) for c, s in shapes.items() for i, p in enumerate(s)]
    got = {(r["cell1"], r["cell2"]): (r["n"], r["rmsd"]) for r in mc.all_rmsd(spark.createDataFrame(rows, "cell string, chrom string, pos bigint, x double, y double, z double")).collect()}
    assert got["a", "b"][0] == 8 and got["a", "b"][1] == pytest.approx(0, abs=1e-6)
    want = min(kabsch(base, shapes["c"][:8])[1], kabsch(base, -shapes["c"][:8])[1])
    assert got["a", "c"][1] == pytest.approx(want)


def test_runs_and_chains_cross_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), s := rng.randrange(0, 3000), s + rng.choice([0, 5, 40, 900 if rng.random() < 0.05 else 10])) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    got = {(r["k"], r["s"], r["e"]): r["island"] for r in islands(df, ["k"], "s", "e", 3, block=100).collect()}
    linked = {(r["k"], r["s"]): r["c"] for r in chains(df, ["k"], "s", 7, "c", block=64).collect()}
    for k in "xy":
        n, reach = 0, None
        for s, e in sorted({(s, e) for kk, s, e in rows if kk == k}):
            if reach is None or s > reach + 3:
                n += 1
            reach = e if reach is None else max(reach, e)
            assert got[k, s, e] == n
        n, last = 0, None
        for s in sorted({s for kk, s, _ in rows if kk == k}):
            n += last is None or s - last > 7
            last = s
            assert linked[k, s] == n


def test_interval_joins_keep_whole_rows(spark):
    left = spark.createDataFrame([("c", 0, 10, 1), ("c", 0, 10, 1), ("c", 20, 30, 2), (None, 0, 5, 3)], "chrom string, start bigint, end bigint, v int")
    right = spark.createDataFrame([("c", 5, 25)], "chrom string, r_start bigint, r_end bigint")
    assert sorted(r["v"] for r in interval_join(left, right, ["chrom"], 4, how="left_semi").collect()) == [1, 1, 2]
    assert [r["v"] for r in interval_join(left, right, ["chrom"], 4, how="left_anti").collect()] == [3]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_corrections_with_ties(spark, keys):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], rng.choice([0.01, 0.02, 0.5, 1.0, None, rng.random()])) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, g string, p double")
    for method in ("fdr", "bonferroni", "holm"):
        got = {r["i"]: r["q"] for r in adjust_p(df, "p", keys, method).collect()}
        for g in "ab" if keys else [None]:
            some = sorted((p, i) for i, gg, p in rows if p is not None and g in (None, gg))
            n, ps = len(some), [p for p, _ in some]
            for p, i in some:
                last, first = sum(x <= p for x in ps), sum(x < p for x in ps) + 1
                want = {"bonferroni": n * p, "holm": (n - first + 1) * p, "fdr": min(n / sum(x <= y for x in ps) * y for y in ps if y >= p)}[method]
                assert got[i] == pytest.approx(want), (method, last)
        assert all(got[i] is None for i, _, p in rows if p is None)


def test_dealt_groups(spark):
    cells = spark.createDataFrame([(f"c{i}",) for i in range(7)], "cell string")
    groups = cells.withColumn("group", F.when(F.col("cell") < "c3", 1).otherwise(2))
    count = lambda df: {(r["trial"], r["group"]): r["count"] for r in df.groupBy("trial", "group").count().collect()}
    assert count(diff.dealt_groups(cells, "celltype", groups)) == {(1, 1): 3, (1, 2): 4}
    assert count(diff.dealt_groups(cells, "random", trials=2)) == {(31, 1): 4, (31, 2): 3, (32, 1): 4, (32, 2): 3}
    assert count(diff.dealt_groups(cells, "sample", groups, sizes=(2, 9))) == {(2, 1): 2, (2, 2): 4, (9, 1): 3, (9, 2): 4}
    assert diff.dealt_groups(cells, "allele").where("group = 2 AND cell = 'c1b'").count() == 1
    for bad in ("celltype", "none"):
        with pytest.raises(ValueError):
            diff.dealt_groups(cells, bad)
