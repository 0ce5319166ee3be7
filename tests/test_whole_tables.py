"""Queries over whole tables against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from chromaloom.plans import registry
from chromaloom.sources.proxies import view

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("metric, norm", [("euclidean", 2), ("manhattan", 1), ("chebyshev", np.inf)])
def test_pairwise_all_has_every_ordered_pair(spark, metric, norm):
    p = {(r["chrom"], r["pos"]): np.array([r["x"], r["y"], r["z"]]) for r in view(spark, DATA, "tdg").collect()}
    got = {(r["chrom"], r["pos"], r["r_chrom"], r["r_pos"]): r["distance"] for r in registry.queries()[f"pairwise_all_{metric}"](spark, DATA).collect()}
    assert len({c for c, _ in p}) == 10 and len(got) == len(p) ** 2
    for a, b in [(a, b) for a in p for b in list(p)[::50]]:
        assert got[*a, *b] == pytest.approx(np.linalg.norm(p[a] - p[b], norm), abs=1e-9)


def test_gene_regression_has_a_weight_for_every_locus(spark):
    loci = view(spark, DATA, "loci").select("chrom", "pos").distinct().count()
    got = registry.queries()["gene_regression"](spark, DATA).collect()
    assert loci > 100 and {len(r["weights"]) for r in got} == {loci} and len(got) == 60
    assert any(w > 0 for r in got for w in r["weights"][5:])


def test_gene_abc_correlation_all_equals_brute_force(spark):
    umi, score = {}, {}
    for r in view(spark, DATA, "rna").collect():
        umi[r["gene"], r["cell"]] = umi.get((r["gene"], r["cell"]), 0) + r["umi"]
    for r in view(spark, DATA, "loci").collect():
        score.setdefault((r["chrom"], r["pos"]), {})[r["cell"]] = r["value"]
    rank = lambda v: [sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2 for x in v]
    want = {}
    for g in {g for g, _ in umi}:
        for at, s in score.items():
            if both := [(umi[g, c], s[c]) for c in s if (g, c) in umi]:
                a, b = rank([x for x, _ in both]), rank([y for _, y in both])
                want[g, *at] = (len(both), np.corrcoef(a, b)[0, 1] if len(set(a)) > 1 and len(set(b)) > 1 else None)
    got = {(r["gene"], r["chrom"], r["pos"]): r for r in registry.queries()["gene_abc_correlation_all"](spark, DATA).collect()}
    assert len({g for g, _, _ in got}) == 60 and len({c for _, c, _ in got}) == 3 and got.keys() == want.keys()
    for k, (n, rho) in want.items():
        assert got[k]["n"] == n
        assert got[k]["rho"] == (None if rho is None else pytest.approx(rho, abs=1e-9))


def test_autocorrelation_and_bootstrap_take_the_reference_range_and_draws(spark):
    shells = registry.queries()["spatial_autocorrelation"](spark, DATA).groupBy("cell").count().collect()
    assert len(shells) == 5 and {r["count"] for r in shells} == {20}  # up to 10.0 by 0.5
    shares = [r["share"] for r in registry.queries()["bootstrap_shares"](spark, DATA).collect()]
    assert any(abs(s * 100 - round(s * 100)) > 1e-6 for s in shares) and all(abs(s * 5000 - round(s * 5000)) < 1e-6 for s in shares)
