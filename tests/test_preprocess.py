"""Micro fixtures of the cleaning steps, and properties against brute force."""

from __future__ import annotations

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chromaloom.operators import preprocess as pre
from chromaloom.operators.primitives import chains, interval_join

PAIRS = "cell string, read_id string, chrom1 string, pos1 bigint, chrom2 string, pos2 bigint"


def frame(spark, rows):
    return spark.createDataFrame([("c", str(i), *r) for i, r in enumerate(rows, 1)], PAIRS)


def ids(df):
    return sorted(int(r["read_id"]) for r in df.collect())


def test_promiscuous_legs(spark):
    pairs = frame(spark, [("chr1", 100, "chr1", 5000), ("chr1", 600, "chr2", 100), ("chr1", 1100, "chr2", 9000), ("chr1", 2101, "chr2", 20000)])
    assert ids(pre.clean_legs(pairs, 1000, 2)) == [4]
    assert ids(pre.clean_legs(pairs, 1000, 3)) == [1, 2, 3, 4]


def test_isolated_contacts_on_the_boundary(spark):
    pairs = frame(spark, [("chr1", 0, "chr1", 0), ("chr1", 25, "chr1", 25), ("chr1", 36, "chr1", 25), ("chr1", 1000, "chr1", 1000)])
    assert ids(pre.clean_isolated(pairs, 100, 1)) == [1, 2, 3]
    assert ids(pre.clean_isolated(pairs.limit(0), 100, 1)) == []


def test_contacts_in_an_exon(spark):
    pairs = frame(spark, [("chr1", a, "chr1", b) for a, b in [(101, 200), (100, 150), (150, 201), (190, 250), (150, 250)]])
    exons = spark.createDataFrame([("chr1", 100, 200), ("chr1", 180, 300)], "chrom string, start bigint, end bigint")
    assert ids(pre.clean_splicing(pairs, exons, 64)) == [2, 3, 5]


def test_evidence_is_half_open_and_resolves_chromosomes(spark):
    pairs = frame(spark, [("chr1", 89, "chr1", 90), ("chr1", 109, "chr1", 110)])
    particles = spark.createDataFrame([("c", "chr1", 100), ("c", "chr1(pat)", 100), ("c", "chr2", 100)], "cell string, chrom string, pos bigint")
    found = {r["chrom"]: r["n_legs"] for r in pre.evidence(particles, pairs, 10).collect()}
    assert found == {"chr1": 2, "chr1(pat)": 2, "chr2": 0}


def test_duplicates_by_chains(spark):
    pairs = frame(spark, [("chr1", 0, "chr1", 7), ("chr1", 500, "chr1", 7), ("chr1", 1001, "chr1", 7)])
    assert ids(pre.dedup_pairs(pairs)) == [1, 3]


def test_haplotypes(spark):
    row = [("c", "1", "chr1", 1, "chr2", 2, ".", ".", 0.1, 0.75, 0.1, 0.05)]
    pairs = spark.createDataFrame(row, PAIRS + ", phase0 string, phase1 string, phase_prob00 double, phase_prob01 double, phase_prob10 double, phase_prob11 double")
    diploid, phased = pre.separate_haplotypes(pairs)
    r = diploid.first()
    assert (r["chrom1"], r["chrom2"], r["phase0"], r["phase1"]) == ("chr1(pat)", "chr2(mat)", "0", "1")
    assert phased.first()["chrom1"] == "chr1"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 40), st.integers(0, 5))
def test_leg_counts_equal_search(spark, positions, distance, most):
    rows = [("chr1", p, "chr2", i * 10_000) for i, p in enumerate(positions)]
    kept = ids(pre.clean_legs(frame(spark, rows), distance, most))
    x = np.sort(positions)
    near = [np.searchsorted(x, p + distance, "right") - np.searchsorted(x, p - distance, "left") for p in positions]
    assert kept == [i for i, n in enumerate(near, 1) if n <= most and (1 <= most)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(1, 60)), max_size=25), st.lists(st.tuples(st.integers(0, 200), st.integers(1, 60)), max_size=25), st.sampled_from(["overlap", "within", "contain"]))
def test_interval_join_equals_nested_loop(spark, left, right, mode):
    a = spark.createDataFrame([("k", i, s, s + n) for i, (s, n) in enumerate(left)], "k string, i int, start bigint, end bigint")
    b = spark.createDataFrame([("k", j, s, s + n) for j, (s, n) in enumerate(right)], "k string, j int, r_start bigint, r_end bigint")
    found = sorted((r["i"], r["j"]) for r in interval_join(a, b, ["k"], 16, mode).collect())
    test = {"overlap": lambda s, e, t, f: s < f and t < e, "within": lambda s, e, t, f: t <= s and e <= f, "contain": lambda s, e, t, f: s <= t and f <= e}[mode]
    assert found == sorted((i, j) for i, (s, n) in enumerate(left) for j, (t, m) in enumerate(right) if test(s, s + n, t, t + m))


def test_chains_of_an_empty_table(spark):
    assert chains(spark.createDataFrame([], "k string, pos bigint"), ["k"], "pos", 5, "n").count() == 0
