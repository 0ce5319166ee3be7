"""Cleaning of contact pairs and structures.

Frames hold one or many cells: ``keys`` (by default ``cell``) separate what must
not mix.  Every operator takes and returns DataFrames and triggers no job,
unless its docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import bare_chromosome, without_haplotype
from chromaloom.operators.primitives import chain_numbers, count_in_range, covering_end

#: Least phase probability of a phased contact.
PHASED = 0.75
#: The suffixes that phases 0 and 1 give a chromosome.
SUFFIX = {"0": "(pat)", "1": "(mat)"}
#: Exons, a row for each bin they touch, that are broadcast; bins of that width.
BROADCAST_EXONS, EXON_BIN = 1_000_000, 100_000
PHASE_COLUMNS = ["phase_prob00", "phase_prob01", "phase_prob10", "phase_prob11"]


def legs(pairs: DataFrame, keep: list[str]) -> DataFrame:
    """Both legs of every pair as rows: ``keep``, chrom, pos and leg (1 or 2).  One scan."""
    both = F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"pos{i}").alias("pos"), F.lit(i).alias("leg")) for i in (1, 2)])
    return pairs.select(*keep, F.explode(both).alias("_leg")).select(*keep, "_leg.*")


def promiscuous_positions(pairs: DataFrame, distance: int = 1000, most: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Positions (keys, chrom, pos) with more than ``most`` legs within ``distance``, the leg itself included."""
    keys = ["cell"] if keys is None else keys
    places = legs(pairs, keys).groupBy(*keys, "chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    return count_in_range(places, [*keys, "chrom"], "pos", "n", distance, distance, "n_near").where(F.col("n_near") > most).select(*keys, "chrom", "pos", "n_near")


def clean_legs(pairs: DataFrame, distance: int = 1000, most: int = 15, keys: list[str] | None = None) -> DataFrame:
    """Pairs without a leg at a promiscuous position.

    Equal positions are summed first, so a position that holds a third of all legs is one row in its window.
    """
    keys = ["cell"] if keys is None else keys
    bad = promiscuous_positions(pairs, distance, most, keys)
    out = pairs
    for i in (1, 2):
        out = out.join(bad.select(*keys, F.col("chrom").alias(f"chrom{i}"), F.col("pos").alias(f"pos{i}")), [*keys, f"chrom{i}", f"pos{i}"], "left_anti")
    return out.select(*pairs.columns)


def clean_isolated(pairs: DataFrame, distance: int = 10_000_000, dense: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Pairs with ``dense`` other contacts at least in their L0.5 ball: (sqrt|d1| + sqrt|d2|)^2 <= distance.

    The ball lies in the square of that side, so contacts meet in a grid of such
    cells on both axes: within a cell, and with the four of the eight cells around
    that lie ahead, where a meeting counts for both.  Equal contacts are summed first.
    """
    keys = ["cell"] if keys is None else keys
    by = [*keys, "chrom1", "chrom2"]
    points = pairs.groupBy(*by, "pos1", "pos2").agg(F.count(F.lit(1)).alias("n"))
    cell = lambda c: F.floor(F.col(c) / distance)
    ahead = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    here = points.select(*by, "pos1", "pos2", "n", cell("pos1").alias("_a"), cell("pos2").alias("_b"))
    there = points.withColumn("_d", ahead).select(*by, F.col("pos1").alias("_q1"), F.col("pos2").alias("_q2"), F.col("n").alias("_m"), (cell("pos1") + F.col("_d.a")).alias("_a"), (cell("pos2") + F.col("_d.b")).alias("_b"), ((F.col("_d.a") == 0) & (F.col("_d.b") == 0)).alias("_own"))
    reach = F.sqrt(F.abs(F.col("pos1") - F.col("_q1"))) + F.sqrt(F.abs(F.col("pos2") - F.col("_q2")))
    # the square of a sum of square roots may miss its true value by a little
    met = here.join(there, [*by, "_a", "_b"]).where(reach * reach <= distance * (1 + 1e-12))
    one = lambda x, y, n: F.struct(F.col(x).alias("pos1"), F.col(y).alias("pos2"), F.col(n).alias("n"))
    both = F.when(F.col("_own"), F.array(one("pos1", "pos2", "_m"))).otherwise(F.array(one("pos1", "pos2", "_m"), one("_q1", "_q2", "n")))
    crowded = met.select(*by, F.explode(both).alias("_p")).groupBy(*by, "_p.pos1", "_p.pos2").agg(F.sum("_p.n").alias("n_near")).where(F.col("n_near") >= dense + 1)
    return pairs.join(crowded.drop("n_near"), [*by, "pos1", "pos2"], "left_semi").select(*pairs.columns)


def exons_of(gtf: DataFrame) -> DataFrame:
    """chrom, start and end of the exons that HAVANA annotated."""
    return gtf.where((F.col("feature") == "exon") & (F.col("source") == "HAVANA")).select(F.col("seqname").alias("chrom"), "start", "end")


def clean_splicing(pairs: DataFrame, exons: DataFrame, block: int = 1_000_000, most: int = BROADCAST_EXONS) -> DataFrame:
    """Pairs of which no exon holds both legs: start < lower leg and upper leg <= end, on one chromosome.

    Exons are counted (a job over them): while few, they are broadcast by the bins
    they touch and the pairs stay where they are; more of them meet the pairs'
    positions in windows over blocks.
    """
    low, high = F.least("pos1", "pos2"), F.greatest("pos1", "pos2")
    first, last = F.floor((F.col("start") + 1) / EXON_BIN), F.floor(F.col("end") / EXON_BIN)
    binned = exons.where("end > start").select(F.col("chrom").alias("_chrom"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(F.sequence(first, F.greatest(first, last))).alias("_bin"))
    if binned.count() <= most:
        inside = (F.col("chrom1") == F.col("chrom2")) & (F.col("chrom1") == F.col("_chrom")) & (F.floor(low / EXON_BIN) == F.col("_bin")) & (F.col("_start") < low) & (F.col("_end") >= high)
        return pairs.join(F.broadcast(binned), inside, "left_anti")
    cis = pairs.where(F.col("chrom1") == F.col("chrom2")).withColumn("chrom", F.col("chrom1")).withColumn("_low", low)
    kept = covering_end(exons.select("chrom", "start", "end"), cis, ["chrom"], "_low", block, "_reach").where(F.col("_reach").isNull() | (F.col("_reach") < high))
    return kept.select(*pairs.columns).unionByName(pairs.where(~F.col("chrom1").eqNullSafe(F.col("chrom2"))))


def phased(pairs: DataFrame, least: float = PHASED) -> DataFrame:
    """Pairs whose greatest phase probability reaches ``least``; all of them when a probability column is missing."""
    if not set(PHASE_COLUMNS) <= set(pairs.columns):
        return pairs
    return pairs.where(F.greatest(*[F.col(c).try_cast("double") for c in PHASE_COLUMNS]) >= least)


def separate_haplotypes(pairs: DataFrame, least: float = PHASED) -> tuple[DataFrame, DataFrame]:
    """(diploid, phased): a copy of a pair for each phase code that reaches ``least``, with its phases set.

    Chromosomes of the diploid copy bear the suffixes of their phases.
    """
    codes = ("00", "01", "10", "11")
    found = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"phase_prob{c}").try_cast("double").alias("p")) for c in codes]), lambda s: s["p"] >= least)
    copies = pairs.withColumn("_code", F.explode(found)).withColumn("phase0", F.substring("_code.code", 1, 1)).withColumn("phase1", F.substring("_code.code", 2, 1)).drop("_code")
    suffix = lambda p: F.when(F.col(p) == "0", SUFFIX["0"]).otherwise(SUFFIX["1"])
    diploid = copies.withColumn("chrom1", F.concat("chrom1", suffix("phase0"))).withColumn("chrom2", F.concat("chrom2", suffix("phase1")))
    return diploid, copies


def separate_and_clean(pairs: DataFrame, distance: int = 10_000_000, dense: int = 5, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both haplotype frames without isolated contacts."""
    diploid, copies = separate_haplotypes(pairs)
    return clean_isolated(diploid, distance, dense, keys), clean_isolated(copies, distance, dense, keys)


def without_haplotypes(pairs: DataFrame) -> DataFrame:
    """Chromosomes reduced to chr and number, X or Y."""
    return pairs.withColumn("chrom1", bare_chromosome("chrom1")).withColumn("chrom2", bare_chromosome("chrom2"))


def evidence(particles: DataFrame, pairs: DataFrame, radius: int, keys: list[str] | None = None) -> DataFrame:
    """``particles`` (keys, chrom, pos, ...) with n_legs: legs in [pos - radius, pos + radius).

    A particle's chromosome is looked for among the legs' as it is, else without
    its haplotype suffix, else, if it bears none, with either suffix.
    """
    keys = ["cell"] if keys is None else keys
    places = legs(pairs, keys).groupBy(*keys, "chrom", "pos").agg(F.count(F.lit(1)).alias("n"))
    named = places.select(*keys, F.col("chrom").alias("_leg_chrom")).distinct()
    asked = particles.select(*keys, "chrom").distinct()
    forms = F.array(
        F.struct(F.lit(0).alias("turn"), F.col("chrom").alias("_leg_chrom")),
        F.struct(F.lit(1).alias("turn"), F.when(without_haplotype("chrom") != F.col("chrom"), without_haplotype("chrom")).alias("_leg_chrom")),
        F.struct(F.lit(2).alias("turn"), F.when(without_haplotype("chrom") == F.col("chrom"), F.concat("chrom", F.lit(SUFFIX["1"]))).alias("_leg_chrom")),
        F.struct(F.lit(2).alias("turn"), F.when(without_haplotype("chrom") == F.col("chrom"), F.concat("chrom", F.lit(SUFFIX["0"]))).alias("_leg_chrom")),
    )
    tried = asked.select(*keys, "chrom", F.explode(forms).alias("_f")).select(*keys, "chrom", "_f.*").where(F.col("_leg_chrom").isNotNull()).join(named, [*keys, "_leg_chrom"])
    first = tried.groupBy(*keys, "chrom").agg(F.min("turn").alias("turn"))
    resolved = tried.join(first, [*keys, "chrom", "turn"]).select(*keys, "chrom", "_leg_chrom")
    seen = places.withColumnRenamed("chrom", "_leg_chrom").join(resolved, [*keys, "_leg_chrom"]).select(*keys, "chrom", "pos", F.col("n"), F.lit(0).alias("_particle"))
    spots = particles.select(*keys, "chrom", "pos").distinct().select("*", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("_particle"))
    both = seen.unionByName(spots).groupBy(*keys, "chrom", "pos").agg(F.sum("n").alias("n"), F.max("_particle").alias("_particle"))
    counted = count_in_range(both, [*keys, "chrom"], "pos", "n", radius, radius - 1, "n_legs").where("_particle = 1").select(*keys, "chrom", "pos", "n_legs")
    return particles.join(counted, [*keys, "chrom", "pos"], "left").select(*particles.columns, F.coalesce("n_legs", F.lit(0)).cast("bigint").alias("n_legs"))


def clean_structure(particles: DataFrame, pairs: DataFrame, quantile: float = 0.06, radius: int = 500_000, backbone_unit: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Particles with more legs than the ``quantile`` (linear) of their cell; coordinates in units of the backbone."""
    keys = ["cell"] if keys is None else keys
    counted = evidence(particles, phased(pairs), radius, keys)
    gate = counted.groupBy(*keys).agg(F.percentile("n_legs", F.lit(quantile)).alias("_gate"))
    kept = counted.join(gate, keys) if keys else counted.join(F.broadcast(gate))
    scaled = {c: F.col(c) / backbone_unit for c in ("x", "y", "z")}
    return kept.where(F.col("n_legs") > F.col("_gate")).withColumns(scaled).select(*particles.columns, "n_legs")


def dedup_pairs(pairs: DataFrame, order: str = "read_id", gap: int = 500, keys: list[str] | None = None) -> DataFrame:
    """The first pair, by ``order``, of those whose legs fall into the same two chains of positions ``gap`` apart."""
    keys = ["cell"] if keys is None else keys
    out = pairs
    for i in (1, 2):
        by = [*keys, f"chrom{i}"]
        out = out.join(chain_numbers(pairs, by, f"pos{i}", gap, f"_chain{i}"), [*by, f"pos{i}"])
    names = [*keys, "chrom1", "chrom2", "_chain1", "_chain2"]
    # a group's first row is taken before the shuffle already, so a large group sends one row from each task
    first = F.row_number().over(W.partitionBy(*names).orderBy(order))
    return out.withColumn("_turn", first).where("_turn = 1").select(*pairs.columns)


def removed_share(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after and the percentage removed."""
    counts = before.agg(F.count(F.lit(1)).alias("n_before")).withColumn("_k", F.lit(1)).join(after.agg(F.count(F.lit(1)).alias("n_after")).withColumn("_k", F.lit(1)), "_k")
    return counts.select("n_before", "n_after", F.try_divide((F.col("n_before") - F.col("n_after")) * 100.0, F.col("n_before")).alias("removed_percent"))


def sort_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in the order of chromosomes, positions and strands (a range-partitioned sort)."""
    by = [c for c in ("chrom1", "chrom2", "pos1", "pos2", "strand1", "strand2") if c in pairs.columns]
    return pairs.dropDuplicates(by).orderBy(*by)
