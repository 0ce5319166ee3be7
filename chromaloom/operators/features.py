"""Attaching other data to particles, and fetching parts of a structure.

A structure is a frame of particles: the keys (by default ``cell``), chrom, pos,
x, y, z and any features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import Region, bin_start, in_region, midpoint_bin, parse_region
from chromaloom.operators.primitives import interval_join, islands
from chromaloom.sources.shared import written

#: Genes that are broadcast.
BROADCAST_GENES = 1_000_000


def fetch(particles: DataFrame, where: str | Region | tuple, resolution: int | None = None, query: str | None = None, closed: bool = False) -> DataFrame:
    """Particles of a region, snapped to ``resolution`` if given, that satisfy ``query`` (a SQL predicate) too."""
    region = parse_region(where)
    out = particles.where(in_region(region.snapped(resolution) if resolution else region, closed=closed))
    return out.where(query) if query else out


def sphere(particles: DataFrame, center: tuple[float, float, float], radius: float) -> DataFrame:
    d = [F.col(a) - F.lit(float(c)) for a, c in zip("xyz", center, strict=True)]
    return particles.where(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius)


def slab(particles: DataFrame, width: float, axis: str = "x", middle: float = 0.0) -> DataFrame:
    """Particles strictly within half the width of a plane."""
    return particles.where((F.col(axis) > middle - width / 2) & (F.col(axis) < middle + width / 2))


def merge_overlaps(fragments: DataFrame, by: list[str], keep: list[str] | None = None) -> DataFrame:
    """Unions of intervals that overlap or touch, within the columns ``by``: by, start, end."""
    spots = fragments.select(*by, "start", "end").distinct()
    return islands(spots, by, "start", "end", 0, "_run").groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def three_prime_ends(fragments: DataFrame) -> DataFrame:
    """The base at the 3' end: the last on the + strand, else the first."""
    plus = F.col("strand") == "+"
    return fragments.withColumns({"start": F.when(plus, F.col("end") - 1).otherwise(F.col("start")), "end": F.when(plus, F.col("end")).otherwise(F.col("start") + 1)})


def with_alleles(fragments: DataFrame, mode: str = "allelic_resolved") -> DataFrame:
    """Chromosomes with allele letters.

    allelic_resolved: allele 0 is a, else b; allelic_resolved_rev: 1 is a, else
    b; both only for known alleles on chromosomes named chr.  Any other mode
    gives every fragment to both.
    """
    if mode in ("allelic_resolved", "allelic_resolved_rev"):
        first = "0" if mode == "allelic_resolved" else "1"
        known = fragments.where(F.col("chrom").contains("chr") & (F.col("allele") != "."))
        return known.withColumn("chrom", F.concat("chrom", F.when(F.col("allele") == first, "a").otherwise("b")))
    return fragments.withColumn("_letter", F.explode(F.array(F.lit("a"), F.lit("b")))).withColumn("chrom", F.concat("chrom", "_letter")).drop("_letter")


def in_peaks(fragments: DataFrame, peaks: DataFrame, flank: int = 0, bin_size: int = 10_000) -> DataFrame:
    """Fragments that overlap a widened peak; one row for each peak they overlap."""
    wide = peaks.select("chrom", F.greatest(F.col("start") - flank, F.lit(0)).alias("r_start"), (F.col("end") + flank).alias("r_end"))
    return interval_join(fragments, wide, ["chrom"], bin_size).select(*fragments.columns)


def frip(fragments: DataFrame, peaks: DataFrame, flank: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Per cell: fragments, hits in peaks and their ratio."""
    keys = ["cell"] if keys is None else keys
    hits = in_peaks(fragments, peaks, flank).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hits"))
    return fragments.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fragments")).join(hits, keys, "left").select(*keys, "n_fragments", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), (F.coalesce("n_hits", F.lit(0)) / F.col("n_fragments")).alias("frip"))


def bin_fragments(fragments: DataFrame, resolution: int, keys: list[str] | None = None, half_up: bool = False) -> DataFrame:
    """Fragments by the bin of their middle: keys, chrom, pos, count.  ``half_up`` names bins by their middle."""
    keys = ["cell"] if keys is None else keys
    pos = midpoint_bin("start", "end", resolution)
    return fragments.groupBy(*keys, "chrom", (pos + resolution // 2 if half_up else pos).alias("pos")).agg(F.count(F.lit(1)).alias("count"))


def attach(particles: DataFrame, values: DataFrame, value: str, name: str, by: list[str], fill: float | None = 0.0) -> DataFrame:
    """``particles`` with ``value`` as column ``name``; where there is none, ``fill``."""
    out = particles.join(values.select(*by, F.col(value).cast("double").alias("_value")), by, "left").withColumn(name, F.col("_value") if fill is None else F.coalesce("_value", F.lit(fill)))
    return out.select(*[c for c in particles.columns if c != name], name)


def attach_fragments(particles: DataFrame, fragments: DataFrame, name: str, resolution: int, mode: str = "allelic_resolved", keep_3prime: bool = True, merge: bool = True, peaks: DataFrame | None = None, flank: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Number of fragments by particle: merged by strand and allele, cut to their 3' ends, kept in peaks, given to alleles."""
    keys = ["cell"] if keys is None else keys
    found = merge_overlaps(fragments, [*keys, "chrom", "allele", "strand"]) if merge else fragments
    found = three_prime_ends(found) if keep_3prime else found
    found = found if peaks is None else in_peaks(found, peaks, flank)
    return attach(particles, bin_fragments(with_alleles(found, mode), resolution, keys), "count", name, [*keys, "chrom", "pos"])


def attach_bedgraph(particles: DataFrame, track: DataFrame, name: str, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Sum of the values of intervals that overlap a particle's bin (not weighted by length)."""
    keys = [] if keys is None else keys
    spans = particles.select(*keys, "chrom", "pos").distinct().select(*keys, "chrom", F.col("pos").alias("start"), (F.col("pos") + resolution).alias("end"), "pos")
    right = track.select(*keys, "chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "value")
    summed = interval_join(spans, right, [*keys, "chrom"], resolution * 4).groupBy(*keys, "chrom", "pos").agg(F.sum("value").alias("value"))
    return attach(particles, summed, "value", name, [*keys, "chrom", "pos"])


#: The allele letter of each genome in expression tables.
GENOME_LETTER = {"genome1": "b", "genome2": "a"}


def _lettered(rna: DataFrame) -> Column:
    return F.when(F.col("genome") == "genome1", GENOME_LETTER["genome1"]).otherwise(GENOME_LETTER["genome2"])


def attach_rna(particles: DataFrame, rna: DataFrame, genes: DataFrame, name: str, resolution: int, at: str = "tss", keys: list[str] | None = None) -> DataFrame:
    """Expression (cell, gene, genome, umi) by particle.

    tss: summed over the bin that holds the start of transcription.  gene: only
    expressed genes whose start is the particle's position.  Genes without
    annotation are left out.
    """
    keys = ["cell"] if keys is None else keys
    placed = rna.join(genes.select("gene", "chrom", "start", "end", "strand"), "gene").withColumn("chrom", F.concat("chrom", _lettered(rna)))
    if at == "tss":
        pos = bin_start(F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")), resolution)
    elif at == "gene":
        placed, pos = placed.where("umi > 0"), F.col("start")
    else:
        raise ValueError(f"at must be tss or gene, not {at!r}")
    summed = placed.groupBy(*keys, "chrom", pos.alias("pos")).agg(F.sum("umi").alias("umi"))
    return attach(particles, summed, "umi", name, [*keys, "chrom", "pos"])


def bins_of_genes(genes: DataFrame, sizes: DataFrame, resolution: int) -> DataFrame:
    """Every bin (chrom, start, end; the last clipped) with n_genes and gene_ids, joined by ; in order."""
    step = F.lit(resolution).cast("bigint")
    bins = sizes.select("chrom", F.col("size").alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, step)).alias("start")).select("chrom", "start", F.least(F.col("start") + step, "_size").alias("end"))
    right = genes.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("id").alias("_id"))
    hits = interval_join(bins, right, ["chrom"], resolution * 2).groupBy("chrom", "start").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("_id")), ";").alias("ids"))
    return bins.join(hits, ["chrom", "start"], "left").select("chrom", "start", "end", F.coalesce("n", F.lit(0)).alias("n_genes"), F.coalesce("ids", F.lit("")).alias("gene_ids"))


def genes_of_pairs(pairs: DataFrame, genes: DataFrame, keys: list[str] | None = None, bin_size: int = 100_000) -> DataFrame:
    """Cis contacts that lie wholly in a gene: keys, gene, count."""
    keys = ["cell"] if keys is None else keys
    spans = pairs.where("chrom1 = chrom2 AND pos2 > pos1").select(*keys, F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), F.col("pos2").alias("end"))
    right = genes.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"), "gene")
    return interval_join(spans, right, ["chrom"], bin_size, "within").groupBy(*keys, "gene").agg(F.count(F.lit(1)).alias("count"))


def scgad(counts: DataFrame) -> DataFrame:
    """Gene associating domain scores (cell, gene, score) from counts (cell, gene, count), zeros filled.

    Shares of each cell, squared deviations from the gene's mean share, scaled so
    that a cell's sum is the number of cells, square root.
    """
    counts = written(counts.select("cell", "gene", "count"))  # read several times, dear to make
    totals = counts.groupBy("cell").agg(F.sum("count").alias("_total"))
    n_cells = totals.count()
    shares = counts.join(totals, "cell").select("cell", "gene", (F.col("count") / F.col("_total")).alias("_share"))
    means = shares.groupBy("gene").agg((F.sum("_share") / n_cells).alias("_mean"))
    # every cell with every gene is the result's own shape; the genes of a genome are few, and are counted before they are broadcast
    genes = F.broadcast(means) if means.count() <= BROADCAST_GENES else means
    off = F.coalesce("_share", F.lit(0.0)) - F.col("_mean")
    squared = totals.where("_total > 0").select("cell").crossJoin(genes).join(shares, ["cell", "gene"], "left").select("cell", "gene", (off * off).alias("_off"))
    sums = squared.groupBy("cell").agg(F.sum("_off").alias("_sum"))
    return squared.join(sums, "cell").select("cell", "gene", F.sqrt(F.try_divide("_off", F.col("_sum")) * n_cells).alias("score"))


def pair_distances(pairs: DataFrame, particles: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Phased pairs with the distance of their two particles; pairs without both go."""
    keys = ["cell"] if keys is None else keys
    letter = lambda p: F.when(F.col(p) == "0", "a").when(F.col(p) == "1", "b")
    out = pairs.where("phase0 <> '.' AND phase1 <> '.'")
    for i, phase in ((1, "phase0"), (2, "phase1")):
        side = particles.select(*keys, F.col("chrom").alias(f"_chrom{i}"), F.col("pos").alias(f"_pos{i}"), *[F.col(a).cast("double").alias(f"{a}{i}") for a in "xyz"])
        out = out.withColumns({f"_chrom{i}": F.concat(f"chrom{i}", letter(phase)), f"_pos{i}": bin_start(f"pos{i}", resolution)}).join(side, [*keys, f"_chrom{i}", f"_pos{i}"])
    d = [F.col(f"{a}1") - F.col(f"{a}2") for a in "xyz"]
    return out.select(*pairs.columns, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"))
