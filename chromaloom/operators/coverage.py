"""Counts of contacts and fragments along the genome, and summaries of contacts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import bin_start, midpoint_bin
from chromaloom.operators.preprocess import legs
from chromaloom.operators.primitives import densify, interval_join, points_in_intervals


def cpm(value: str, keys: list[str]) -> Column:
    """Value per million of the sum over ``keys``."""
    return F.try_divide(F.col(value) * 1e6, F.sum(value).over(W.partitionBy(*keys)))


def _scaled(binned: DataFrame, keys: list[str]) -> DataFrame:
    """cpm by a join with the sums: no window gathers a cell's bins in one task."""
    totals = binned.groupBy(*keys).agg(F.sum("count").alias("_total"))
    out = binned.join(totals, keys) if keys else binned.join(F.broadcast(totals))
    return out.withColumn("cpm", F.try_divide(F.col("count") * 1e6, F.col("_total"))).drop("_total")


def pairs_to_bedgraph(pairs: DataFrame, resolution: int, sizes: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Legs by bin: keys, chrom, pos, count and cpm; on the full grid (0 where empty) when ``sizes`` (chrom, size) is given."""
    keys = ["cell"] if keys is None else keys
    binned = legs(pairs, keys).groupBy(*keys, "chrom", bin_start("pos", resolution).alias("pos")).agg(F.count(F.lit(1)).alias("count"))
    return _scaled(_on_grid(binned, pairs, sizes, resolution, keys), keys)


def bed_to_bedgraph(bed: DataFrame, resolution: int, sizes: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Fragments by the bin of their middle."""
    keys = ["cell"] if keys is None else keys
    binned = bed.groupBy(*keys, "chrom", midpoint_bin("start", "end", resolution).alias("pos")).agg(F.count(F.lit(1)).alias("count"))
    return _scaled(_on_grid(binned, bed, sizes, resolution, keys), keys)


def _on_grid(binned: DataFrame, source: DataFrame, sizes: DataFrame | None, resolution: int, keys: list[str]) -> DataFrame:
    if sizes is None:
        return binned
    extents = sizes.select("chrom", "size")
    if keys:
        # few chromosomes for every cell: a constant key keeps this an equi-join
        extents = source.select(*keys).distinct().withColumn("_k", F.lit(1)).join(extents.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return densify(binned, extents, [*keys, "chrom"], "size", resolution, ["count"])


def pairs_coverage(pairs: DataFrame, resolution: int, near: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """One position for each pair: the middle of legs ``near`` apart at most on one chromosome, else the first leg."""
    keys = ["cell"] if keys is None else keys
    far = (F.col("chrom1") != F.col("chrom2")) | (F.abs(F.col("pos1") - F.col("pos2")) > near)
    pos = F.when(far, F.col("pos1")).otherwise(F.floor((F.col("pos1") + F.col("pos2")) / 2))
    return pairs.groupBy(*keys, F.col("chrom1").alias("chrom"), bin_start(pos, resolution).alias("pos")).agg(F.count(F.lit(1)).alias("count"))


def _share(condition: Column, of: Column | None = None) -> Column:
    hits = F.sum(F.when(condition, 1).otherwise(0))
    return F.try_divide(hits.cast("double"), F.count(F.lit(1)) if of is None else of)


def pairs_describe(pairs: DataFrame, near: int = 1000, keys: list[str] | None = None) -> DataFrame:
    """n_pairs, trans_ratio and near_ratio (cis with pos2 - pos1 < ``near``, signed, of all pairs)."""
    keys = ["cell"] if keys is None else keys
    cis = F.col("chrom1") == F.col("chrom2")
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), _share(~cis).alias("trans_ratio"), _share(cis & (F.col("pos2") - F.col("pos1") < near)).alias("near_ratio"))


def few_contacts(pairs: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """Pairs of cells that have more than ``most`` contacts."""
    keys = ["cell"] if keys is None else keys
    rich = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys)
    return pairs.join(rich, keys, "left_semi").select(*pairs.columns)


def merge_pairs(*frames: DataFrame) -> DataFrame:
    """All pairs of several frames in sorted order."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.orderBy("chrom1", "chrom2", "pos1", "pos2")


def segments_to_pairs(lines: DataFrame, mapq: int = 20) -> DataFrame:
    """Contacts of segment lines (value): first and last segment, if both map better than ``mapq``."""
    fields = F.split("value", "\t")
    part = lambda c, i: F.get(F.split(c, "!"), F.lit(i))
    both = lines.select(F.get(fields, F.lit(0)).alias("read_id"), F.get(fields, F.lit(1)).alias("a"), F.element_at(fields, -1).alias("b"), F.size(fields).alias("_n")).where("_n > 1")
    middle = lambda c: F.floor((part(c, 1).cast("bigint") + part(c, 2).cast("bigint")) / 2)
    good = (part("a", 5).try_cast("int") > mapq) & (part("b", 5).try_cast("int") > mapq)
    return both.where(good).select("read_id", part("a", 0).alias("chrom1"), middle("a").alias("pos1"), part("b", 0).alias("chrom2"), middle("b").alias("pos2"))


def remove_regions(pairs: DataFrame, regions: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Pairs without a leg in any region (chrom, start, end), by position rather than by row."""
    out = pairs
    bounds = regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    for i in (1, 2):
        spots = pairs.select(F.col(f"chrom{i}").alias("chrom"), F.col(f"pos{i}").alias("pos")).distinct()
        hit = points_in_intervals(spots, bounds, ["chrom"], "pos", bin_size).select(F.col("chrom").alias(f"chrom{i}"), F.col("pos").alias(f"pos{i}")).distinct()
        out = out.join(hit, [f"chrom{i}", f"pos{i}"], "left_anti")
    return out.select(*pairs.columns)


def contacts_in_regions(pairs: DataFrame, regions: DataFrame, pair_id: list[str], bin_size: int = 100_000) -> DataFrame:
    """Pairs with a leg in one region and the other in another: region1, region2 (as chrom, start, end) and n_contacts."""
    bounds = regions.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = []
    for i in (1, 2):
        spots = pairs.select(*pair_id, F.col(f"chrom{i}").alias("chrom"), F.col(f"pos{i}").alias("pos"))
        hit = points_in_intervals(spots, bounds, ["chrom"], "pos", bin_size)
        found.append(hit.select(*pair_id, F.col("chrom").alias(f"chrom{i}"), F.col("r_start").alias(f"start{i}"), F.col("r_end").alias(f"end{i}")))
    by = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
    return found[0].join(found[1], pair_id).select(*pair_id, *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_contacts"))


def trans_ratio_per_bin(pairs: DataFrame, bins: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Per bin (chrom, start, end): legs in it and the share of them whose pair spans two chromosomes."""
    trans = pairs.withColumn("_trans", (F.col("chrom1") != F.col("chrom2")).cast("int"))
    spots = legs(trans, ["_trans"])
    bounds = bins.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = points_in_intervals(spots, bounds, ["chrom"], "pos", bin_size)
    return found.groupBy("chrom", F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.count(F.lit(1)).alias("n_legs"), F.avg("_trans").alias("trans_ratio"))


def tss_enrichment(tss: DataFrame, fragments: DataFrame, bin_size: int = 100, flank: int = 2000) -> DataFrame:
    """Middle bin over the mean of the first and last, of the bases that fragments cover around TSSs (chrom, tss).

    Overlap lengths by bin stand for the bases, so no row is made for a base.
    """
    half = flank + bin_size // 2
    windows = tss.select("chrom", F.greatest(F.col("tss") - half, F.lit(0)).alias("r_start"), (F.col("tss") + half).alias("r_end"))
    hits = interval_join(fragments.select("chrom", "start", "end"), windows, ["chrom"], 16 * half)
    low, high = F.greatest(F.col("start") - F.col("r_start"), F.lit(0)), F.least(F.col("end") - F.col("r_start"), F.lit(2 * half))
    n = -(-2 * half // bin_size)
    covered = lambda i: F.sum(F.greatest(F.least(high, F.lit(min((i + 1) * bin_size, 2 * half))) - F.greatest(low, F.lit(i * bin_size)), F.lit(0)))
    means = hits.agg(*[(covered(i) / (min((i + 1) * bin_size, 2 * half) - i * bin_size)).alias(name) for i, name in ((0, "first"), (n // 2, "middle"), (n - 1, "last"))])
    return means.select("first", "middle", "last", F.try_divide("middle", (F.col("first") + F.col("last")) * 0.5).alias("enrichment"))


def pileup(signal: DataFrame, centers: DataFrame, resolution: int, flank: int) -> DataFrame:
    """``signal`` (chrom, pos, value) in bins around each center (chrom, start, end); incomplete windows are left out.

    Returns the centers' columns, offset (in bins, 0 the middle) and value.
    """
    reach = flank // resolution
    middle = midpoint_bin("start", "end", resolution)
    asked = centers.select(*centers.columns, middle.alias("_middle"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("pos", F.col("_middle") + F.col("offset") * resolution)
    found = asked.join(signal.select("chrom", "pos", "value"), ["chrom", "pos"])
    whole = found.groupBy("chrom", "start", "end").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 2 * reach + 1).drop("_n")
    return found.join(whole, ["chrom", "start", "end"], "left_semi").select(*centers.columns, "offset", "value")


def pileup_enrichment(piled: DataFrame, reach: int) -> DataFrame:
    """Twice the mean of the middle bin over the sum of the means of the first and last."""
    mean = lambda at: F.avg(F.when(F.col("offset") == at, F.col("value")))
    return piled.agg(F.try_divide(2 * mean(0), mean(-reach) + mean(reach)).alias("enrichment"))


def peak_windows(fragments: DataFrame, peaks: DataFrame, resolution: int = 100, flank: int = 2000, literal: bool = True) -> DataFrame:
    """Fragments by peak and bin offset.

    Literal mode floors both ends and counts a fragment where its bin is exactly
    one resolution long; otherwise a fragment counts in the bin of its middle.
    """
    if literal:
        floored = fragments.select("chrom", bin_start("start", resolution).alias("pos"), bin_start("end", resolution).alias("_end")).where(F.col("_end") == F.col("pos") + resolution)
    else:
        floored = fragments.select("chrom", midpoint_bin("start", "end", resolution).alias("pos"))
    counted = floored.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("count"))
    reach = flank // resolution
    asked = peaks.select("chrom", "start", "end", midpoint_bin("start", "end", resolution).alias("_middle"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("offset")).withColumn("pos", F.col("_middle") + F.col("offset") * resolution)
    return asked.join(counted, ["chrom", "pos"], "left").select("chrom", "start", "end", "offset", F.coalesce("count", F.lit(0)).alias("count"))


def library_sizes(reads: DataFrame) -> DataFrame:
    """Molecules in each cell's library from its read pairs and unique pairs (cell, read_pairs, unique_pairs); null where that cannot be."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import LongType

    from chromaloom.functions.numeric import library_size

    @pandas_udf(LongType())
    def size(n: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([library_size(int(a), int(b)) for a, b in zip(n, c, strict=True)], dtype="Int64")

    return reads.withColumn("library_size", size(F.coalesce("read_pairs", F.lit(0)), F.coalesce("unique_pairs", F.lit(0))))
