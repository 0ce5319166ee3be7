"""Contact matrices as long pixels, and what is computed along their diagonals.

Pixels have keys (by default ``cell``), chrom, bin1 <= bin2 (positions) and
value; zero pixels are absent, so means divide by analytic counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.operators.primitives import interval_join
from chromaloom.operators.preprocess import legs
from chromaloom.functions.coords import bin_start


def pixels_of(pairs: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Cis contacts by bin, upper triangle."""
    keys = ["cell"] if keys is None else keys
    a, b = bin_start("pos1", resolution), bin_start("pos2", resolution)
    return pairs.where("chrom1 = chrom2").groupBy(*keys, F.col("chrom1").alias("chrom"), F.least(a, b).alias("bin1"), F.greatest(a, b).alias("bin2")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def symmetrised(pixels: DataFrame) -> DataFrame:
    """Both triangles; the diagonal once."""
    flipped = [F.col("bin2").alias("bin1") if c == "bin1" else F.col("bin1").alias("bin2") if c == "bin2" else F.col(c) for c in pixels.columns]
    return pixels.unionByName(pixels.where("bin1 <> bin2").select(*flipped))


def region_matrix(pixels: DataFrame, chrom: str, start: int, end: int, log: bool = False) -> DataFrame:
    """Pixels with both bins in [start, end), both triangles; values as log2(x + 1) if asked."""
    inside = pixels.where((F.col("chrom") == chrom) & (F.col("bin1") >= start) & (F.col("bin2") < end))
    out = symmetrised(inside)
    return out.withColumn("value", F.log2(F.col("value") + 1)) if log else out


def mask_regions(pixels: DataFrame, blacklist: DataFrame, resolution: int, diagonal: bool = True) -> DataFrame:
    """Values of bins that a blacklist (chrom, start, end) touches, and of the diagonal, become null."""
    right = blacklist.select("chrom", F.explode(F.sequence(F.floor(F.col("start") / resolution), F.ceil(F.col("end") / resolution) - 1)).alias("_k")).select("chrom", (F.col("_k") * resolution).alias("_bad")).distinct()
    out = pixels
    for i in (1, 2):
        out = out.join(right.select("chrom", F.col("_bad").alias(f"bin{i}"), F.lit(True).alias(f"_b{i}")), ["chrom", f"bin{i}"], "left")
    hidden = F.col("_b1").isNotNull() | F.col("_b2").isNotNull()
    hidden = hidden | (F.col("bin1") == F.col("bin2")) if diagonal else hidden
    return out.withColumn("value", F.when(~hidden, F.col("value"))).select(*pixels.columns)


def extents_of(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Last bin of each matrix; its first is 0."""
    keys = ["cell"] if keys is None else keys
    return pixels.groupBy(*keys, "chrom").agg(F.max(F.greatest("bin1", "bin2")).alias("last"))


def diagonal_means(pixels: DataFrame, resolution: int, extents: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean of each diagonal, zeros included: keys, chrom, k, total, n, mean, for every k up to the last."""
    keys = ["cell"] if keys is None else keys
    ends = extents_of(pixels, keys) if extents is None else extents
    size = F.floor(F.col("last") / resolution) + 1
    every = ends.select(*keys, "chrom", size.alias("_size"), F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)).alias("k"))
    sums = pixels.groupBy(*keys, "chrom", F.floor((F.col("bin2") - F.col("bin1")) / resolution).alias("k")).agg(F.sum("value").alias("_total"))
    out = every.join(sums, [*keys, "chrom", "k"], "left").select(*keys, "chrom", "k", F.coalesce("_total", F.lit(0.0)).alias("total"), (F.col("_size") - F.col("k")).alias("n"))
    return out.withColumn("mean", F.col("total") / F.col("n"))


def log_bin_edges(n: int, base: float = 1.2) -> list[int]:
    """0, then the distinct integer parts of base^i below n, then n."""
    edges, i = [0], 0
    while (e := int(base**i)) < n:
        if e > edges[-1]:
            edges.append(e)
        i += 1
    return [*edges, n]


def decay_curve(means: DataFrame, most: int, base: float = 1.2, keys: list[str] | None = None) -> DataFrame:
    """Mean of the diagonal means in logarithmic bins of k, summed over chromosomes: keys, start, stop, value.

    Diagonals beyond ``most`` are left out.
    """
    keys = ["cell"] if keys is None else keys
    edges = log_bin_edges(most, base)
    starts = F.array(*[F.lit(e).cast("bigint") for e in edges])
    turn = F.size(F.filter(starts, lambda e: e <= F.col("k")))
    placed = means.where(F.col("k") < most).select(*keys, "chrom", F.get(starts, turn - 1).alias("start"), F.get(starts, turn).alias("stop"), "mean")
    return placed.groupBy(*keys, "chrom", "start", "stop").agg(F.avg("mean").alias("_m")).groupBy(*keys, "start", "stop").agg(F.sum("_m").alias("value"))


def observed_over_expected(pixels: DataFrame, resolution: int, extents: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Pixels with oe: value by the mean of their diagonal; null where that is 0."""
    keys = ["cell"] if keys is None else keys
    means = diagonal_means(pixels, resolution, extents, keys).select(*keys, "chrom", "k", "mean")
    out = pixels.withColumn("k", F.floor((F.col("bin2") - F.col("bin1")) / resolution)).join(means, [*keys, "chrom", "k"])
    return out.select(*pixels.columns, F.try_divide("value", "mean").alias("oe"))


def band_scores(pixels: DataFrame, resolution: int, bins: int | None = None, keys: list[str] | None = None, center_only: bool = False) -> DataFrame:
    """Pixels with z: within each diagonal (value - mean) by the population deviation, 0 where that is 0; nulls stay null."""
    keys = ["cell"] if keys is None else keys
    k = F.floor((F.col("bin2") - F.col("bin1")) / resolution)
    banded = pixels.withColumn("_k", k) if bins is None else pixels.withColumn("_k", k).where(F.col("_k") < bins)
    stats = banded.groupBy(*keys, "chrom", "_k").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    off = F.col("value") - F.col("_m")
    z = off if center_only else F.when(F.col("value").isNotNull(), F.coalesce(F.try_divide(off, F.nullif(F.col("_s"), F.lit(0.0))), F.lit(0.0)))
    return banded.join(stats, [*keys, "chrom", "_k"]).select(*pixels.columns, z.alias("z"))


def expected_distances(particles: DataFrame, resolution: int, n_diag: int, keys: list[str] | None = None) -> DataFrame:
    """Mean distance of particles k bins apart, for k from 1: keys, chrom, k, mean.  An equi-join on the bin."""
    keys = ["cell"] if keys is None else keys
    return banded_distances(particles, resolution, n_diag, keys).where("k > 0").groupBy(*keys, "chrom", "k").agg(F.avg("distance").alias("mean"))


def banded_distances(particles: DataFrame, resolution: int, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Distances of particles 0 to ``bins`` - 1 bins apart: keys, chrom, pos1, pos2, k, distance."""
    keys = ["cell"] if keys is None else keys
    a = particles.select(*keys, "chrom", F.col("pos").alias("pos1"), *[F.col(c).cast("double").alias(f"{c}1") for c in "xyz"], F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("k"))
    a = a.withColumn("pos2", F.col("pos1") + F.col("k") * resolution)
    return _with_distance(a, particles, [*keys, "chrom", "pos2"], keys).select(*keys, "chrom", "pos1", "pos2", "k", "distance")


def row_distances(particles: DataFrame, bins: int, keys: list[str] | None = None) -> DataFrame:
    """The same by rows in order of position rather than by bins: gaps do not count."""
    keys = ["cell"] if keys is None else keys
    numbered = particles.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "chrom").orderBy("pos")).cast("bigint"))
    a = numbered.select(*keys, "chrom", F.col("pos").alias("pos1"), *[F.col(c).cast("double").alias(f"{c}1") for c in "xyz"], "_row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("k"))
    b = numbered.select(*keys, "chrom", F.col("pos").alias("pos2"), *[F.col(c).cast("double").alias(f"{c}2") for c in "xyz"], F.col("_row").alias("_to"))
    joined = a.withColumn("_to", F.col("_row") + F.col("k")).join(b, [*keys, "chrom", "_to"])
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    return joined.select(*keys, "chrom", "pos1", "pos2", "k", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("distance"))


def _with_distance(a: DataFrame, particles: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    b = particles.select(*keys, "chrom", F.col("pos").alias("pos2"), *[F.col(c).cast("double").alias(f"{c}2") for c in "xyz"])
    d = [F.col(f"{c}1") - F.col(f"{c}2") for c in "xyz"]
    return a.join(b, on).withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))


def insulation(pixels: DataFrame, resolution: int, window: int, keys: list[str] | None = None) -> DataFrame:
    """Insulation of every bin: contacts between the ``window`` bins on either side by all within them; 1 at the borders or without contacts.

    A pixel is sent to the bins whose box holds it, at most 2 windows + 1 of them.
    """
    keys = ["cell"] if keys is None else keys
    size = extents_of(pixels, keys).withColumn("_n", F.floor(F.col("last") / resolution) + 1).drop("last")
    px = symmetrised(pixels).select(*keys, "chrom", F.floor(F.col("bin1") / resolution).alias("a"), F.floor(F.col("bin2") / resolution).alias("b"), "value").where(F.abs(F.col("a") - F.col("b")) <= 2 * window)
    sent = px.withColumn("i", F.explode(F.sequence(F.greatest("a", "b") - window, F.least("a", "b") + window))).join(size, [*keys, "chrom"])
    inner = (F.col("i") >= window) & (F.col("i") < F.col("_n") - window)
    high = F.least(F.col("_n") - 1, F.col("i") + window + 1)
    box = (F.col("a") < high) & (F.col("b") < high)
    across = (F.col("a") < F.col("i")) & (F.col("b") > F.col("i"))
    sums = sent.where(inner & box).groupBy(*keys, "chrom", "i").agg(F.sum(F.when(across, F.col("value"))).alias("_cross"), F.sum("value").alias("_all"))
    every = size.select(*keys, "chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("i"))
    score = F.when(F.col("_all").isNull(), 1.0).otherwise(F.coalesce(F.try_divide(F.coalesce("_cross", F.lit(0.0)), F.col("_all")), F.lit(1.0)))
    return every.join(sums, [*keys, "chrom", "i"], "left").select(*keys, "chrom", (F.col("i") * resolution).alias("pos"), score.alias("insulation"))


def insulation_correlation(pixels: DataFrame, resolution: int, window: int) -> DataFrame:
    """Correlation of each cell's insulation with that of the sum over all cells."""
    bulk = pixels.groupBy("chrom", "bin1", "bin2").agg(F.sum("value").alias("value"))
    whole = insulation(bulk, resolution, window, []).withColumnRenamed("insulation", "_bulk")
    return insulation(pixels, resolution, window).join(whole, ["chrom", "pos"]).groupBy("cell").agg(F.corr("insulation", "_bulk").alias("r"))


def pseudobulk(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("chrom", "bin1", "bin2").agg(F.sum("value").alias("value"))


def smoothed(pixels: DataFrame, resolution: int, radius: int = 1, kernel: dict[tuple[int, int], float] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Convolution of the full matrix with a kernel (by offsets in bins; a mean over the square by default), zeros beyond the border."""
    keys = ["cell"] if keys is None else keys
    width = 2 * radius + 1
    kernel = kernel or {(i, j): 1 / (width * width) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}
    offsets = F.array(*[F.struct(F.lit(i * resolution).cast("bigint").alias("i"), F.lit(j * resolution).cast("bigint").alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in kernel.items()])
    moved = symmetrised(pixels).withColumn("_o", F.explode(offsets)).select(*keys, "chrom", (F.col("bin1") + F.col("_o.i")).alias("bin1"), (F.col("bin2") + F.col("_o.j")).alias("bin2"), (F.col("value") * F.col("_o.w")).alias("value"))
    ends = extents_of(pixels, keys)
    inside = moved.join(ends, [*keys, "chrom"]).where("bin1 >= 0 AND bin2 >= 0 AND bin1 <= bin2 AND bin2 <= last")
    return inside.groupBy(*keys, "chrom", "bin1", "bin2").agg(F.sum("value").alias("value"))


def gaussian_kernel(radius: int, sigma: float) -> dict[tuple[int, int], float]:
    import math

    raw = {(i, j): math.exp(-(i * i + j * j) / (2 * sigma * sigma)) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def cpg_scores(pixels: DataFrame, track: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Sum of ``cpg`` (chrom, pos, cpg) over the bins that a bin touches and itself, by one more than their number.

    The track is filled with zeros up to its last bin on each chromosome; bins beyond are left out.
    """
    keys = ["cell"] if keys is None else keys
    last = track.groupBy("chrom").agg(F.max("pos").alias("_last"))
    step = F.lit(resolution).cast("bigint")
    dense = last.select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last", step)).alias("pos")).join(track.select("chrom", "pos", "cpg"), ["chrom", "pos"], "left").na.fill(0.0, ["cpg"])
    pairs = symmetrised(pixels).select(*keys, "chrom", F.col("bin1").alias("pos"), F.col("bin2").alias("_to"))
    own = pixels.select(*keys, "chrom").distinct().join(dense.select("chrom", "pos"), "chrom").select(*keys, "chrom", "pos", F.col("pos").alias("_to"))
    near = pairs.join(last, "chrom").where("pos <= _last AND _to <= _last").select(*keys, "chrom", "pos", "_to").union(own).distinct()
    values = dense.select("chrom", F.col("pos").alias("_to"), "cpg")
    return near.join(values, ["chrom", "_to"]).groupBy(*keys, "chrom", "pos").agg((F.sum("cpg") / (F.count(F.lit(1)) + 1)).alias("scab"))


def labelled_contacts(pairs: DataFrame, track: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Cis contacts between A and B bins: n_aa, n_ab, n_bb; contacts with an unlabelled leg are left out."""
    keys = ["cell"] if keys is None else keys
    out = pairs.where("chrom1 = chrom2")
    for i in (1, 2):
        side = track.select(F.col("chrom").alias(f"chrom{i}"), F.col("pos").alias(f"_pos{i}"), F.col("label").alias(f"_label{i}"))
        out = out.withColumn(f"_pos{i}", bin_start(f"pos{i}", resolution)).join(side, [f"chrom{i}", f"_pos{i}"], "left")
    both = lambda a, b: F.count_if((F.col("_label1") == a) & (F.col("_label2") == b))
    return out.groupBy(*keys).agg(both("A", "A").alias("n_aa"), (both("A", "B") + both("B", "A")).alias("n_ab"), both("B", "B").alias("n_bb"))


def compartment_scores(pairs: DataFrame, track: DataFrame, resolution: int, method: str = "tanay", keys: list[str] | None = None) -> DataFrame:
    """tanay: a = (2 n_aa + n_ab) / T, b likewise, score = log2(2 a b T / n_ab); simple: a = n_aa / n_ab, b likewise, score = (n_aa + n_bb) / (2 n_ab)."""
    keys = ["cell"] if keys is None else keys
    n = labelled_contacts(pairs, track, resolution, keys)
    total = F.col("n_aa") + F.col("n_ab") + F.col("n_bb")
    ratio = lambda x, y: F.try_divide(x.cast("double"), y)
    if method == "simple":
        return n.select(*keys, "n_aa", "n_ab", "n_bb", ratio(F.col("n_aa") + F.col("n_bb"), 2 * F.col("n_ab")).alias("score"), ratio(F.col("n_aa"), F.col("n_ab")).alias("a"), ratio(F.col("n_bb"), F.col("n_ab")).alias("b"))
    if method != "tanay":
        raise ValueError(f"unknown method {method!r}")
    a, b = ratio(2 * F.col("n_aa") + F.col("n_ab"), total), ratio(2 * F.col("n_bb") + F.col("n_ab"), total)
    out = n.select(*keys, "n_aa", "n_ab", "n_bb", a.alias("a"), b.alias("b"))
    return out.withColumn("score", F.log2(F.try_divide(2 * F.col("a") * F.col("b") * (F.col("n_aa") + F.col("n_ab") + F.col("n_bb")), F.col("n_ab"))))


def saddle(pixels: DataFrame, track: DataFrame, resolution: int, n: int, keys: list[str] | None = None) -> DataFrame:
    """Observed over expected by pairs of quantile bins of ``cpg``: keys, i, j, total, count."""
    keys = ["cell"] if keys is None else keys
    ranked = track.where("cpg IS NOT NULL").withColumn("q", F.ntile(n).over(W.partitionBy("chrom").orderBy("cpg", "pos")) - 1)
    oe = symmetrised(observed_over_expected(pixels, resolution, keys=keys)).where("oe IS NOT NULL")
    side = lambda i: ranked.select("chrom", F.col("pos").alias(f"bin{i}"), F.col("q").alias("i" if i == 1 else "j"))
    return oe.join(side(1), ["chrom", "bin1"]).join(side(2), ["chrom", "bin2"]).groupBy(*keys, "i", "j").agg(F.sum("oe").alias("total"), F.count(F.lit(1)).alias("count"))


def saddle_strength(cells: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Corner ratios of a saddle (i, j, total, count) for k from 1 to n - 1: k, strength, a, b; and zeros for k = 0."""
    keys = ["cell"] if keys is None else keys
    spread = cells.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n - 1))))
    low = (F.col("i") < F.col("k")) & (F.col("j") < F.col("k"))
    high = (F.col("i") >= n - F.col("k")) & (F.col("j") >= n - F.col("k"))
    mixed = lambda i, j: (F.col(i) < F.col("k")) & (F.col(j) >= n - F.col("k"))

    def corner(conditions: list[Column], of: str) -> Column:
        return sum((F.sum(F.when(c, F.col(of)).otherwise(0)) for c in conditions), F.lit(0))

    parts = spread.groupBy(*keys, "k").agg(*[corner(c, of).cast("double").alias(f"{name}_{of}") for name, c in (("intra", [low, high]), ("b", [low]), ("a", [high]), ("inter", [mixed("i", "j"), mixed("j", "i")])) for of in ("total", "count")])
    mean = lambda x: F.try_divide(F.col(f"{x}_total"), F.col(f"{x}_count"))
    out = parts.select(*keys, "k", F.try_divide(mean("intra"), mean("inter")).alias("strength"), F.try_divide(mean("a"), mean("inter")).alias("a"), F.try_divide(mean("b"), mean("inter")).alias("b"))
    zeros = cells.select(*keys).distinct().select(*keys, F.lit(0).alias("k"), *[F.lit(0.0).alias(c) for c in ("strength", "a", "b")]) if keys else cells.sparkSession.range(1).select(F.lit(0).alias("k"), *[F.lit(0.0).alias(c) for c in ("strength", "a", "b")])
    return out.unionByName(zeros)


def band_factors(counts: DataFrame) -> DataFrame:
    """Mean over cells of the counts of each (chr1, diag), and of all trans contacts (chr1 null, diag -1)."""
    n = counts.agg(F.count_distinct("cell").alias("_n"))
    cis = counts.where("chr1 = chr2").groupBy("chr1", "diag").agg(F.sum("value").alias("_sum"))
    trans = counts.where("chr1 <> chr2").agg(F.sum("value").alias("_sum")).select(F.lit(None).cast("string").alias("chr1"), F.lit(-1).cast("bigint").alias("diag"), "_sum")
    return cis.unionByName(trans).withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").select("chr1", "diag", (F.col("_sum") / F.col("_n")).alias("factor"))


def normalise_bands(counts: DataFrame) -> DataFrame:
    """Counts scaled so that each band of each cell sums to the band's mean over cells; trans contacts are one band."""
    band = F.when(F.col("chr1") == F.col("chr2"), F.col("chr1"))
    diag = F.when(F.col("chr1") == F.col("chr2"), F.col("diag")).otherwise(-1)
    marked = counts.withColumn("_band", F.coalesce(band, F.lit(""))).withColumn("_diag", diag)
    own = marked.groupBy("cell", "_band", "_diag").agg(F.sum("value").alias("_own"))
    factor = band_factors(counts).select(F.coalesce("chr1", F.lit("")).alias("_band"), F.col("diag").alias("_diag"), "factor")
    return marked.join(own, ["cell", "_band", "_diag"]).join(factor, ["_band", "_diag"]).select(*counts.columns, (F.col("value") * F.try_divide("factor", "_own")).alias("norm"))


def absolute_bins(counts: DataFrame, sizes: DataFrame, resolution: int) -> DataFrame:
    """Bins numbered over all chromosomes in their natural order: cell, row, col, value."""
    from chromaloom.functions.coords import natural_order

    offsets = sizes.withColumn("_bins", F.ceil(F.col("size") / resolution)).withColumn("_before", F.coalesce(F.sum("_bins").over(W.orderBy(natural_order("chrom")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    side = lambda i: offsets.select(F.col("chrom").alias(f"chr{i}"), F.col("_before").alias(f"_o{i}"))
    return counts.join(side(1), "chr1").join(side(2), "chr2").select("cell", (F.col("bin1") + F.col("_o1")).alias("row"), (F.col("bin2") + F.col("_o2")).alias("col"), "value")


def anchored_pileup(pixels: DataFrame, loops: DataFrame, resolution: int, flank: int, keys: list[str] | None = None) -> DataFrame:
    """Mean observed over expected around pairs of anchors (chrom1, start1, end1, chrom2, start2, end2): keys, di, dj, mean, n.

    Only pixels that exist take part; anchors meet them on exact bins.
    """
    keys = ["cell"] if keys is None else keys
    oe = observed_over_expected(pixels, resolution, keys=keys)
    steps = F.sequence(F.lit(-(flank // resolution)), F.lit(flank // resolution))
    middle = lambda i: bin_start(F.floor((F.col(f"start{i}") + F.col(f"end{i}")) / 2), resolution)
    asked = loops.where("chrom1 = chrom2").select(F.col("chrom1").alias("chrom"), middle(1).alias("_m1"), middle(2).alias("_m2"), F.explode(steps).alias("di")).withColumn("dj", F.explode(steps))
    asked = asked.select("chrom", "di", "dj", (F.col("_m1") + F.col("di") * resolution).alias("bin1"), (F.col("_m2") + F.col("dj") * resolution).alias("bin2"))
    return oe.join(asked, ["chrom", "bin1", "bin2"]).groupBy(*keys, "di", "dj").agg(F.avg("oe").alias("mean"), F.count("oe").alias("n"))


def arm_decay(pixels: DataFrame, arms: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Sum by valid pixels for each distance, within arms (chrom, start, end): keys, k, value."""
    keys = ["cell"] if keys is None else keys
    legs_in = interval_join(pixels.withColumn("start", F.col("bin1")).withColumn("end", F.col("bin2") + resolution), arms.select("chrom", F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["chrom"], 10_000_000, "within")
    sums = legs_in.groupBy(*keys, F.floor((F.col("bin2") - F.col("bin1")) / resolution).alias("k")).agg(F.sum("value").alias("_sum"))
    size = F.floor((F.col("end") - F.col("start")) / resolution)
    valid = arms.select(size.alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(size - 1, F.lit(0)))).alias("k")).groupBy("k").agg(F.sum(F.col("_n") - F.col("k")).alias("_valid"))
    return sums.join(valid, "k").select(*keys, "k", F.try_divide("_sum", "_valid").alias("value"))


def chromatic(pixels: DataFrame, vector: DataFrame) -> DataFrame:
    """Values times both bins' entries of a vector (chrom, pos, v); on the diagonal times one."""
    a = vector.select("chrom", F.col("pos").alias("bin1"), F.col("v").alias("_v1"))
    b = vector.select("chrom", F.col("pos").alias("bin2"), F.col("v").alias("_v2"))
    value = F.when(F.col("bin1") == F.col("bin2"), F.col("value") * F.col("_v1")).otherwise(F.col("value") * F.col("_v1") * F.col("_v2"))
    return pixels.join(a, ["chrom", "bin1"]).join(b, ["chrom", "bin2"]).withColumn("value", value).select(*pixels.columns)


def bad_bins_removed(values: DataFrame, most_missing: int) -> DataFrame:
    """Long values (cell, chrom, pos, value) without loci, then cells, that have more nulls than allowed."""
    loci = values.groupBy("chrom", "pos").agg(F.count_if(F.col("value").isNull()).alias("_n")).where(F.col("_n") <= most_missing)
    kept = values.join(loci.drop("_n"), ["chrom", "pos"], "left_semi")
    cells = kept.groupBy("cell").agg(F.count_if(F.col("value").isNull()).alias("_n")).where(F.col("_n") <= most_missing)
    return kept.join(cells.drop("_n"), "cell", "left_semi")


def leg_counts(pairs: DataFrame, resolution: int, keys: list[str] | None = None) -> DataFrame:
    """Marginals: legs by bin."""
    keys = ["cell"] if keys is None else keys
    return legs(pairs, keys).groupBy(*keys, "chrom", bin_start("pos", resolution).alias("pos")).agg(F.count(F.lit(1)).alias("n"))


def filled_from_track(values: DataFrame, track: DataFrame) -> DataFrame:
    """Long values (chrom, pos, value) with nulls taken from a track (chrom, pos, cpg)."""
    return values.join(track.select("chrom", "pos", "cpg"), ["chrom", "pos"], "left").withColumn("value", F.coalesce("value", "cpg")).select(*values.columns)


def shifted_bins(lines: DataFrame, shift: int = 10_000) -> DataFrame:
    """Bin literals like (chr1, 30000) in ``value`` as chrom and pos, moved back by ``shift``."""
    return lines.select(F.regexp_extract("value", r"\(?\s*'?(\w+)'?\s*,", 1).alias("chrom"), (F.regexp_extract("value", r",\s*(\d+)", 1).cast("bigint") - shift).alias("pos"))


def springs_within(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs that are trans or at most ``most`` apart."""
    return pairs.where((F.col("chrom1") != F.col("chrom2")) | (F.abs(F.col("pos1") - F.col("pos2")) <= most))


def labelled(values: DataFrame, track: DataFrame, how: str = "inner") -> DataFrame:
    """``values`` joined with a track (chrom, pos, ...) by locus; right and full keep loci without a value."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"unknown join {how!r}")
    return values.join(track, ["chrom", "pos"], how)
