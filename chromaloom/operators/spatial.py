"""Three-dimensional neighbourhoods, shapes and spatial statistics.

Radius questions go by tiles of points (``tiles``), so a dense structure makes no
row for each pair unless pairs are what is asked for.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import Region
from chromaloom.operators import tiles
from chromaloom.operators.primitives import average_rank, bucket_join, dealt_join, distance, squared_distance

AXES = ("x", "y", "z")
AGGREGATIONS = ("sum", "mean", "max", "min", "count")


def _sides(particles: DataFrame, keys: list[str], left: list[str], right: list[str]) -> tuple[DataFrame, DataFrame]:
    axes = [F.col(a).cast("double").alias(a) for a in AXES]
    return particles.select(*keys, *left, *axes), particles.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right], *[F.col(a).cast("double").alias(f"r_{a}") for a in AXES])


def neighbours(particles: DataFrame, radius: float, columns: list[str], keys: list[str], others: DataFrame | None = None) -> DataFrame:
    """Pairs of particles within ``radius``, each with itself too: keys, chrom, pos, r_chrom, r_pos, r_ columns, squared distance d2."""
    a, _ = _sides(particles, keys, ["chrom", "pos"], [])
    _, b = _sides(particles if others is None else others, keys, [], ["chrom", "pos", *columns])
    d2 = squared_distance()
    return bucket_join(a, b, keys, [(x, f"r_{x}") for x in AXES], radius, d2 <= radius * radius).withColumn("d2", d2)


def feature_in_radius(particles: DataFrame, feature: str, radius: float, aggregation: str = "mean", include_self: bool = False, rank: bool = False, keys: list[str] | None = None, name: str | None = None) -> DataFrame:
    """``particles`` with an aggregate of ``feature`` over neighbours; nulls are skipped.

    Without neighbours a sum and a count are 0 and the others null.  ``rank``
    gives the mean rank over the number of values instead.
    """
    keys = ["cell"] if keys is None else keys
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}")
    name = name or f"{feature}_{aggregation}_in_radius_{radius:g}"
    kind = aggregation if aggregation in ("max", "min") else "sum"
    near = tiles.ball(particles, radius, feature, kind, keys, include_self).where("n > 0")
    value = {"sum": F.sum("value"), "mean": F.sum("value") / F.sum("n"), "max": F.max("value"), "min": F.min("value"), "count": F.sum("n")}[aggregation]
    found = near.groupBy(*keys, "chrom", "pos").agg(value.cast("double").alias("_value"))
    out = particles.join(found, [*keys, "chrom", "pos"], "left")
    out = out.withColumn(name, F.coalesce("_value", F.lit(0.0)) if aggregation in ("sum", "count") else F.col("_value")).select(*particles.columns, name)
    if rank:
        known = F.count(name).over(W.partitionBy(*keys))
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), average_rank(name, [*keys, F.col(name).isNull()]) / known))
    return out


def density(particles: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Particles within ``radius``, the particle included, by the ball's volume."""
    keys = ["cell"] if keys is None else keys
    n = tiles.ball(particles, radius, keys=keys).groupBy(*keys, "chrom", "pos").agg(F.sum("n").alias("n_near"))
    return n.withColumn("density", F.col("n_near") / (4 / 3 * math.pi * radius**3))


def proximity_pairs(particles: DataFrame, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Each pair of particles within ``radius`` once, the lower (chrom, pos) first: chrom1, pos1, chrom2, pos2, distance."""
    keys = ["cell"] if keys is None else keys
    return tiles.pairs(particles, radius, keys).select(*keys, "chrom1", "pos1", "chrom2", "pos2", "distance")


def structure_to_pairs(particles: DataFrame, radius: float = 3.0, keys: list[str] | None = None) -> DataFrame:
    """Contacts of a structure: phases from the allele letters or suffixes, certain phase probabilities, distinct."""
    keys = ["cell"] if keys is None else keys
    bare = F.regexp_replace("chrom", r"(\((pat|mat)\)|[ab])$", "")
    phase = F.when(F.col("chrom").rlike(r"(\(pat\)|a)$"), "0").when(F.col("chrom").rlike(r"(\(mat\)|b)$"), "1").otherwise(".")
    named = particles.select(*keys, "chrom", "pos", *AXES, bare.alias("bare"), phase.alias("phase"))
    pairs = tiles.pairs(named, radius, keys, ["bare", "phase"])
    out = pairs.select(F.col("bare1").alias("chrom1"), "pos1", F.col("bare2").alias("chrom2"), "pos2", F.col("phase1").alias("phase0"), F.col("phase2").alias("phase1"), *keys)
    # pairs can be equal only where two particles have one name, position and phase
    if named.groupBy(*keys, "bare", "pos", "phase").count().where("count > 1").limit(1).count():
        out = out.distinct()
    for a in "01":
        for b in "01":
            out = out.withColumn(f"phase_prob{a}{b}", ((F.col("phase0") == a) & (F.col("phase1") == b)).cast("double"))
    return out


def k_nearest(particles: DataFrame, k: int, start: float | None = None, keys: list[str] | None = None) -> DataFrame:
    """The ``k`` nearest other particles of each: keys, chrom, pos, r_chrom, r_pos, distance, turn.

    Tiles tell how far they must look by their own width; ``start`` is not needed any more.
    """
    keys = ["cell"] if keys is None else keys
    here = [*keys, "chrom", "pos"]
    order = W.partitionBy(*here).orderBy("d2", "r_chrom", "r_pos")  # rows that share a position are one particle here
    ranked = tiles.nearest(particles, k, keys).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k)
    return ranked.select(*here, "r_chrom", "r_pos", F.sqrt("d2").alias("distance"), F.col("turn").cast("bigint").alias("turn"))


def knn_density(particles: DataFrame, k: int = 10, start: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """One by the mean distance of the ``k`` nearest others."""
    keys = ["cell"] if keys is None else keys
    return k_nearest(particles, k, start, keys).groupBy(*keys, "chrom", "pos").agg((1.0 / (F.avg("distance") + 1e-10)).alias("knn_density"))


def intermingling(particles: DataFrame, chrom1: str, chrom2: str, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Share of the particle pairs of two chromosomes that are within ``radius``; 0 where one is missing."""
    keys = ["cell"] if keys is None else keys
    a, b = particles.where(F.col("chrom") == chrom1), particles.where(F.col("chrom") == chrom2)
    n = particles.groupBy(*keys).agg(F.count_if(F.col("chrom") == chrom1).alias("n1"), F.count_if(F.col("chrom") == chrom2).alias("n2"))
    close = tiles.ball(a, radius, keys=keys, others=b).groupBy(*keys).agg(F.sum("n").alias("n_close"))
    return n.join(close, keys, "left").select(*keys, F.coalesce(F.try_divide(F.coalesce("n_close", F.lit(0)).cast("double"), F.col("n1") * F.col("n2")), F.lit(0.0)).alias("intermingling"))


def with_centroid(particles: DataFrame, by: list[str]) -> DataFrame:
    """``particles`` with the centroid of their group as cx, cy, cz: a sum joined back, not a window."""
    centers = particles.groupBy(*by).agg(*[F.avg(a).alias(f"c{a}") for a in AXES])
    return particles.join(centers, by)


def _from_center() -> Column:
    d = [F.col(a) - F.col(f"c{a}") for a in AXES]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def radial_position(particles: DataFrame, how: str = "raw", keys: list[str] | None = None) -> DataFrame:
    """Distance to the cell's centroid; how: raw, max (by the farthest), mean (by the mean) or rank (1/n to 1, ties by chrom and pos)."""
    keys = ["cell"] if keys is None else keys
    out = with_centroid(particles, keys).withColumn("radial", _from_center()).drop("cx", "cy", "cz")
    if how == "raw":
        return out
    if how == "rank":
        return out.withColumn("radial", F.row_number().over(W.partitionBy(*keys).orderBy("radial", "chrom", "pos")) / F.count(F.lit(1)).over(W.partitionBy(*keys)))
    if how not in ("max", "mean"):
        raise ValueError(f"unknown normalisation {how!r}")
    scale = out.groupBy(*keys).agg((F.max if how == "max" else F.avg)("radial").alias("_scale"))
    return out.join(scale, keys).withColumn("radial", F.try_divide("radial", "_scale")).select(*particles.columns, "radial")


def radial_distribution(particles: DataFrame, feature: str, bins: int = 10, keys: list[str] | None = None) -> DataFrame:
    """Mean of ``feature`` in equal half-open shells up to the farthest particle, which is in none; 0 for an empty shell."""
    keys = ["cell"] if keys is None else keys
    out = radial_position(particles, "raw", keys)
    scale = out.groupBy(*keys).agg((F.max("radial") / bins).alias("_step"), F.max("radial").alias("_max"))
    shelled = out.join(scale, keys).where("radial < _max").withColumn("bin", F.floor(F.try_divide("radial", "_step"))).groupBy(*keys, "bin").agg(F.avg(feature).alias("_mean"))
    shells = scale.select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin"))
    return shells.join(shelled, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("_mean", F.lit(0.0)).alias("mean"))


def weighted_radial(particles: DataFrame, feature: str, keys: list[str] | None = None) -> DataFrame:
    """Sum of the distances to the centroid weighted by the feature's shares."""
    keys = ["cell"] if keys is None else keys
    return radial_position(particles, "raw", keys).groupBy(*keys).agg(F.try_divide(F.sum(F.col("radial") * F.col(feature)), F.sum(feature)).alias("weighted_radial"))


def gyration(particles: DataFrame, by: list[str]) -> DataFrame:
    """Radius of gyration and particles by group: from the centered squares, so far-off structures lose no digits."""
    d = _from_center()
    return with_centroid(particles, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rg"))


def territories(particles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per chromosome: centre, radius of gyration, particles."""
    by = ["cell", "chrom"] if by is None else by
    d = _from_center()
    return with_centroid(particles, by).groupBy(*by).agg(*[F.first(f"c{a}").alias(f"center_{a}") for a in AXES], F.sqrt(F.avg(d * d)).alias("rg"), F.count(F.lit(1)).alias("n"))


def structural_metrics(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Centroid, radius of gyration, ranges, box volume and density of each cell."""
    keys = ["cell"] if keys is None else keys
    d = _from_center()
    ranges = [(F.max(a) - F.min(a)).alias(f"range_{a}") for a in AXES]
    out = with_centroid(particles, keys).groupBy(*keys).agg(*[F.first(f"c{a}").alias(f"center_{a}") for a in AXES], F.sqrt(F.avg(d * d)).alias("rg"), *ranges, F.count(F.lit(1)).alias("n"))
    box = F.col("range_x") * F.col("range_y") * F.col("range_z")
    return out.withColumn("box_volume", box).withColumn("box_density", F.try_divide(F.col("n"), box))


def expand(particles: DataFrame, factor: float, keys: list[str] | None = None) -> DataFrame:
    """Coordinates scaled about the cell's centroid."""
    out = with_centroid(particles, ["cell"] if keys is None else keys)
    return out.withColumns({a: F.col(f"c{a}") + (F.col(a) - F.col(f"c{a}")) * factor for a in AXES}).select(*particles.columns)


def expand_chromosomes(particles: DataFrame, factor: float, keys: list[str] | None = None) -> DataFrame:
    """Chromosomes moved away from the cell's centroid as rigid bodies."""
    keys = ["cell"] if keys is None else keys
    own = particles.groupBy(*keys, "chrom").agg(*[F.avg(a).alias(f"_{a}") for a in AXES])
    out = with_centroid(particles, keys).join(own, [*keys, "chrom"])
    return out.withColumns({a: F.col(a) + (F.col(f"_{a}") - F.col(f"c{a}")) * (factor - 1) for a in AXES}).select(*particles.columns)


def normalize(particles: DataFrame, method: str = "center", keys: list[str] | None = None) -> DataFrame:
    """center, standardize (population deviation + 1e-10), minmax (to 0..1) or unit_sphere."""
    keys = ["cell"] if keys is None else keys
    if method not in ("center", "standardize", "minmax", "unit_sphere"):
        raise ValueError(f"unknown method {method!r}")
    stats = particles.groupBy(*keys).agg(*[f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_pop), ("l", F.min), ("h", F.max))])
    out = particles.join(stats, keys)
    centered = {a: F.col(a) - F.col(f"_m{a}") for a in AXES}
    if method == "center":
        new = centered
    elif method == "standardize":
        new = {a: c / (F.col(f"_s{a}") + 1e-10) for a, c in centered.items()}
    elif method == "minmax":
        new = {a: F.try_divide(F.col(a) - F.col(f"_l{a}"), F.col(f"_h{a}") - F.col(f"_l{a}")) for a in AXES}
    else:
        length = F.sqrt(centered["x"] * centered["x"] + centered["y"] * centered["y"] + centered["z"] * centered["z"])
        far = out.groupBy(*keys).agg(F.max(length).alias("_far"))
        out = out.join(far, keys)
        new = {a: F.try_divide(c, F.col("_far")) for a, c in centered.items()}
    return out.withColumns(new).select(*particles.columns)


def outliers(particles: DataFrame, method: str = "iqr", threshold: float = 1.5, keys: list[str] | None = None) -> DataFrame:
    """``particles`` with is_outlier: iqr (any axis beyond threshold ranges), zscore (any |z| above it) or distance (mean + threshold deviations)."""
    keys = ["cell"] if keys is None else keys
    if method == "iqr":
        stats = particles.groupBy(*keys).agg(*[F.percentile(a, F.lit(q)).alias(f"_{n}{a}") for a in AXES for n, q in (("l", 0.25), ("h", 0.75))])
        wide = lambda a: (F.col(f"_h{a}") - F.col(f"_l{a}")) * threshold
        off = [(F.col(a) < F.col(f"_l{a}") - wide(a)) | (F.col(a) > F.col(f"_h{a}") + wide(a)) for a in AXES]
    elif method == "zscore":
        stats = particles.groupBy(*keys).agg(*[f(a).alias(f"_{n}{a}") for a in AXES for n, f in (("m", F.avg), ("s", F.stddev_pop))])
        off = [F.coalesce(F.abs(F.try_divide(F.col(a) - F.col(f"_m{a}"), F.col(f"_s{a}"))) > threshold, F.lit(False)) for a in AXES]
    elif method == "distance":
        far = radial_position(particles, "raw", keys)
        stats = far.groupBy(*keys).agg((F.avg("radial") + threshold * F.stddev_pop("radial")).alias("_most"))
        return far.join(stats, keys).select(*particles.columns, (F.col("radial") > F.col("_most")).alias("is_outlier"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return particles.join(stats, keys).select(*particles.columns, (off[0] | off[1] | off[2]).alias("is_outlier"))


def rotation_matrix(degrees_x: float, degrees_y: float, degrees_z: float) -> list[list[float]]:
    """Rz Ry Rx for angles in degrees."""
    (sx, cx), (sy, cy), (sz, cz) = ((math.sin(math.radians(d)), math.cos(math.radians(d))) for d in (degrees_x, degrees_y, degrees_z))
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def rotate(particles: DataFrame, degrees: tuple[float, float, float], transposed: bool = True) -> DataFrame:
    """Every point times the rotation matrix, transposed or not: nine literal coefficients."""
    m = rotation_matrix(*degrees)
    entry = lambda i, j: m[i][j] if transposed else m[j][i]
    return particles.withColumns({a: sum((F.col(b) * F.lit(entry(i, j)) for j, b in enumerate(AXES)), F.lit(0.0)) for i, a in enumerate(AXES)})


def pairwise_distances(a: DataFrame, b: DataFrame, metric: str = "euclidean", keys: list[str] | None = None, blocks: int = 1024) -> DataFrame:
    """All distances between two frames of particles within a cell: euclidean, manhattan or chebyshev.

    Every pair is the result itself; a cell's are dealt out to ``blocks`` meetings.
    """
    keys = ["cell"] if keys is None else keys
    left, _ = _sides(a, keys, ["chrom", "pos"], [])
    _, right = _sides(b, keys, [], ["chrom", "pos"])
    d = [F.abs(F.col(x) - F.col(f"r_{x}")) for x in AXES]
    value = {"euclidean": F.sqrt(squared_distance()), "manhattan": d[0] + d[1] + d[2], "chebyshev": F.greatest(*d)}
    if metric not in value:
        raise ValueError(f"unknown metric {metric!r}")
    both = dealt_join(left, right, keys, ["chrom", "pos"], ["r_chrom", "r_pos"], blocks)
    return both.select(*keys, "chrom", "pos", "r_chrom", "r_pos", value[metric].alias("distance"))


def feature_distances(particles: DataFrame, feature: str, refs: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Distances of particles with a positive feature to reference points (keys, x, y, z), by default the cell's centroid."""
    keys = ["cell"] if keys is None else keys
    points = refs if refs is not None else particles.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in AXES])
    right = points.select(*keys, *[F.col(a).alias(f"r_{a}") for a in AXES])
    return particles.where(F.col(feature) > 0).join(right, keys).select(*keys, "chrom", "pos", F.sqrt(squared_distance()).alias("distance"))


def abc_scores(particles: DataFrame, genes: DataFrame, feature: str, radius: float, keys: list[str] | None = None) -> DataFrame:
    """Sum of feature by distance over the particles within ``radius`` of each gene point (keys, gene, x, y, z); 0 without any."""
    keys = ["cell"] if keys is None else keys
    points = genes.select(*keys, "gene", F.lit("").alias("chrom"), F.lit(0).cast("bigint").alias("pos"), *AXES)
    rest = particles.withColumn(feature, F.col(feature).cast("double"))
    near = tiles.weighted(points, radius, lambda d2: 1 / (np.sqrt(d2) + 1e-10), keys, ["gene"], feature, ["gene"], rest)
    near = near.where("n > 0").groupBy(*keys, "gene").agg(F.sum("value").alias("_score"))
    return genes.select(*keys, "gene").distinct().join(near, [*keys, "gene"], "left").select(*keys, "gene", F.coalesce("_score", F.lit(0.0)).alias("abc"))


def ripley(particles: DataFrame, radius: float, volume: float, keys: list[str] | None = None) -> DataFrame:
    """K, L and H at ``radius``; K is 0 for fewer than two particles."""
    keys = ["cell"] if keys is None else keys
    close = tiles.ball(particles, radius, keys=keys, include_self=False).groupBy(*keys).agg((F.sum("n") / 2).cast("bigint").alias("_close"))
    n = particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    k = F.coalesce(F.try_divide(F.lit(volume * 2.0) * F.coalesce("_close", F.lit(0)), F.col("n") * (F.col("n") - 1)), F.lit(0.0))
    length = F.cbrt(F.col("k") / (4.0 / 3.0 * math.pi))
    return n.join(close, keys, "left").select(*keys, "n", k.alias("k")).withColumn("l", length).withColumn("h", length - radius)


def shell_volume(r: Column, dr: float) -> Column:
    return 4 * math.pi * r * r * dr + math.pi / 3 * dr**3


def shell_correlation(particles: DataFrame, dr: float, max_distance: float, volume: float, others: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Pairs by shell (r - dr/2, r + dr/2] and their density over that of a uniform spread, without edge correction.

    The first shell includes distance 0, so a set with itself counts each particle once there.
    """
    keys = ["cell"] if keys is None else keys
    steps = int(math.floor(max_distance / dr))
    counted = tiles.shells(particles, dr, steps, keys, others).withColumnRenamed("n", "_n")
    left = particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    right = (particles if others is None else others).groupBy(*keys).agg(F.count(F.lit(1)).alias("_o"))
    shells = left.join(right, keys).withColumn("shell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps - 1).cast("bigint"))))
    out = shells.join(counted, [*keys, "shell"], "left").withColumn("count", F.coalesce("_n", F.lit(0))).withColumn("r", (F.col("shell") + 0.5) * dr)
    return out.select(*keys, "shell", "r", "count", (F.col("count") * volume / (F.col("_m") * F.col("_o") * shell_volume(F.col("r"), dr))).alias("g"))


def locus_distance(particles: DataFrame, a: tuple[str, int], b: tuple[str, int], keys: list[str] | None = None) -> DataFrame:
    """Distance between two loci in every cell that has both."""
    keys = ["cell"] if keys is None else keys
    at = lambda locus: particles.where((F.col("chrom") == locus[0]) & (F.col("pos") == locus[1]))
    left, _ = _sides(at(a), keys, [], [])
    _, right = _sides(at(b), keys, [], [])
    return left.join(right, keys).select(*keys, F.sqrt(squared_distance()).alias("distance"))


def nearest_value(particles: DataFrame, points: DataFrame, column: str, point: str = "point", keys: list[str] | None = None) -> DataFrame:
    """``column`` of the particle nearest to each point (keys, ``point``, x, y, z); ties go to the lower chrom and pos."""
    keys = ["cell"] if keys is None else keys
    asked = points.select(*keys, point, *[F.col(a).alias(f"r_{a}") for a in AXES])
    best = F.min_by(column, F.struct(squared_distance().alias("d"), F.col("chrom"), F.col("pos")))
    return particles.join(asked, keys).groupBy(*keys, point).agg(best.alias(column))


def top_share(particles: DataFrame, feature: str, share: float, keys: list[str] | None = None) -> DataFrame:
    """The share of particles with the greatest feature (ties by chrom and pos)."""
    keys = ["cell"] if keys is None else keys
    order = W.partitionBy(*keys).orderBy(F.desc(feature), "chrom", "pos")
    return particles.withColumn("_turn", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("_turn") <= F.floor(F.col("_n") * share)).drop("_turn", "_n")


def sample(rows: DataFrame, n: int, by: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows chosen by a seeded hash of the columns ``by``: the same on every run and partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *by), *by).limit(n)


def compartments_by_median(particles: DataFrame, feature: str, keys: list[str] | None = None) -> DataFrame:
    """A where the feature exceeds its cell's median, else B."""
    keys = ["cell"] if keys is None else keys
    middle = particles.groupBy(*keys).agg(F.median(feature).alias("_m"))
    return particles.join(middle, keys).select(*particles.columns, F.when(F.col(feature) > F.col("_m"), "A").otherwise("B").alias("compartment"))


def summary(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Particles, chromosomes and coordinate ranges of each cell."""
    keys = ["cell"] if keys is None else keys
    return particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("n_chrom"), *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def validate(particles: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per cell: rows, null or not finite coordinates, repeated positions."""
    keys = ["cell"] if keys is None else keys
    bad = F.lit(False)
    for a in AXES:
        bad = bad | F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
    return particles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_bad"), (F.count(F.lit(1)) - F.count_distinct("chrom", "pos")).alias("n_repeated"))


def slices(particles: DataFrame, region: Region | None = None) -> DataFrame:
    """Particles of a region, or all."""
    from chromaloom.functions.coords import in_region

    return particles if region is None else particles.where(in_region(region))


def grid_points(low: tuple[float, float, float], high: tuple[float, float, float], step: float, spark) -> DataFrame:  # noqa: ANN001
    """A regular grid from ``low`` on in steps, past ``high`` by one step at most: x, y, z."""
    out = spark.range(1).select()
    for a, lo, hi in zip(AXES, low, high, strict=True):
        n = max(0, math.ceil((hi + step - lo) / step - 1e-9) - 1)
        out = out.withColumn(f"_{a}", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn(a, F.lit(float(lo)) + F.col(f"_{a}") * step)
    return out.select(*AXES)


def within_distance(particles: DataFrame, point: tuple[float, float, float], most: float) -> DataFrame:
    """All particles, with their distance to a point and whether it is ``most`` at most."""
    d = [F.col(a) - F.lit(float(p)) for a, p in zip(AXES, point, strict=True)]
    return particles.withColumn("distance", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])).withColumn("is_near", F.col("distance") <= most)


def relative_differences(values: DataFrame, refs: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Euclidean distance of feature vectors to reference vectors, and that by the reference's length (+ 1e-10)."""
    both = values.select(*by, *columns).join(refs.select(*by, *[F.col(c).alias(f"r_{c}") for c in columns]), by)
    square = lambda e: sum((e(c) * e(c) for c in columns), F.lit(0.0))
    out = both.withColumn("distance", F.sqrt(square(lambda c: F.col(c) - F.col(f"r_{c}"))))
    return out.select(*by, "distance", (F.col("distance") / (F.sqrt(square(lambda c: F.col(f"r_{c}"))) + 1e-10)).alias("relative"))


def chromosome_stats(particles: DataFrame, feature: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, sample deviation and number of a feature's values by chromosome."""
    keys = ["cell"] if keys is None else keys
    return particles.groupBy(*keys, "chrom").agg(F.avg(feature).alias("mean"), F.stddev_samp(feature).alias("sd"), F.count(feature).alias("n"))


def histogram(particles: DataFrame, feature: str, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Values by equal bins between a feature's extremes, the greatest in the last bin: keys, bin, n."""
    keys = ["cell"] if keys is None else keys
    ends = particles.groupBy(*keys).agg(F.min(feature).alias("_l"), F.max(feature).alias("_h"))
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(feature) - F.col("_l")) * bins, F.col("_h") - F.col("_l")), F.lit(0.0))), F.lit(bins - 1))
    return particles.where(F.col(feature).isNotNull()).join(ends, keys).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def nearest_of_top(particles: DataFrame, feature: str, share: float, k: int, start: float, keys: list[str] | None = None) -> DataFrame:
    """Mean distance to the ``k`` nearest others, among the particles with the greatest feature: keys, chrom, pos, mean."""
    keys = ["cell"] if keys is None else keys
    top = top_share(particles, feature, share, keys)
    return k_nearest(top, k, start, keys).groupBy(*keys, "chrom", "pos").agg(F.avg("distance").alias("mean"))


def drawn(particles: DataFrame, n: Column | int, by: list[str], salt: Column | str, name: str = "_place") -> DataFrame:
    """The first ``n`` particles of each group in the order of a hash of salt, chromosome and position."""
    from pyspark.sql import Window as W

    salt = F.lit(salt) if isinstance(salt, str) else salt
    order = W.partitionBy(*by).orderBy(F.md5(F.concat_ws("_", salt, "chrom", "pos")), "chrom", "pos")
    return particles.withColumn(name, F.row_number().over(order)).where(F.col(name) <= n).drop(name)


def nearest_of_random(particles: DataFrame, share: float, k: int, start: float, seed: str = "0", keys: list[str] | None = None) -> DataFrame:
    """The random arm beside ``nearest_of_top``: as many particles, drawn by hash: keys, chrom, pos, mean distance to the ``k`` nearest others drawn."""
    keys = ["cell"] if keys is None else keys
    n = particles.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) * share).alias("_n"))
    some = drawn(particles.join(n, keys), F.col("_n"), keys, seed).drop("_n")
    return k_nearest(some, k, start, keys).groupBy(*keys, "chrom", "pos").agg(F.avg("distance").alias("mean"))


def sampled_distances(particles: DataFrame, feature: str, threshold: float, own: int = 50, others: int = 100, seed: str = "0", keys: list[str] | None = None) -> DataFrame:
    """Distances between chromosomes, sampled: keys, arm, chrom, distance.

    For each chromosome ``own`` of its particles meet ``others`` of the rest, both drawn
    by hash: arm 1 draws from all particles, arm 2 from those above the threshold.
    A chromosome's part has own times others rows, whatever the input.
    """
    keys = ["cell"] if keys is None else keys
    out = None
    for arm, rows in ((1, particles), (2, particles.where(F.col(feature) > threshold))):
        rows = rows.select(*keys, "chrom", "pos", "x", "y", "z")
        targets = rows.select(*keys, F.col("chrom").alias("_target")).distinct()
        near = drawn(rows, own, [*keys, "chrom"], seed).select(*keys, F.col("chrom").alias("_target"), "x", "y", "z")
        # a draw per chromosome of the rest needs at most others of each other chromosome
        few = drawn(rows, others, [*keys, "chrom"], f"{seed}o")
        far = few.join(F.broadcast(targets) if not keys else targets, keys) if keys else few.crossJoin(F.broadcast(targets))
        far = drawn(far.where(F.col("chrom") != F.col("_target")), others, [*keys, "_target"], f"{seed}o").select(*keys, "_target", *[F.col(c).alias(f"r_{c}") for c in "xyz"])
        found = near.join(far, [*keys, "_target"]).select(*keys, F.lit(arm).alias("arm"), F.col("_target").alias("chrom"), distance().alias("distance"))
        out = found if out is None else out.unionByName(found)
    return out
