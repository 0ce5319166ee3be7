"""Differences between two groups of cells, locus by locus or pixel by pixel.

Statistics are Spark aggregates over long tables; only the probabilities of
their distributions come from NumPy, on batches of finished statistics.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from chromaloom.functions.numeric import chi_square_upper, fisher_two_sided, normal_two_sided, t_two_sided_many
from chromaloom.operators.primitives import adjust_p, average_rank

METHODS = ("ttest", "welch", "manwhitneyu")


def _udf(f: Callable[..., float]) -> Callable[..., Column]:
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


@pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided P of Student's t."""
    return pd.Series(t_two_sided_many(t, df)).where(lambda p: p.notna(), None)


@pandas_udf(DoubleType())
def normal_probability(z: pd.Series) -> pd.Series:
    """Two-sided P of a standard normal value."""
    return _udf(normal_two_sided)(z)


@pandas_udf(DoubleType())
def chi_square_probability(x: pd.Series) -> pd.Series:
    """Upper P of chi-square with one degree of freedom."""
    return _udf(lambda v: chi_square_upper(v, 1.0))(x)


@pandas_udf(DoubleType())
def fisher_probability(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Fisher's exact P of a 2x2 table."""
    return _udf(lambda *v: fisher_two_sided(*map(int, v)))(a, b, c, d)


def grouped(values: DataFrame, groups: DataFrame) -> DataFrame:
    """``values`` (cell, ..., value) with the group, 1 or 2, of their cell (cell, group)."""
    return values.join(groups, "cell")


def t_statistics(values: DataFrame, by: list[str], welch: bool = False) -> DataFrame:
    """by, n1, n2, mean1, mean2, t and df for rows (by, group, value); null t for constant or tiny groups.

    A group's null or missing values are skipped.
    """
    one = lambda g: F.when(F.col("group") == g, F.col("value"))
    s = values.groupBy(*by).agg(*[f(one(g)).alias(f"{n}{g}") for g in (1, 2) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    n1, n2, v1, v2 = (F.col(c) for c in ("n1", "n2", "var1", "var2"))
    if welch:
        a, b = F.try_divide(v1, n1), F.try_divide(v2, n2)
        error, df = F.sqrt(a + b), F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1) + F.try_divide(b * b, n2 - 1))
    else:
        df = (n1 + n2 - 2).cast("double")
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, df)
        error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    return s.select(*by, "n1", "n2", "mean1", "mean2", F.try_divide(F.col("mean1") - F.col("mean2"), error).alias("t"), df.alias("df"))


def u_statistics(values: DataFrame, by: list[str]) -> DataFrame:
    """by, n1, n2, mean1, mean2, u (of group 1) and z, with ties and continuity corrected, for rows (by, group, value)."""
    known = values.where("value IS NOT NULL")
    ranked = known.withColumn("_rank", average_rank("value", by))
    ties = known.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_t")).groupBy(*by).agg(F.sum(F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double").alias("_ties"))
    one = lambda g, c: F.when(F.col("group") == g, F.col(c))
    s = ranked.groupBy(*by).agg(F.count(one(1, "value")).alias("n1"), F.count(one(2, "value")).alias("n2"), F.avg(one(1, "value")).alias("mean1"), F.avg(one(2, "value")).alias("mean2"), F.sum(one(1, "_rank")).alias("_r")).join(ties, by)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n2 / 2) - 0.5, F.lit(0.0)), F.nullif(spread, F.lit(0.0)))
    return s.select(*by, "n1", "n2", "mean1", "mean2", u.alias("u"), z.alias("z"))


def find_markers(values: DataFrame, groups: DataFrame, method: str = "ttest", by: list[str] | None = None, complete: bool = True) -> DataFrame:
    """Loci with means, difference, p and q (false discovery rate, not clipped).

    ``complete`` leaves out loci at which any cell has a null; loci without a p go too.
    """
    by = ["chrom", "pos"] if by is None else by
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    rows = grouped(values, groups)
    if complete:
        rows = rows.join(rows.where("value IS NULL OR isnan(value)").select(*by).distinct(), by, "left_anti")
    if method == "manwhitneyu":
        tested = u_statistics(rows, by).withColumn("p", normal_probability("z"))
    else:
        tested = t_statistics(rows, by, method == "welch").withColumn("p", t_probability("t", "df"))
    tested = tested.where("p IS NOT NULL").withColumn("diff", F.col("mean1") - F.col("mean2"))
    return false_discovery(tested, "p")


def false_discovery(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Benjamini-Hochberg over a whole table, without a window over all rows; a p that many rows share is one row there."""
    return adjust_p(df, p, [], "fdr", name)


def simple_diff(values: DataFrame, groups: DataFrame, by: list[str], level: float = 0.05) -> DataFrame:
    """Pixels whose t-test passes the false discovery rate: 0 < q < ``level``; a p that cannot be had counts as 1."""
    tested = t_statistics(grouped(values, groups), by).withColumn("p", F.coalesce(t_probability("t", "df"), F.lit(1.0)))
    return false_discovery(tested, "p").where((F.col("q") > 0) & (F.col("q") < level))


def count_tables(values: DataFrame, by: list[str], threshold: float = 3.0) -> DataFrame:
    """Per locus the 2x2 table of contacts (value <= threshold) by group: yes1, no1, yes2, no2."""
    hit = F.col("value") <= threshold
    n = lambda g, c: F.count_if((F.col("group") == g) & c)
    return values.where("value IS NOT NULL").groupBy(*by).agg(n(1, hit).alias("yes1"), n(1, ~hit).alias("no1"), n(2, hit).alias("yes2"), n(2, ~hit).alias("no2"))


def chi_square(tables: DataFrame, by: list[str], corrected: bool = True) -> DataFrame:
    """Tables with the chi-square statistic (Yates-corrected) and p; p is 1 where a margin is empty."""
    a, b, c, d = (F.col(x).cast("double") for x in ("yes1", "no1", "yes2", "no2"))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    off = F.abs(a * d - b * c)
    off = F.greatest(off - n / 2, F.lit(0.0)) if corrected else off
    out = tables.withColumn("chi2", F.try_divide(n * off * off, F.nullif(margins, F.lit(0.0))))
    return out.withColumn("p", F.coalesce(chi_square_probability("chi2"), F.lit(1.0)))


def fisher(tables: DataFrame) -> DataFrame:
    return tables.withColumn("p", fisher_probability("yes1", "no1", "yes2", "no2"))


def distance_differences(distances: DataFrame, groups: DataFrame, method: str = "ttest", by: list[str] | None = None, threshold: float = 3.0, most: float | None = None) -> DataFrame:
    """Differences of distances (cell, by, value) between groups: ttest, welch, wilcox, chisq or fisher, with q.

    ``most`` keeps loci whose lesser mean is below it; a group without values gives p = 1.
    """
    by = ["chrom", "pos1", "pos2"] if by is None else by
    rows = grouped(distances, groups)
    if method in ("chisq", "fisher"):
        tables = count_tables(rows, by, threshold)
        return false_discovery(chi_square(tables, by) if method == "chisq" else fisher(tables), "p")
    if method == "wilcox":
        tested = u_statistics(rows, by).withColumn("p", F.coalesce(normal_probability("z"), F.lit(1.0)))
    elif method in ("ttest", "welch"):
        tested = t_statistics(rows, by, method == "welch").withColumn("p", F.coalesce(t_probability("t", "df"), F.lit(1.0)))
    else:
        raise ValueError(f"unknown method {method!r}")
    if most is not None:
        tested = tested.where(F.least("mean1", "mean2") < most)
    return false_discovery(tested, "p")


def band_z_scores(distances: DataFrame) -> DataFrame:
    """Distances (cell, chrom, pos1, pos2, value) standardised (sample deviation) within each cell, chromosome and band."""
    banded = distances.withColumn("_band", F.col("pos2") - F.col("pos1"))
    stats = banded.groupBy("cell", "chrom", "_band").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return banded.join(stats, ["cell", "chrom", "_band"]).select(*distances.columns, F.try_divide(F.col("value") - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0))).alias("z"))


def ratings(distances: DataFrame) -> DataFrame:
    """(value - min) / (1 + max - min) within each cell, chromosome and band."""
    banded = distances.withColumn("_band", F.col("pos2") - F.col("pos1"))
    stats = banded.groupBy("cell", "chrom", "_band").agg(F.min("value").alias("_l"), F.max("value").alias("_h"))
    return banded.join(stats, ["cell", "chrom", "_band"]).select(*distances.columns, ((F.col("value") - F.col("_l")) / (1 + F.col("_h") - F.col("_l"))).alias("rating"))


def as_contacts(distances: DataFrame, threshold: float = 3.0, centered: bool = False) -> DataFrame:
    """1 for values up to the threshold (below 0 if centered), else 0."""
    hit = F.col("value") < 0 if centered else F.col("value") <= threshold
    return distances.withColumn("contact", F.when(hit, 1).otherwise(0))


def rating_filter(values: DataFrame, by: list[str], low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Loci whose contact frequency lies between the bounds (exclusive) in both groups: by, freq1, freq2."""
    freq = lambda g: F.avg(F.when(F.col("group") == g, F.col("contact")))
    f = values.groupBy(*by).agg(freq(1).alias("freq1"), freq(2).alias("freq2"))
    return f.where((F.col("freq1") > low) & (F.col("freq1") < high) & (F.col("freq2") > low) & (F.col("freq2") < high))


def project_anchors(bedpe: DataFrame) -> DataFrame:
    """Both anchors of a bedpe as one sorted, distinct bed."""
    sides = F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end")) for i in (1, 2)])
    return bedpe.select(F.explode(sides).alias("_a")).select("_a.*").distinct().orderBy("chrom", "start", "end")


def widen(bedpe: DataFrame, flank: int) -> DataFrame:
    """Both anchors widened; starts stop at 0."""
    return bedpe.withColumns({**{f"start{i}": F.greatest(F.col(f"start{i}") - flank, F.lit(0)) for i in (1, 2)}, **{f"end{i}": F.col(f"end{i}") + flank for i in (1, 2)}})


def cluster_bedpe(bedpe: DataFrame, gap: int) -> DataFrame:
    """bedpe with cluster1 and cluster2: runs of left and of right anchors at most ``gap`` apart, numbered within chromosomes."""
    from chromaloom.operators.primitives import islands

    out = bedpe
    for i in (1, 2):
        out = islands(out, [f"chrom{i}"], f"start{i}", f"end{i}", gap, f"cluster{i}")
    return out


def volcano(markers: DataFrame, annotation: DataFrame) -> DataFrame:
    """Markers with their annotation (chrom, pos, ...) and -log10 q."""
    return markers.join(annotation, ["chrom", "pos"], "left").withColumn("neg_log10_q", -F.log10("q"))


def corrected(df: DataFrame, p: str, method: str = "fdr", keys: list[str] | None = None, name: str = "q") -> DataFrame:
    """Correction within groups by a window (for groups of bounded size); see ``false_discovery`` for whole tables."""
    return adjust_p(df, p, keys or [], method, name)


def dealt_groups(cells: DataFrame, mode: str, groups: DataFrame | None = None, trials: int = 30, sizes: tuple[int, ...] = (20, 40, 60, 80, 100, 120, 140, 160, 180), seed: int = 31) -> DataFrame:
    """Groups for repeated tests: trial, cell, group.  ``cells`` has a row for each cell; ``groups`` (cell, group) for two of the modes.

    celltype: the groups as they are, one trial.  allele: every cell's two alleles
    (cells named by cell and allele letter a or b) against each other, one trial.
    random: cells dealt anew into halves, ``trials`` times.  sample: ``sizes`` cells of
    group 1 drawn against the whole of group 2.  Draws go by a hash of seed and name.
    """
    from pyspark.sql import Window as W

    if mode in ("celltype", "sample") and groups is None:
        raise ValueError(f"mode {mode} needs groups")
    spark = cells.sparkSession
    one = F.lit(1).cast("bigint").alias("trial")
    if mode == "celltype":
        return groups.select(one, "cell", "group")
    if mode == "allele":
        return cells.select(one, F.explode(F.array(*[F.struct(F.concat("cell", F.lit(x)).alias("cell"), F.lit(g).alias("group")) for x, g in (("a", 1), ("b", 2))])).alias("_a")).select("trial", "_a.*")
    drawn = F.md5(F.concat_ws("_", "trial", "cell"))
    if mode == "random":
        dealt = cells.select("cell").distinct().crossJoin(F.broadcast(spark.range(seed, seed + trials).select(F.col("id").alias("trial"))))
        place = F.row_number().over(W.partitionBy("trial").orderBy(drawn, "cell"))
        half = F.ceil(F.count(F.lit(1)).over(W.partitionBy("trial")) / 2)
        return dealt.select("trial", "cell", F.when(place <= half, 1).otherwise(2).alias("group"))
    if mode != "sample":
        raise ValueError(f"unknown mode {mode!r}")
    rounds = F.broadcast(spark.createDataFrame([(int(x),) for x in sizes], "trial bigint"))
    first = groups.where(F.col("group") == 1).crossJoin(rounds)
    taken = first.withColumn("_place", F.row_number().over(W.partitionBy("trial").orderBy(drawn, "cell"))).where(F.col("_place") <= F.col("trial"))
    return taken.select("trial", "cell", "group").unionByName(groups.where(F.col("group") == 2).crossJoin(rounds).select("trial", "cell", "group"))


def trial_statistics(values: DataFrame, dealt: DataFrame, by: list[str], welch: bool = True) -> DataFrame:
    """t statistics of every trial of ``dealt_groups``: trial, by, n1, n2, mean1, mean2, t, df."""
    return t_statistics(values.join(dealt, "cell"), ["trial", *by], welch)


def trial_tests(values: DataFrame, dealt: DataFrame, by: list[str], method: str = "welch", most: float = 5.0) -> DataFrame:
    """Every trial's tests with p and q, q within the trial; loci whose lesser mean reaches ``most`` go."""
    rows = values.join(dealt, "cell")
    if method == "wilcox":
        tested = u_statistics(rows, ["trial", *by]).withColumn("p", F.coalesce(normal_probability("z"), F.lit(1.0)))
    elif method in ("ttest", "welch"):
        tested = t_statistics(rows, ["trial", *by], method == "welch").withColumn("p", F.coalesce(t_probability("t", "df"), F.lit(1.0)))
    else:
        raise ValueError(f"unknown method {method!r}")
    return adjust_p(tested.where(F.least("mean1", "mean2") < most), "p", ["trial"], "fdr")


def band_results(tested: DataFrame, resolution: int, bins: int) -> DataFrame:
    """Results of tests on a band (chrom, pos1, pos2, ...) that have a p, within ``bins`` of the diagonal, with its number k, in order."""
    k = F.floor((F.col("pos2") - F.col("pos1")) / resolution)
    return tested.withColumn("k", k).where((F.col("k") >= 0) & (F.col("k") < bins) & (F.col("p") > 0)).orderBy("chrom", "pos1", "pos2")
