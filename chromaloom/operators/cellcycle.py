"""Cell-cycle indices of contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.operators.preprocess import legs

#: Bounds of the distance classes, all of them open.
SHORT, MITOTIC, FAR = (23_000, 2_000_000), (2_000_000, 12_000_000), (4_500_000, 225_000_000)


def contact_phases(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """near_p, mitotic_p, far_avg and the phase that the first fitting rule assigns, by cell; null shares without long contacts."""
    keys = ["cell"] if keys is None else keys
    d = F.abs(F.col("pos1") - F.col("pos2"))
    between = lambda x: (d > x[0]) & (d < x[1])
    n = pairs.where("chrom1 = chrom2").groupBy(*keys).agg(
        F.count_if(d > SHORT[0]).alias("_all"), F.count_if(between(SHORT)).alias("_short"), F.count_if(between(MITOTIC)).alias("_mitotic"), F.avg(F.when(between(FAR), d)).alias("far_avg")
    )
    out = n.select(*keys, F.try_divide(F.col("_short").cast("double"), F.col("_all")).alias("near_p"), F.try_divide(F.col("_mitotic").cast("double"), F.col("_all")).alias("mitotic_p"), "far_avg")
    s, m = F.col("near_p"), F.col("mitotic_p")
    phase = (
        F.when((m >= 0.3) & (s <= 0.5), "Post-M").when((s > 0.5) & (s + 1.8 * m > 1.0), "Pre-M").when(s <= 0.63, "G1").when((s > 0.63) & (s <= 0.785), "early/mid-S").when(s > 0.785, "mid-S/G2").otherwise("blank")
    )
    return out.withColumn("phase", phase)


def breaks(kind: str, n: int, resolution: int = 100_000) -> list[float]:
    """Lower bounds of the distance windows: geometric (1000 * 2^(i/8) behind 0) or linear."""
    if kind == "geometric":
        return [0.0] + [1000 * 2 ** (0.125 * i) for i in range(n)]
    if kind == "linear":
        return [float(i * resolution) for i in range(n + 1)]
    raise ValueError("kind must be geometric or linear")


def distance_windows(pairs: DataFrame, kind: str = "geometric", n: int = 150, resolution: int = 100_000, keys: list[str] | None = None) -> DataFrame:
    """Share of the cis contacts in each distance window, empty ones too; the last is open: keys, turn, low, share."""
    keys = ["cell"] if keys is None else keys
    lows = F.array(*[F.lit(b) for b in breaks(kind, n, resolution)])
    cis = pairs.where("chrom1 = chrom2")
    d = F.abs(F.col("pos1") - F.col("pos2")).cast("double")
    # the number of bounds at or below the distance, by bisection over sorted literals
    turn = F.floor(d / resolution) if kind == "linear" else F.when(d < 1000, 0).otherwise(F.floor(F.log2(d / 1000) * 8) + 1)
    turn = F.least(turn.cast("int"), F.lit(n))
    # rounding of the logarithm may be off by one at a bound
    turn = F.when((turn < n) & (d >= F.get(lows, turn + 1)), turn + 1).when((turn > 0) & (d < F.get(lows, turn)), turn - 1).otherwise(turn)
    counted = cis.groupBy(*keys, turn.alias("turn")).agg(F.count(F.lit(1)).alias("_n"))
    totals = cis.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    every = totals.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return every.join(counted, [*keys, "turn"], "left").select(*keys, "turn", F.get(lows, F.col("turn")).alias("low"), (F.coalesce("_n", F.lit(0)) / F.col("_total")).alias("share"))


def replication_scores(pairs: DataFrame, timing: DataFrame, expand: int = 10_000, keys: list[str] | None = None) -> DataFrame:
    """Share of legs with a positive mean timing, and share of legs with any, by cell.

    A leg's segments (chrom, start, end, rep_value) lie wholly within ``expand``
    of it.  Legs without segments count in the denominator; a leg on a chromosome
    without segments makes the whole cell null.  Equal positions are scored once.
    """
    keys = ["cell"] if keys is None else keys
    places = legs(pairs, keys).groupBy(*keys, "chrom", "pos").agg(F.count(F.lit(1)).alias("_n"))
    spots = places.select("chrom", "pos").distinct()
    size = max(1, 2 * expand)
    near = spots.withColumn("_bin", F.explode(F.sequence(F.floor((F.col("pos") - expand) / size), F.floor((F.col("pos") + expand) / size))))
    segments = timing.select("chrom", "start", "end", "rep_value", F.floor(F.col("start") / size).alias("_bin"))
    found = near.join(segments, ["chrom", "_bin"]).where((F.col("start") >= F.col("pos") - expand) & (F.col("end") <= F.col("pos") + expand))
    means = found.groupBy("chrom", "pos").agg(F.avg("rep_value").alias("_mean"))
    known = timing.select("chrom", F.lit(True).alias("_known")).distinct()
    scored = places.join(means, ["chrom", "pos"], "left").join(F.broadcast(known), "chrom", "left")
    total = F.sum("_n")
    share = lambda c: F.when(F.sum(F.when(F.col("_known").isNull(), 1).otherwise(0)) == 0, F.sum(F.when(c, F.col("_n")).otherwise(0)) / total)
    return scored.groupBy(*keys).agg(share(F.col("_mean") > 0).alias("repli_score"), share(F.col("_mean").isNotNull()).alias("annote_ratio"))


#: The phases in the order of the cycle.
PHASES = ("G0", "M", "G1", "Early-S", "Mid-S", "Late-S", "G2")


def order_within_phases(cells: DataFrame) -> DataFrame:
    """Cells (cell, phase, near_p, far_avg, repli_score, max_bin) numbered along the cycle: turn.

    The key within a phase: indices by the cohort's variances in S and G2,
    standardised ones in G0 and G1, the fullest distance window in M.
    """
    stats = cells.agg(F.var_samp("near_p").alias("_vn"), F.var_samp("repli_score").alias("_vr"), *[f(c).alias(f"_{n}_{c}") for c in ("near_p", "far_avg") for n, f in (("m", F.avg), ("s", F.stddev_samp))]).withColumn("_k", F.lit(1))
    z = lambda c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))
    near, repli = F.try_divide("near_p", "_vn"), F.try_divide("repli_score", "_vr")
    phase = F.col("phase")
    key = F.when(phase == "Early-S", near + repli).when(phase.isin("Mid-S", "G2"), near).when(phase == "Late-S", near - repli).when(phase.isin("G1", "G0"), z("near_p") + z("far_avg")).otherwise(F.col("max_bin").cast("double"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, PHASES)), phase), F.lit(0)), F.lit(len(PHASES) + 1))
    keyed = cells.withColumn("_k", F.lit(1)).join(stats, "_k").withColumn("_rank", rank).withColumn("_key", key)
    return keyed.select(*cells.columns, F.row_number().over(W.orderBy("_rank", "_key", "cell")).cast("bigint").alias("turn"))
