"""The kernels that the operators share: range counts, bucketed joins, grids, runs, ranks.

Open-source Spark plans an inequality join as a nested loop, so proximity and
interval joins are rewritten here as equi-joins on buckets with an exact
residual.  Buckets are part of the join key, which lets adaptive execution
split those that are skewed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import bin_start


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def count_in_range(points: DataFrame, keys: list[str], pos: str, weight: str, before: int, after: int, name: str = "n_near", block: int | None = None) -> DataFrame:
    """``points`` (distinct keys and pos) with the sum of ``weight`` over [pos - before, pos + after], itself included.

    Windows run within blocks of positions; a point is copied to the blocks its
    reach touches, so no window spans a chromosome.
    """
    block = block or 64 * max(1, before + after)
    first, last = F.floor((F.col(pos) - after) / block), F.floor((F.col(pos) + before) / block)
    dealt = points.withColumn("_block", F.explode(F.sequence(first, last)))
    window = W.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(-before, after)
    counted = dealt.withColumn(name, F.sum(weight).over(window))
    return counted.where(F.col("_block") == F.floor(F.col(pos) / block)).drop("_block")


def covering_end(intervals: DataFrame, points: DataFrame, keys: list[str], pos: str, block: int = 1_000_000, name: str = "reach") -> DataFrame:
    """``points`` with the farthest end of an interval that starts before ``pos`` and reaches its block; null without one.

    ``intervals`` has the keys, start and end.  Existence questions (is there an
    interval from before a to b or beyond?) thus need no join.
    """
    first, last = F.floor((F.col("start") + 1) / block), F.floor(F.col("end") / block)
    spread = intervals.where("end > start").select(*keys, F.explode(F.sequence(first, F.greatest(first, last))).alias("_block"), F.col("start").alias("_at"), F.col("end").alias("_end"))
    asked = points.withColumn("_block", F.floor(F.col(pos) / block)).withColumn("_at", F.col(pos)).withColumn("_end", F.lit(None).cast("bigint")).withColumn("_asked", F.lit(True))
    both = asked.unionByName(spread.withColumn("_asked", F.lit(False)), allowMissingColumns=True)
    window = W.partitionBy(*keys, "_block").orderBy("_at").rangeBetween(W.unboundedPreceding, -1)
    return both.withColumn(name, F.max("_end").over(window)).where("_asked").drop("_block", "_at", "_end", "_asked")


def bucket_join(left: DataFrame, right: DataFrame, keys: list[str], coords: list[tuple[str, str]], size: float, residual: Column) -> DataFrame:
    """Pairs of rows with equal keys whose coordinates differ by ``size`` at most on every axis and satisfy ``residual``.

    ``coords`` names each axis on the left and the right; apart from the keys the
    sides must not share column names.  The right side is copied to the
    neighbouring cells, so give the smaller one there.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(size))
    names = [f"_cell{i}" for i in range(len(coords))]
    a = left.select("*", *[cell(lc).alias(n) for (lc, _), n in zip(coords, names, strict=True)])
    shifts = F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(shift, names, strict=True)]) for shift in product((-1, 0, 1), repeat=len(coords))])
    b = right.withColumn("_shift", F.explode(shifts)).select(*right.columns, *[(cell(rc) + F.col(f"_shift.{n}")).alias(n) for (_, rc), n in zip(coords, names, strict=True)])
    return a.join(b, [*keys, *names]).where(residual).drop(*names)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], blocks: int = 1024) -> DataFrame:
    """All pairs of rows with equal keys, where a key has many rows and every pair is asked for.

    Both sides are dealt out by their ids, so about ``blocks`` meetings share a key: none holds more of
    ``right`` than a part by the root of that number, and nothing is broadcast.
    """
    width = max(1, math.isqrt(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")))
    own = lambda ids: F.pmod(F.xxhash64(*ids), F.lit(width).cast("bigint"))
    on, parts = [*keys, "_row", "_column"], max(1, width * width // 4)
    # a number of partitions of its own: the rows sent are few, those made are not
    a = left.withColumn("_row", own(left_id)).withColumn("_column", every).repartition(parts, *on)
    b = right.withColumn("_column", own(right_id)).withColumn("_row", every).repartition(parts, *on)
    return a.join(b.hint("shuffle_hash"), on).drop("_row", "_column")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], bin_size: int, mode: str = "overlap", how: str = "inner") -> DataFrame:
    """Pairs of half-open intervals (start, end on the left; r_start, r_end on the right) with equal keys.

    Modes: overlap, within (left inside right), contain (right inside left).
    Both sides are dealt to the bins they touch and meet in the first common bin
    only, so no pair appears twice.  ``how`` may be left_semi or left_anti.
    """
    if mode not in ("overlap", "within", "contain"):
        raise ValueError(f"unknown mode {mode!r}")
    bins = lambda s, e: F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.greatest(F.col(e) - 1, F.col(s)) / bin_size))
    test = {
        "overlap": (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")),
        "within": (F.col("start") >= F.col("r_start")) & (F.col("end") <= F.col("r_end")),
        "contain": (F.col("r_start") >= F.col("start")) & (F.col("r_end") <= F.col("end")),
    }[mode]
    if how == "inner":
        a = left.withColumn("_bin", F.explode(bins("start", "end")))
        b = right.withColumn("_bin", F.explode(bins("r_start", "r_end")))
        first = F.floor(F.greatest(F.col("start"), F.col("r_start")) / bin_size)
        return a.join(b, [*keys, "_bin"]).where(test & (F.col("_bin") == first)).drop("_bin")
    # rows with the same interval fare alike, so the distinct intervals decide; no row numbers, which a retry may deal anew
    spots = left.select(*keys, "start", "end").distinct()
    hits = interval_join(spots, right, keys, bin_size, mode).select(*keys, "start", "end").distinct()
    return left.join(hits, [*keys, "start", "end"], how).select(*left.columns)


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, bin_size: int) -> DataFrame:
    """Points inside half-open intervals (r_start, r_end); a point in two intervals appears twice."""
    a = points.withColumn("_bin", F.floor(F.col(pos) / bin_size))
    b = intervals.where("r_end > r_start").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("r_start") / bin_size), F.floor((F.col("r_end") - 1) / bin_size))))
    return a.join(b, [*keys, "_bin"]).where((F.col(pos) >= F.col("r_start")) & (F.col(pos) < F.col("r_end"))).drop("_bin")


def grid(extents: DataFrame, keys: list[str], size: str, resolution: int, pos: str = "pos") -> DataFrame:
    """All bin starts below ``size`` for each row of ``extents``."""
    return extents.where(F.col(size) > 0).select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(size).cast("bigint") - 1, F.lit(resolution).cast("bigint"))).alias(pos))


def densify(values: DataFrame, extents: DataFrame, keys: list[str], size: str, resolution: int, columns: list[str], pos: str = "pos", fill: float | None = 0) -> DataFrame:
    """``values`` on the full grid; what is off the grid vanishes, what is missing becomes ``fill``."""
    out = grid(extents, keys, size, resolution, pos).join(values, [*keys, pos], "left")
    return out if fill is None else out.na.fill(fill, columns)


#: Positions of one block of the windows of ``islands`` and ``chains``.
RUN_BLOCK = 5_000_000


def _carried(df: DataFrame, keys: list[str], value: Column, how: Callable[[str], Column], name: str) -> DataFrame:
    """``df`` (with _block) with ``how`` of ``value`` over all earlier blocks of its keys; the window runs over a row for each block."""
    blocks = df.groupBy(*keys, "_block").agg(value.alias("_of"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    return df.join(blocks.select(*keys, "_block", how("_of").over(earlier).alias(name)), [*keys, "_block"])


def _numbered(flagged: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Running number of the rows marked _fresh: within blocks, and carried from block to block."""
    within = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    carried = _carried(flagged, keys, F.sum("_fresh"), F.sum, "_before")
    return carried.withColumn(name, (F.sum("_fresh").over(within) + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_fresh", "_before", "_block")


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, name: str = "island", block: int = RUN_BLOCK) -> DataFrame:
    """Numbers runs of intervals: a new run begins where start exceeds the farthest end so far by more than ``gap``.

    Distinct intervals are numbered, in blocks of starts; what crosses a border is carried by a row for each block.
    """
    spots = df.select(*keys, start, end).distinct().withColumn("_block", F.floor(F.col(start) / block))
    before = W.partitionBy(*keys, "_block").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reach = F.greatest(F.max(end).over(before), F.col("_reach"))
    carried = _carried(spots, keys, F.max(end), F.max, "_reach")
    flagged = carried.withColumn("_fresh", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).drop("_reach")
    return df.join(_numbered(flagged, keys, [start, end], name), [*keys, start, end]).select(*df.columns, name)


def chain_numbers(df: DataFrame, keys: list[str], pos: str, gap: int, name: str, block: int = RUN_BLOCK) -> DataFrame:
    """keys, pos and the number of the chain: neighbours in a chain are ``gap`` apart at most.

    Distinct positions first, so hot ones stay small; windows run within blocks,
    and the last position of the blocks before is carried by a row for each block.
    """
    spots = df.select(*keys, pos).distinct().withColumn("_block", F.floor(F.col(pos) / block))
    within = W.partitionBy(*keys, "_block").orderBy(pos)
    last = F.coalesce(F.lag(pos).over(within), F.col("_last"))
    carried = _carried(spots, keys, F.max(pos), F.max, "_last")
    flagged = carried.withColumn("_fresh", F.when(F.col(pos) - last <= gap, 0).otherwise(1)).drop("_last")
    return _numbered(flagged, keys, [pos], name)


def chains(df: DataFrame, keys: list[str], pos: str, gap: int, name: str, block: int = RUN_BLOCK) -> DataFrame:
    """``df`` with the numbers of ``chain_numbers``."""
    return df.join(chain_numbers(df, keys, pos, gap, name, block), [*keys, pos]).select(*df.columns, name)


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing their mean."""
    order = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2


def adjust_p(df: DataFrame, p: str, keys: list[str], method: str = "fdr", name: str = "q", ties: list[str] | None = None) -> DataFrame:
    """Multiple-testing correction of non-null p: fdr (not clipped), bonferroni (not clipped) or holm (no monotone step).

    Rows with equal p get equal values: the last rank of the tie for fdr, the first for holm; with ``ties`` such
    rows are ranked by these columns, which matters for holm only.  Without ``keys``
    ranks come from range partitions whose sums are combined on the driver, so no window spans the table.
    """
    if method not in ("fdr", "bonferroni", "holm"):
        raise ValueError(f"unknown method {method!r}")
    # a row for each distinct p: ranks of ties are running counts, whatever the number of rows that share a p
    order = [p, *(ties or [])]
    tally = df.where(F.col(p).isNotNull()).groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_t"))
    if keys:
        upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        ranked = tally.withColumn("_last", F.sum("_t").over(upto)).withColumn("_n", F.sum("_t").over(W.partitionBy(*keys)))
    else:
        ranked = _ranked(tally, order)
    if ties:  # rows that are equal in all of these have a rank each as well
        df = df.withColumn("_turn", F.row_number().over(W.partitionBy(*keys, *order).orderBy(p)))
        order = [*order, "_turn"]
        ranked = ranked.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int")))).withColumn("_last", F.col("_last") - F.col("_t") + F.col("_turn")).withColumn("_t", F.lit(1))
    q = {"bonferroni": F.col("_n") * F.col(p), "holm": (F.col("_n") - F.col("_last") + F.col("_t")) * F.col(p), "fdr": F.col("_n") / F.col("_last") * F.col(p)}[method]
    ranked = ranked.withColumn(name, q)
    if method == "fdr":
        later = W.partitionBy(*keys).orderBy(*_downwards(order)).rowsBetween(W.unboundedPreceding, 0)
        ranked = ranked.withColumn(name, F.min(name).over(later)) if keys else _lowered(ranked, order, name)
    found = ranked.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(p).alias("_p"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(order[1:])], F.col(name).alias("_adjusted"))
    same = F.col(p) == F.col("_p")
    for i, c in enumerate(order[1:]):
        same = same & F.col(c).eqNullSafe(F.col(f"_tie{i}"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return df.join(found, same, "left").select(*[F.col(c) for c in df.columns if c not in (name, "_turn")], F.col("_adjusted").alias(name))


def _downwards(order: list[str]) -> list[Column]:
    """The order from behind: a frame that ends at the row is a running value, one that begins there is summed anew for each row."""
    return [F.desc(c) for c in order]


def _parts(ordered: DataFrame, order: list[str], value: Column) -> list:
    """One value for each range partition of ``ordered``, in order: a number of rows that the partitions bound."""
    return ordered.groupBy("_part").agg(F.min(F.struct(*order)).alias("low"), value.alias("v")).orderBy("low").collect()


def _with(ordered: DataFrame, values: dict[int, float], name: str, kind: str) -> DataFrame:
    rows = ordered.sparkSession.createDataFrame(list(values.items()), f"_part int, {name} {kind}")
    return ordered.join(F.broadcast(rows), "_part")


def _ranked(tally: DataFrame, order: list[str]) -> DataFrame:
    """``tally`` (distinct ``order``, p first, _t rows each) over a whole table, in range partitions: _last (rows up to p), _n (all rows)."""
    from chromaloom.sources.shared import written

    ordered = written(tally.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    before, seen = {}, 0
    for r in _parts(ordered, order, F.sum("_t")):
        before[r["_part"]] = seen
        seen += r["v"]
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return _with(ordered, before, "_before", "bigint").withColumn("_last", F.sum("_t").over(within) + F.col("_before")).withColumn("_n", F.lit(seen)).drop("_before")


def _lowered(ranked: DataFrame, order: list[str], name: str) -> DataFrame:
    """The least of ``name`` from each p on, in the partitions of ``_ranked``."""
    after, least = {}, float("inf")
    for r in reversed(_parts(ranked, order, F.min(name))):
        after[r["_part"]] = least
        least = min(least, r["v"])
    later = W.partitionBy("_part").orderBy(*_downwards(order)).rowsBetween(W.unboundedPreceding, 0)
    return _with(ranked, after, "_after", "double").withColumn(name, F.least(F.min(name).over(later), "_after")).drop("_after")


def distance(axes: tuple[str, ...] = ("x", "y", "z"), left: str = "", right: str = "r_") -> Column:
    """Euclidean distance between columns left+axis and right+axis; squares as products, so engines agree."""
    return F.sqrt(squared_distance(axes, left, right))


def squared_distance(axes: tuple[str, ...] = ("x", "y", "z"), left: str = "", right: str = "r_") -> Column:
    parts = [(F.col(left + a) - F.col(right + a)) * (F.col(left + a) - F.col(right + a)) for a in axes]
    return reduce(lambda a, b: a + b, parts)


def renamed(df: DataFrame, columns: list[str], prefix: str = "r_", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns as they are and ``columns`` under ``prefix``."""
    return df.select(*(keep or []), *[F.col(c).alias(prefix + c) for c in columns])


def floor_bin(pos: str, resolution: int) -> Column:
    return bin_start(pos, resolution)
