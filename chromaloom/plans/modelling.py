"""Queries on dense models, clusters, smoothing and simulations, and on events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import models as md
from chromaloom.operators import seriation as se
from chromaloom.plans.base import Book
from chromaloom.streaming import windows

BOOK = Book()
query = BOOK.query
R = 20_000


def _rounded(df: DataFrame, column: str = "value") -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


@query("impute_walk", None, "pixels")
def impute_walk(pixels: DataFrame) -> DataFrame:
    return _rounded(md.walk_imputed(pixels, R, 1, 0.03))


@query("impute_walk_limit", None, "pixels")
def impute_walk_limit(pixels: DataFrame) -> DataFrame:
    return _rounded(md.limit_imputed(pixels, R))


@query("impute_propensity", None, "pixels")
def impute_propensity(pixels: DataFrame) -> DataFrame:
    return _rounded(md.propensity_imputed(pixels, R))


@query("impute_propensity_truncated", None, "pixels")
def impute_propensity_truncated(pixels: DataFrame) -> DataFrame:
    return _rounded(md.propensity_imputed(pixels, R, truncated=True))


@query("balance", None, "pixels")
def balance(pixels: DataFrame) -> DataFrame:
    return _rounded(md.balanced(pixels, R))


@query("call_compartments", None, "pixels", "track")
def call_compartments(pixels: DataFrame, track: DataFrame) -> DataFrame:
    out = md.compartments(pixels, track, R)
    return out.withColumns({c: F.round(c, 6) for c in ("pc1", "pc2", "pc3")})


@query("hull_volumes", None, "tdg")
def hull_volumes(tdg: DataFrame) -> DataFrame:
    return md.hull_volumes(tdg, ["cell", "chrom"])


@query("spatial_autocorrelation", None, "cells3d")
def spatial_autocorrelation(cells: DataFrame) -> DataFrame:
    return md.corrected_correlation(cells, 0.5, 10.0)


@query("dbscan", None, "tdg")
def dbscan(tdg: DataFrame) -> DataFrame:
    return md.dbscan(tdg, 1.0, 5)


@query("kmeans", None, "tdg")
def kmeans(tdg: DataFrame) -> DataFrame:
    return md.kmeans(tdg, 4).select("chrom", "pos", "cluster")


@query("spectral_compartments", None, "cells3d")
def spectral_compartments(cells: DataFrame) -> DataFrame:
    return md.spectral_compartments(cells, "feature")


@query("compartment_runs", "c AS (SELECT chrom, pos, CASE WHEN feature > 3 THEN 'A' ELSE 'B' END AS compartment FROM tdg), f AS (SELECT *, CASE WHEN lag(compartment) OVER (PARTITION BY chrom ORDER BY pos) IS NOT DISTINCT FROM compartment THEN 0 ELSE 1 END AS n FROM c) SELECT chrom, pos, compartment, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM f", "tdg")
def compartment_runs(tdg: DataFrame) -> DataFrame:
    return md.runs_of(tdg.withColumn("compartment", F.when(F.col("feature") > 3, "A").otherwise("B"))).select("chrom", "pos", "compartment", "run")


@query("chain_segments", "p AS (SELECT * FROM tdg WHERE pos % 100000 <> 0), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 20000 THEN 0 ELSE 1 END AS n FROM p) SELECT chrom, pos, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM f", "tdg")
def chain_segments(tdg: DataFrame) -> DataFrame:
    return md.chain_segments(tdg.where("pos % 100000 <> 0"), R).select("chrom", "pos", "segment")


@query("moving_average", "SELECT chrom, pos, avg(x) OVER w AS x, avg(y) OVER w AS y, avg(z) OVER w AS z FROM tdg WINDOW w AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)", "tdg")
def moving_average(tdg: DataFrame) -> DataFrame:
    return md.smooth(tdg, 5).select("chrom", "pos", "x", "y", "z")


_SMOOTHED = ", ".join(f"sum({a} * w) AS {a}" for a in "xyz")


@query("gaussian_trajectory", f"""n AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS m FROM tdg),
k AS (SELECT o, exp(-(o * o) / (2 * (5 / 3.0e0) * (5 / 3.0e0))) AS w FROM range(-7, 8) t(o)), s AS (SELECT o, w / (SELECT sum(w) FROM k) AS w FROM k),
j AS (SELECT n.chrom, n.pos, w, CASE WHEN i + o < 0 THEN -1 - (i + o) WHEN i + o >= m THEN 2 * m - 1 - (i + o) ELSE i + o END AS at FROM n, s)
SELECT j.chrom, j.pos, {_SMOOTHED} FROM j JOIN n ON n.chrom = j.chrom AND n.i = j.at GROUP BY ALL""", "tdg")
def gaussian_trajectory(tdg: DataFrame) -> DataFrame:
    return md.smooth_gaussian(tdg, 5).select("chrom", "pos", "x", "y", "z")


def _gap(axis: str) -> str:
    v = f"CASE WHEN pos % 100000 = 0 THEN NULL ELSE {axis} END"
    return f"""CASE WHEN pos % 100000 <> 0 THEN {axis} WHEN last_value({v} IGNORE NULLS) OVER b IS NULL THEN first_value({v} IGNORE NULLS) OVER a WHEN first_value({v} IGNORE NULLS) OVER a IS NULL THEN last_value({v} IGNORE NULLS) OVER b
    ELSE last_value({v} IGNORE NULLS) OVER b + (first_value({v} IGNORE NULLS) OVER a - last_value({v} IGNORE NULLS) OVER b) * (pos - last_value(CASE WHEN pos % 100000 <> 0 THEN pos END IGNORE NULLS) OVER b) / (first_value(CASE WHEN pos % 100000 <> 0 THEN pos END IGNORE NULLS) OVER a - last_value(CASE WHEN pos % 100000 <> 0 THEN pos END IGNORE NULLS) OVER b) END AS {axis}"""


@query("interpolate_gaps", f"SELECT chrom, pos, {_gap('x')}, {_gap('y')} FROM tdg WINDOW b AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY chrom ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", "tdg")
def interpolate_gaps(tdg: DataFrame) -> DataFrame:
    return md.interpolate(tdg.withColumns({a: F.when(F.col("pos") % 100000 != 0, F.col(a)) for a in "xyz"})).select("chrom", "pos", "x", "y")


D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("energy", f"d AS (SELECT greatest({D2}, 0.25e0) AS d FROM tdg a JOIN tdg b ON (a.chrom < b.chrom OR (a.chrom = b.chrom AND a.pos < b.pos)) AND {D2} <= 9) SELECT 'c0' AS cell, sum(1 / (d * d * d * (d * d * d)) - 1 / (d * d * d)) AS energy FROM d", "tdg")
def energy(tdg: DataFrame) -> DataFrame:
    return md.energy(tdg, 3.0, 0.5)


@query("layout", None, "cells3d")
def layout(cells: DataFrame) -> DataFrame:
    pairs = cells.select("cell", F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"), F.col("chrom").alias("chrom2"), (F.col("pos") + 100_000).alias("pos2"))
    return md.layout(cells, pairs)


def _optimised(method: str) -> None:
    @query(f"optimise_{method}", None, "cells3d")
    def run(cells: DataFrame) -> DataFrame:
        return md.optimise(cells, method)


for _name in ("gradient", "annealing", "genetic"):
    _optimised(_name)


@query("gene_regression", None, "rna", "loci")
def gene_regression(rna: DataFrame, loci: DataFrame) -> DataFrame:
    # a locus is a column: bins of a genome, ordered by chrom and pos like the weights
    names = [f"{r['chrom']}_{r['pos']}" for r in loci.select("chrom", "pos").distinct().orderBy("chrom", "pos").collect()]
    wide = loci.withColumn("k", F.concat_ws("_", "chrom", "pos")).groupBy("cell").pivot("k", names).agg(F.first("value") / 1000).na.fill(0.0)
    rows = rna.groupBy("cell", "gene").agg(F.sum("umi").alias("umi")).join(wide, "cell")
    return md.gene_regression(rows, names)


@query("bootstrap_shares", None, "cells3d")
def bootstrap_shares(cells: DataFrame) -> DataFrame:
    return md.bootstrap_shares(cells.select(F.col("chrom").alias("cluster"), F.concat("cell", F.lit("_"), "pos").alias("cell"), "x", "y"), {"x": 1.0, "y": 0.5})


@query("principal_components", None, "tdg")
def principal_components(tdg: DataFrame) -> DataFrame:
    return md.principal_components(tdg, ["x", "y", "z", "feature"]).select("chrom", "pos", "pc1", "pc2")


def _profiles(loci: DataFrame) -> tuple[list[str], list[list[float]]]:
    """One profile a cell; a cohort's cells fit the driver, as their order is computed there."""
    rows = loci.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("chrom", "pos", "value"))).alias("v")).orderBy("cell").collect()
    return [r["cell"] for r in rows], [[x["value"] for x in r["v"]] for r in rows]


def _ordered(name: str, how) -> None:  # noqa: ANN001
    @query(name, None, "loci")
    def run(loci: DataFrame) -> DataFrame:
        import numpy as np

        cells, profiles = _profiles(loci)
        perm = how(np.array(profiles))
        return loci.sparkSession.createDataFrame([(cells[c], i) for i, c in enumerate(perm)], "cell string, turn bigint")


_ordered("seriation_spectral", lambda p: se.baseline(se.profile_similarity(p)))
_ordered("seriation_local", lambda p: se.order(se.profile_similarity(p), 5, 4))
_ordered("seriation_circular", lambda p: se.baseline(se.profile_similarity(p), True))
_ordered("seriation_eta", lambda p: se.eta_trick(se.profile_similarity(p)))
_ordered("seriation_tour", lambda p: se.tour(p))


for _name in ("events_tumbling", "events_sliding", "events_session", "stream_bins", "stream_distinct"):
    BOOK.queries[_name] = getattr(windows, _name)
BOOK.sql["events_tumbling"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL"
BOOK.sql["events_session"] = """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, g"""
BOOK.sql["events_sliding"] = "SELECT date_trunc('hour', ts) - h * INTERVAL 1 HOUR AS start, count(*) AS n FROM events, (VALUES (0), (1)) t(h) GROUP BY ALL"
BOOK.sql["stream_distinct"] = "SELECT DISTINCT user_id FROM events"
BOOK.sql["stream_bins"] = "SELECT concat('c', user_id % 8) AS cell, concat('chr', 1 + user_id % 5) AS chrom, (event_id * 200 + user_id * 13) - (event_id * 200 + user_id * 13) % 20000 AS pos, count(*) AS count FROM events GROUP BY ALL"
