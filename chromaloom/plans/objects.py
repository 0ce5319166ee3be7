"""Queries on cells as objects, and on operators over groups of cells and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.cells import Cell, MultiCell, load_cells, load_profiled, template_names
from chromaloom.operators import differential as diff
from chromaloom.operators import domains as dm
from chromaloom.operators import matrix as mx
from chromaloom.operators import multicell as mc
from chromaloom.operators import spatial as sp
from chromaloom.plans.base import Book
from chromaloom.sources.shared import shared_dir

BOOK = Book()
query = BOOK.query
R = 20_000


@query("cell_data", "SELECT chrom, pos, x, feature FROM tdg WHERE chrom = 'chr2a' AND pos >= 100000 AND pos < 900000 AND feature > 2", "tdg")
def cell_data(tdg: DataFrame) -> DataFrame:
    return Cell(tdg, "c0", R).get_data("chr2a:100000-900000", "feature > 2").select("chrom", "pos", "x", "feature")


@query("cell_cluster", "SELECT chrom, pos FROM tdg WHERE feature = 3", "tdg")
def cell_cluster(tdg: DataFrame) -> DataFrame:
    return Cell(tdg, "c0", R).get_cluster(3, "feature").select("chrom", "pos")


@query("cell_feature_vector", "SELECT chrom, pos, feature FROM tdg", "tdg")
def cell_feature_vector(tdg: DataFrame) -> DataFrame:
    return Cell(tdg, "c0", R).feature_vector("feature")


@query("cells_subset", "SELECT cell, chrom, pos, x FROM cells3d WHERE cell IN ('c1', 'c3') AND chrom = 'chr1' AND pos < 400000", "cells3d")
def cells_subset(cells: DataFrame) -> DataFrame:
    return MultiCell.of(cells, R).subset(["c3", "c1"]).get_data("chr1:0-400000").select("cell", "chrom", "pos", "x")


@query("cells_slice", "SELECT cell, count(*) AS n FROM cells3d WHERE cell IN ('c1', 'c2') GROUP BY cell", "cells3d")
def cells_slice(cells: DataFrame) -> DataFrame:
    return MultiCell.of(cells, R)[1:3].get_data().groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("cells_by_place", "SELECT chrom, pos, x FROM cells3d WHERE cell = 'c4'", "cells3d")
def cells_by_place(cells: DataFrame) -> DataFrame:
    return MultiCell.of(cells, R)[-1].get_data().select("chrom", "pos", "x")


@query("cells_metadata", "m AS (SELECT cell, count(*) AS particles, count(DISTINCT chrom) AS chromosomes FROM cells3d GROUP BY cell), k AS (SELECT cell, sum(umi) AS umi FROM rna GROUP BY cell) SELECT m.cell, row_number() OVER (ORDER BY m.cell) - 1 AS place, particles, chromosomes, umi FROM m LEFT JOIN k USING (cell)", "cells3d", "rna")
def cells_metadata(cells: DataFrame, rna: DataFrame) -> DataFrame:
    return MultiCell.of(cells, R, about=rna.groupBy("cell").agg(F.sum("umi").alias("umi"))).metadata()


@query("cells_tables", "SELECT 'loci' AS name, chrom, pos, value, particles FROM loci JOIN (SELECT cell, count(*) AS particles FROM cells3d GROUP BY cell) USING (cell) WHERE cell IN ('c0', 'c1')", "cells3d", "loci")
def cells_tables(cells: DataFrame, loci: DataFrame) -> DataFrame:
    known = MultiCell.of(cells, R).with_table("loci", loci).with_table("gone", cells).without_table("gone").subset(["c0", "c1"])
    (name,) = known.table_names()
    return known.annotated(name).select(F.lit(name).alias("name"), "chrom", "pos", "value", "particles")


@query("cells_loaded", "SELECT cell, chrom, pos, round(x, 3) AS x FROM cells3d WHERE cell <> 'c2'", "cells3d")
def cells_loaded(cells: DataFrame) -> DataFrame:
    from chromaloom.sources.writers import store_structures

    base = f"{shared_dir(cells.sparkSession)}/cells-{uuid.uuid4().hex}"
    store_structures(cells, base)
    found = load_cells(cells.sparkSession, f"{base}/*/*.3dg", R, ["c0", "c1", "c3", "c4", "none"])
    return found.get_data().select("cell", "chrom", "pos", F.round(F.col("x").cast("double"), 3).alias("x"))


@query("cells_profiled", "SELECT cell, chrom, pos, cast(count(*) AS BIGINT) AS rows FROM cells3d GROUP BY ALL", "cells3d", "fragments")
def cells_profiled(cells: DataFrame, fragments: DataFrame) -> DataFrame:
    """Attaching keeps every particle once."""
    out = load_profiled(MultiCell.of(cells, R), {"atac": fragments})
    return out.data.groupBy("cell", "chrom", "pos").agg(F.count(F.lit(1)).alias("rows"))


@query("names_from_reference", "SELECT s.chrom AS name, r.size AS value FROM (SELECT DISTINCT chrom FROM genes UNION ALL SELECT 'chrX') s LEFT JOIN sizes r ON r.chrom = s.chrom", "genes", "sizes")
def names_from_reference(genes: DataFrame, sizes: DataFrame) -> DataFrame:
    names = genes.select(F.col("chrom").alias("name")).distinct().union(genes.sparkSession.createDataFrame([("chrX",)], "name string"))
    return template_names(names, "name", sizes, "chrom", "size")


@query("scores_right", "SELECT t.chrom, t.pos, t.label, l.value FROM (SELECT * FROM loci WHERE cell = 'c0') l RIGHT JOIN track t ON t.chrom = l.chrom AND t.pos = l.pos", "loci", "track")
def scores_right(loci: DataFrame, track: DataFrame) -> DataFrame:
    return mx.labelled(loci.where("cell = 'c0'"), track, "right").select("chrom", "pos", "label", "value")


@query("scores_full", "SELECT coalesce(t.chrom, l.chrom) AS chrom, coalesce(t.pos, l.pos) AS pos, t.label, l.value FROM (SELECT * FROM loci WHERE cell = 'c0') l FULL JOIN track t ON t.chrom = l.chrom AND t.pos = l.pos", "loci", "track")
def scores_full(loci: DataFrame, track: DataFrame) -> DataFrame:
    return mx.labelled(loci.where("cell = 'c0'"), track, "full").select("chrom", "pos", "label", "value")


_T = "count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, avg(value) FILTER (g = 1) AS mean1, avg(value) FILTER (g = 2) AS mean2, var_samp(value) FILTER (g = 1) AS v1, var_samp(value) FILTER (g = 2) AS v2"
_WELCH = "SELECT trial, chrom, pos, n1, n2, mean1, mean2, CASE WHEN n1 > 1 AND n2 > 1 AND v1 / n1 + v2 / n2 > 0 THEN (mean1 - mean2) / sqrt(v1 / n1 + v2 / n2) END AS t FROM s"


@query("trials_celltype", f"s AS (SELECT 1 AS trial, chrom, pos, {_T} FROM (SELECT *, CASE WHEN CAST(substr(cell, 2) AS INT) < 6 THEN 1 ELSE 2 END AS g FROM loci) GROUP BY ALL) {_WELCH}", "loci")
def trials_celltype(loci: DataFrame) -> DataFrame:
    dealt = diff.dealt_groups(loci.select("cell").distinct(), "celltype", _types(loci))
    return diff.trial_statistics(loci, dealt, ["chrom", "pos"]).drop("df")


@query("trials_random", f"c AS (SELECT DISTINCT cell FROM loci), d AS (SELECT trial, cell, row_number() OVER (PARTITION BY trial ORDER BY md5(concat(trial, '_', cell)), cell) AS p, count(*) OVER (PARTITION BY trial) AS n FROM c, range(31, 36) t(trial)), s AS (SELECT trial, chrom, pos, {_T} FROM (SELECT trial, loci.*, CASE WHEN p <= ceil(n / 2) THEN 1 ELSE 2 END AS g FROM loci JOIN d USING (cell)) GROUP BY ALL) {_WELCH}", "loci")
def trials_random(loci: DataFrame) -> DataFrame:
    return diff.trial_statistics(loci, diff.dealt_groups(loci.select("cell").distinct(), "random", trials=5), ["chrom", "pos"]).drop("df")


@query("trials_sample", f"a AS (SELECT DISTINCT cell, CASE WHEN CAST(substr(cell, 2) AS INT) < 6 THEN 1 ELSE 2 END AS g FROM loci), d AS (SELECT trial, cell, g FROM (SELECT trial, cell, g, row_number() OVER (PARTITION BY trial, g ORDER BY md5(concat(trial, '_', cell)), cell) AS p FROM a, (VALUES (3), (5)) t(trial)) WHERE g = 2 OR p <= trial), s AS (SELECT trial, chrom, pos, {_T} FROM loci JOIN d USING (cell) GROUP BY ALL) {_WELCH}", "loci")
def trials_sample(loci: DataFrame) -> DataFrame:
    return diff.trial_statistics(loci, diff.dealt_groups(loci.select("cell").distinct(), "sample", _types(loci), sizes=(3, 5)), ["chrom", "pos"]).drop("df")


@query("trials_allele", f"s AS (SELECT 1 AS trial, chrom, pos, {_T} FROM (SELECT regexp_replace(chrom, '[ab]$', '') AS chrom, pos, feature AS value, CASE WHEN chrom LIKE '%a' THEN 1 ELSE 2 END AS g FROM tdg) GROUP BY ALL) {_WELCH}", "tdg")
def trials_allele(tdg: DataFrame) -> DataFrame:
    letter = F.regexp_extract("chrom", "([ab])$", 1)
    values = tdg.select(F.concat("cell", letter).alias("cell"), F.regexp_replace("chrom", "[ab]$", "").alias("chrom"), "pos", F.col("feature").alias("value"))
    return diff.trial_statistics(values, diff.dealt_groups(tdg.select("cell").distinct(), "allele"), ["chrom", "pos"]).drop("df")


def _types(loci: DataFrame) -> DataFrame:
    return loci.select("cell").distinct().withColumn("group", F.when(F.substring("cell", 2, 9).cast("int") < 6, 1).otherwise(2))


@query("trials_tested", None, "loci")
def trials_tested(loci: DataFrame) -> DataFrame:
    return diff.trial_tests(loci, diff.dealt_groups(loci.select("cell").distinct(), "random", trials=5), ["chrom", "pos"], "wilcox", 1e9)


_NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("nearest_of_random", f"t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('0_', chrom, '_', pos)), chrom, pos) AS r, count(*) OVER () AS n FROM tdg) WHERE r <= floor(n * 0.2e0)), d AS (SELECT a.chrom, a.pos, {_NEAR} AS d FROM t a JOIN t b ON a.chrom <> b.chrom OR a.pos <> b.pos), k AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY d) AS k FROM d) SELECT chrom, pos, avg(d) AS mean FROM k WHERE k <= 3 GROUP BY ALL", "tdg")
def nearest_of_random(tdg: DataFrame) -> DataFrame:
    return sp.nearest_of_random(tdg, 0.2, 3, 4.0).drop("cell")


_ARM = """{n}o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY md5(concat('0_', chrom, '_', pos)), chrom, pos) AS r FROM {n}) WHERE r <= 20),
{n}t AS (SELECT DISTINCT chrom AS target FROM {n}),
{n}f AS (SELECT * FROM (SELECT target, p.*, row_number() OVER (PARTITION BY target ORDER BY md5(concat('0o_', chrom, '_', pos)), chrom, pos) AS r FROM {n} p JOIN {n}t ON chrom <> target) WHERE r <= 30),
{n}d AS (SELECT {arm} AS arm, a.chrom, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM {n}o a JOIN {n}f b ON b.target = a.chrom)"""


@query("sampled_distances", "every AS (SELECT * FROM tdg), wanted AS (SELECT * FROM tdg WHERE feature > 3), " + _ARM.format(n="every", arm=1) + ", " + _ARM.format(n="wanted", arm=2) + " SELECT * FROM everyd UNION ALL SELECT * FROM wantedd", "tdg")
def sampled_distances(tdg: DataFrame) -> DataFrame:
    return sp.sampled_distances(tdg, "feature", 3.0, 20, 30).drop("cell")


@query("sampled_distances_test", "every AS (SELECT * FROM tdg), wanted AS (SELECT * FROM tdg WHERE feature > 3), " + _ARM.format(n="every", arm=1) + ", " + _ARM.format(n="wanted", arm=2) + """, u AS (SELECT * FROM everyd UNION ALL SELECT * FROM wantedd),
k AS (SELECT arm, distance, rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0e0 AS r FROM u)
SELECT count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 2) AS n2, avg(distance) FILTER (arm = 1) AS mean1, avg(distance) FILTER (arm = 2) AS mean2, sum(r) FILTER (arm = 1) - count(*) FILTER (arm = 1) * (count(*) FILTER (arm = 1) + 1) / 2.0e0 AS u FROM k""", "tdg")
def sampled_distances_test(tdg: DataFrame) -> DataFrame:
    rows = sp.sampled_distances(tdg, "feature", 3.0, 20, 30).select("cell", F.col("arm").alias("group"), F.col("distance").alias("value"))
    return diff.u_statistics(rows, ["cell"]).select("n1", "n2", "mean1", "mean2", "u")


@query("all_rmsd", None, "cells3d")
def all_rmsd(cells: DataFrame) -> DataFrame:
    return mc.all_rmsd(cells)


@query("all_rmsd_summary", None, "cells3d")
def all_rmsd_summary(cells: DataFrame) -> DataFrame:
    return mc.rmsd_summary(mc.all_rmsd(cells))


@query("band_results", "d AS (SELECT chrom, pos1, pos2, (value % 7) / 7.0e0 AS p FROM (SELECT chrom, bin1 AS pos1, bin2 AS pos2, value FROM pixels)) SELECT chrom, pos1, pos2, p, (pos2 - pos1) // 20000 AS k FROM d WHERE (pos2 - pos1) // 20000 < 3 AND p > 0", "pixels")
def band_results(pixels: DataFrame) -> DataFrame:
    tested = pixels.select("chrom", F.col("bin1").alias("pos1"), F.col("bin2").alias("pos2"), (F.col("value") % 7 / 7.0).alias("p"))
    return diff.band_results(tested, R, 3)


@query("modularity_boundaries", None, "pixels")
def modularity_boundaries(pixels: DataFrame) -> DataFrame:
    return dm.modularity_boundaries(pixels, R, 100.0, 1.0, 3).drop("cell")


@query("hidden_states", None, "loci")
def hidden_states(loci: DataFrame) -> DataFrame:
    return dm.hidden_states(loci, 3)
