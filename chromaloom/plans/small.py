"""Queries on coordinates, small projections and plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.functions import coords as co
from chromaloom.operators import coverage as cov
from chromaloom.operators import differential as diff
from chromaloom.operators import matrix as mx
from chromaloom.operators import multicell as mc
from chromaloom.operators import preprocess as pre
from chromaloom.operators import spatial as sp
from chromaloom.plans.base import Book

BOOK = Book()
query = BOOK.query


@query("genome_literals", "l AS (SELECT concat(chrom, ':', start, '-', \"end\") AS l FROM genes) SELECT l AS literal, regexp_extract(l, '^([^:]+):', 1) AS chrom, CAST(regexp_extract(l, ':(\\d+)-', 1) AS BIGINT) AS start, CAST(regexp_extract(l, '-(\\d+)$', 1) AS BIGINT) AS \"end\" FROM l", "genes")
def genome_literals(genes: DataFrame) -> DataFrame:
    lit = genes.select(F.concat("chrom", F.lit(":"), "start", F.lit("-"), "end").alias("literal"))
    return lit.select("literal", *co.region_columns(F.col("literal")))


def natural_order(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    from pyspark.sql import Window as W

    c = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("chr"), F.col("s_suppkey") % 23).alias("chrom")).distinct()
    return c.select("chrom", F.row_number().over(W.orderBy(co.natural_order("chrom"))).cast("bigint").alias("turn"))


BOOK.queries["natural_order"] = natural_order
BOOK.sql["natural_order"] = "WITH c AS (SELECT DISTINCT concat('chr', s_suppkey % 23) AS chrom FROM supplier) SELECT chrom, row_number() OVER (ORDER BY CAST(substr(chrom, 4) AS INT)) AS turn FROM c"


@query("strip_haplotypes", "SELECT read_id, regexp_extract(chrom1, '(chr[0-9XY]+)', 1) AS chrom1, regexp_extract(chrom2, '(chr[0-9XY]+)', 1) AS chrom2 FROM pairs", "pairs")
def strip_haplotypes(pairs: DataFrame) -> DataFrame:
    suffixed = pairs.withColumns({"chrom1": F.concat("chrom1", F.lit("(pat)")), "chrom2": F.concat("chrom2", F.lit("b"))})
    return pre.without_haplotypes(suffixed).select("read_id", "chrom1", "chrom2")


@query("human_positions", "SELECT DISTINCT start AS pos, CASE WHEN start >= 1000000 THEN concat(regexp_replace(printf('%.2f', start / 1000000.0e0), '\\.?0+$', ''), 'M') WHEN start >= 1000 THEN concat(regexp_replace(printf('%.2f', start / 1000.0e0), '\\.?0+$', ''), 'k') ELSE CAST(start AS VARCHAR) END AS label FROM genes", "genes")
def human_positions(genes: DataFrame) -> DataFrame:
    return genes.select(F.col("start").alias("pos")).distinct().select("pos", co.human_position("pos").alias("label"))


@query("library_sizes", None, "pairs")
def library_sizes(pairs: DataFrame) -> DataFrame:
    reads = pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("read_pairs"), F.count_distinct("chrom1", "pos1", "chrom2").alias("unique_pairs"))
    return cov.library_sizes(reads)


@query("grid_points", "SELECT x * 0.5e0 - 1 AS x, y * 0.5e0 - 1 AS y, z * 0.5e0 - 1 AS z FROM range(0, 5) a(x), range(0, 5) b(y), range(0, 5) c(z)", "sizes")
def grid_points(sizes: DataFrame) -> DataFrame:
    return sp.grid_points((-1, -1, -1), (1, 1, 1), 0.5, sizes.sparkSession)


@query("within_distance", "SELECT chrom, pos, sqrt(x * x + y * y + z * z) AS distance, sqrt(x * x + y * y + z * z) <= 2 AS is_near FROM tdg", "tdg")
def within_distance(tdg: DataFrame) -> DataFrame:
    return sp.within_distance(tdg, (0, 0, 0), 2.0).select("chrom", "pos", "distance", "is_near")


@query("relative_differences", "SELECT a.chrom, a.pos, sqrt((a.x - b.x) * (a.x - b.x) + (a.feature - b.feature) * (a.feature - b.feature)) AS distance, sqrt((a.x - b.x) * (a.x - b.x) + (a.feature - b.feature) * (a.feature - b.feature)) / (sqrt(b.x * b.x + b.feature * b.feature) + 1e-10) AS relative FROM cells3d a JOIN cells3d b ON a.chrom = b.chrom AND a.pos = b.pos AND a.cell = 'c0' AND b.cell = 'c1'", "cells3d")
def relative_differences(cells: DataFrame) -> DataFrame:
    return sp.relative_differences(cells.where("cell = 'c0'"), cells.where("cell = 'c1'"), ["x", "feature"], ["chrom", "pos"])


@query("chromosome_stats", "SELECT chrom, avg(feature) AS mean, stddev_samp(feature) AS sd, count(feature) AS n FROM tdg GROUP BY chrom", "tdg")
def chromosome_stats(tdg: DataFrame) -> DataFrame:
    return sp.chromosome_stats(tdg, "feature").drop("cell")


@query("feature_histogram", "e AS (SELECT min(feature) AS l, max(feature) AS h FROM tdg) SELECT CAST(least(floor((feature - l) * 3 / (h - l)), 2) AS BIGINT) AS bin, count(*) AS n FROM tdg, e GROUP BY 1", "tdg")
def feature_histogram(tdg: DataFrame) -> DataFrame:
    return sp.histogram(tdg, "feature", 3).select("bin", "n")


@query("nearest_of_top", "t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY feature DESC, chrom, pos) AS r, count(*) OVER () AS n FROM tdg) WHERE r <= floor(n * 0.2e0)), d AS (SELECT a.chrom, a.pos, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM t a JOIN t b ON a.chrom <> b.chrom OR a.pos <> b.pos), k AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY d) AS k FROM d) SELECT chrom, pos, avg(d) AS mean FROM k WHERE k <= 3 GROUP BY ALL", "tdg")
def nearest_of_top(tdg: DataFrame) -> DataFrame:
    return sp.nearest_of_top(tdg, "feature", 0.2, 3, 4.0).drop("cell")


@query("filled_from_track", "SELECT l.cell, l.chrom, l.pos, CASE WHEN l.value >= 500 THEN l.value ELSE t.cpg END AS value FROM loci l LEFT JOIN track t ON t.chrom = l.chrom AND t.pos = l.pos", "loci", "track")
def filled_from_track(loci: DataFrame, track: DataFrame) -> DataFrame:
    return mx.filled_from_track(loci.withColumn("value", F.when(F.col("value") >= 500, F.col("value"))), track)


@query("shifted_bins", "SELECT chrom, start - 10000 AS pos FROM genes", "genes")
def shifted_bins(genes: DataFrame) -> DataFrame:
    return mx.shifted_bins(genes.select(F.concat(F.lit("('"), "chrom", F.lit("', "), "start", F.lit(")")).alias("value")))


@query("springs_within", "SELECT read_id FROM pairs WHERE chrom1 <> chrom2 OR abs(pos1 - pos2) <= 20000", "pairs")
def springs_within(pairs: DataFrame) -> DataFrame:
    return mx.springs_within(pairs, 20_000).select("read_id")


@query("merge_pairs", "SELECT read_id, chrom1, pos1, chrom2, pos2 FROM pairs", "pairs")
def merge_pairs(pairs: DataFrame) -> DataFrame:
    return cov.merge_pairs(pairs.where("cell = 'c0'"), pairs.where("cell <> 'c0'")).select("read_id", "chrom1", "pos1", "chrom2", "pos2")


@query("alleles_both", "SELECT concat(chrom, a) AS chrom, count(*) AS n FROM fragments, (VALUES ('a'), ('b')) t(a) GROUP BY 1", "fragments")
def alleles_both(fragments: DataFrame) -> DataFrame:
    from chromaloom.operators.features import with_alleles

    return with_alleles(fragments, "both").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("alleles_reversed", "SELECT concat(chrom, CASE WHEN allele = '1' THEN 'a' ELSE 'b' END) AS chrom, count(*) AS n FROM fragments WHERE allele <> '.' GROUP BY 1", "fragments")
def alleles_reversed(fragments: DataFrame) -> DataFrame:
    from chromaloom.operators.features import with_alleles

    return with_alleles(fragments, "allelic_resolved_rev").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@query("leg_counts", "SELECT cell, chrom, pos - pos % 50000 AS pos, count(*) AS n FROM (SELECT cell, chrom1 AS chrom, pos1 AS pos FROM pairs UNION ALL SELECT cell, chrom2, pos2 FROM pairs) GROUP BY ALL", "pairs")
def leg_counts(pairs: DataFrame) -> DataFrame:
    return mx.leg_counts(pairs, 50_000)


@query("volcano", None, "loci", "track")
def volcano(loci: DataFrame, track: DataFrame) -> DataFrame:
    groups = loci.select("cell").distinct().withColumn("group", F.when(F.substring("cell", 2, 9).cast("int") < 6, 1).otherwise(2))
    return diff.volcano(diff.find_markers(loci, groups), track)


@query("structure_rmsd", None, "cells3d")
def structure_rmsd(cells: DataFrame) -> DataFrame:
    value = mc.rmsd(cells.where("cell = 'c0'"), cells.where("cell = 'c1'"))
    return cells.sparkSession.createDataFrame([(value,)], "rmsd double")


@query("export_summary", None, "tdg")
def export_summary(tdg: DataFrame) -> DataFrame:
    from chromaloom.sources.writers import summary_json

    return summary_json(tdg)


def _loop(block: int, texts: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {block} AS _block, {i} AS _turn, '{t}' AS value" for i, t in enumerate(texts))


@query("export_cif", f"""e AS (SELECT chrom, row_number() OVER (ORDER BY right(chrom, 1), CAST(regexp_extract(chrom, 'chr([0-9]+)', 1) AS INT), chrom) AS entity FROM (SELECT DISTINCT chrom FROM tdg)),
r AS (SELECT tdg.*, entity, row_number() OVER (PARTITION BY tdg.chrom ORDER BY pos) AS atom, lead(pos) OVER (PARTITION BY tdg.chrom ORDER BY pos) AS ahead FROM tdg JOIN e ON e.chrom = tdg.chrom),
a AS (SELECT 3 AS _block, row_number() OVER (ORDER BY entity, atom) AS _turn, concat_ws(' ', 'ATOM', atom, 'C CA CA', entity, atom, chrom, pos, printf('%.4f', x), printf('%.4f', y), printf('%.4f', z), '50.00') AS value FROM r),
b AS (SELECT 5 AS _block, row_number() OVER (ORDER BY entity, atom) AS _turn, concat_ws(' ', 'covale', chrom, atom, atom + 1) AS value FROM r WHERE ahead IS NOT NULL)
SELECT * FROM ({_loop(0, ['data_proxy', 'loop_', '_entity.id', '_entity.description', '_entity.type'])}) UNION ALL SELECT 1, entity, concat_ws(' ', entity, chrom, 'polymer') FROM e
UNION ALL SELECT * FROM ({_loop(2, ['loop_', *(f'_atom_site.{c}' for c in ('group_PDB', 'id', 'type_symbol', 'label_atom_id', 'label_comp_id', 'label_entity_id', 'label_seq_id', 'label_asym_id', 'pos', 'Cartn_x', 'Cartn_y', 'Cartn_z', 'B_iso_or_equiv'))])})
UNION ALL SELECT * FROM a UNION ALL SELECT * FROM ({_loop(4, ['loop_', *(f'_struct_conn.{c}' for c in ('conn_type_id', 'label_asym_id', 'atom_1', 'atom_2'))])}) UNION ALL SELECT * FROM b""", "tdg")
def export_cif(tdg: DataFrame) -> DataFrame:
    from chromaloom.sources.writers import cif_lines

    return cif_lines(tdg, "proxy", 20_000)


@query("export_pdb", """m AS (SELECT *, dense_rank() OVER (ORDER BY chrom) - 1 AS c, row_number() OVER (ORDER BY chrom, pos) AS s FROM tdg)
SELECT 1 AS _block, s AS _turn, printf('ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C', s % 100000, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', CAST(c % 62 + 1 AS BIGINT), 1), (pos // 20000 + 1) % 10000, x, y, z) AS value FROM m UNION ALL SELECT 2, 0, 'END'""", "tdg")
def export_pdb(tdg: DataFrame) -> DataFrame:
    from chromaloom.sources.writers import pdb_lines

    return pdb_lines(tdg, 20_000)


@query("export_xyz", """SELECT 0 AS _block, 0 AS _turn, CAST(count(*) AS VARCHAR) AS value FROM tdg UNION ALL SELECT 0, 1, 'chromatin structure'
UNION ALL SELECT 1, row_number() OVER (ORDER BY chrom, pos), printf('C %12.6f %12.6f %12.6f', x, y, z) FROM tdg""", "tdg")
def export_xyz(tdg: DataFrame) -> DataFrame:
    from chromaloom.sources.writers import xyz_lines

    return xyz_lines(tdg)
