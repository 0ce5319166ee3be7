"""Queries on structures: fetching, attaching features, neighbourhoods, geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.functions.coords import Region
from chromaloom.operators import features as feat
from chromaloom.operators import spatial as sp
from chromaloom.plans.base import Book

BOOK = Book()
query = BOOK.query


@query("region_fetch", "SELECT chrom, pos, x, feature FROM tdg WHERE chrom = 'chr1a' AND pos >= 20000 AND pos < 400000", "tdg")
def region_fetch(tdg: DataFrame) -> DataFrame:
    return feat.fetch(tdg, "chr1a:30,000-390,001", 20_000).select("chrom", "pos", "x", "feature")


@query("subset_fetch", "SELECT chrom, pos FROM tdg WHERE chrom = 'chr1a' AND feature > 3", "tdg")
def subset_fetch(tdg: DataFrame) -> DataFrame:
    return feat.fetch(tdg, "chr1a", query="feature > 3").select("chrom", "pos")


@query("slice_fetch", "SELECT chrom, pos FROM tdg WHERE chrom = 'chr2b' AND pos BETWEEN 100000 AND 300000", "tdg")
def slice_fetch(tdg: DataFrame) -> DataFrame:
    return feat.fetch(tdg, Region("chr2b", 100_000, 300_000), closed=True).select("chrom", "pos")


@query("sphere_fetch", "SELECT chrom, pos FROM tdg WHERE sqrt((x - 0.5e0) * (x - 0.5e0) + (y + 0.25e0) * (y + 0.25e0) + z * z) <= 2", "tdg")
def sphere_fetch(tdg: DataFrame) -> DataFrame:
    return feat.sphere(tdg, (0.5, -0.25, 0.0), 2.0).select("chrom", "pos")


@query("slab_fetch", "SELECT chrom, pos FROM tdg WHERE x > -0.5e0 AND x < 0.5e0", "tdg")
def slab_fetch(tdg: DataFrame) -> DataFrame:
    return feat.slab(tdg, 1.0).select("chrom", "pos")


MERGED = """o AS (SELECT *, max("end") OVER (PARTITION BY cell, chrom, allele, strand ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM fragments),
r AS (SELECT *, sum(CASE WHEN start <= m THEN 0 ELSE 1 END) OVER (PARTITION BY cell, chrom, allele, strand ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM o),
merged AS (SELECT cell, chrom, allele, strand, min(start) AS start, max("end") AS "end" FROM r GROUP BY cell, chrom, allele, strand, g)"""


@query("merge_overlaps", f"{MERGED} SELECT * FROM merged", "fragments")
def merge_overlaps(fragments: DataFrame) -> DataFrame:
    return feat.merge_overlaps(fragments, ["cell", "chrom", "allele", "strand"])


GRID = "p AS (SELECT concat('c', c) AS cell, concat('chr', k, a) AS chrom, CAST(g AS BIGINT) AS pos FROM range(0, 8) t(c), range(1, 6) u(k), (VALUES ('a'), ('b')) v(a), range(0, 400000, 20000) w(g))"


def _grid(spark: SparkSession) -> DataFrame:
    return spark.range(8).selectExpr("concat('c', id) AS cell", "explode(sequence(1, 5)) AS k").selectExpr("cell", "k", "explode(array('a', 'b')) AS a").selectExpr("cell", "concat('chr', k, a) AS chrom", "explode(sequence(0L, 399999L, 20000L)) AS pos")


@query("attach_fragments", f"""{MERGED}, {GRID}, e AS (SELECT cell, concat(chrom, CASE WHEN allele = '0' THEN 'a' ELSE 'b' END) AS chrom, CASE WHEN strand = '+' THEN "end" - 1 ELSE start END AS s FROM merged WHERE allele <> '.'),
n AS (SELECT cell, chrom, s - s % 20000 AS pos, count(*) AS n FROM e GROUP BY ALL) SELECT cell, chrom, pos, CAST(coalesce(n, 0) AS DOUBLE) AS atac FROM p LEFT JOIN n USING (cell, chrom, pos)""", "fragments")
def attach_fragments(fragments: DataFrame) -> DataFrame:
    return feat.attach_fragments(_grid(fragments.sparkSession), fragments, "atac", 20_000)


@query("attach_bedgraph", "SELECT chrom, pos, coalesce(sum(value), 0) AS cpg FROM (SELECT DISTINCT chrom, pos FROM tdg) t LEFT JOIN bedgraph b USING (chrom) WHERE b.chrom IS NULL OR (b.start < pos + 20000 AND pos < b.\"end\") GROUP BY ALL UNION ALL SELECT chrom, pos, 0.0e0 FROM (SELECT DISTINCT chrom, pos FROM tdg) t WHERE EXISTS (SELECT 1 FROM bedgraph b WHERE b.chrom = t.chrom) AND NOT EXISTS (SELECT 1 FROM bedgraph b WHERE b.chrom = t.chrom AND b.start < pos + 20000 AND pos < b.\"end\")", "tdg", "bedgraph")
def attach_bedgraph(tdg: DataFrame, track: DataFrame) -> DataFrame:
    return feat.attach_bedgraph(tdg, track, "cpg", 20_000).select("chrom", "pos", "cpg")


@query("frip", 'h AS (SELECT f.cell, count(*) AS n FROM fragments f JOIN regions r ON r.chrom = f.chrom AND f.start < r."end" + 500 AND greatest(r.start - 500, 0) < f."end" GROUP BY 1), t AS (SELECT cell, count(*) AS m FROM fragments GROUP BY 1) SELECT t.cell, m AS n_fragments, coalesce(n, 0) AS n_hits, coalesce(n, 0) * 1.0e0 / m AS frip FROM t LEFT JOIN h ON h.cell = t.cell', "fragments", "regions")
def frip(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    return feat.frip(fragments, regions, 500)


RNA_GRID = GRID.replace("range(0, 8)", "range(0, 12)")


def _rna_grid(spark: SparkSession) -> DataFrame:
    return spark.range(12).selectExpr("concat('c', id) AS cell", "explode(sequence(1, 5)) AS k").selectExpr("cell", "k", "explode(array('a', 'b')) AS a").selectExpr("cell", "concat('chr', k, a) AS chrom", "explode(sequence(0L, 399999L, 20000L)) AS pos")


@query("attach_rna_tss", f"""{RNA_GRID}, t AS (SELECT cell, concat(chrom, CASE WHEN genome = 'genome1' THEN 'b' ELSE 'a' END) AS chrom, CASE WHEN strand = '+' THEN start ELSE "end" END AS s, umi FROM rna JOIN genes USING (gene)),
n AS (SELECT cell, chrom, s - s % 20000 AS pos, sum(umi) AS u FROM t GROUP BY ALL) SELECT cell, chrom, pos, coalesce(u, 0) AS umi FROM p LEFT JOIN n USING (cell, chrom, pos)""", "rna", "genes")
def attach_rna_tss(rna: DataFrame, genes: DataFrame) -> DataFrame:
    return feat.attach_rna(_rna_grid(rna.sparkSession), rna, genes, "umi", 20_000)


@query("attach_rna_gene", f"""{RNA_GRID}, n AS (SELECT cell, concat(chrom, CASE WHEN genome = 'genome1' THEN 'b' ELSE 'a' END) AS chrom, start AS pos, sum(umi) AS u FROM rna JOIN genes USING (gene) WHERE umi > 0 GROUP BY ALL)
SELECT cell, chrom, pos, coalesce(u, 0) AS umi FROM p LEFT JOIN n USING (cell, chrom, pos)""", "rna", "genes")
def attach_rna_gene(rna: DataFrame, genes: DataFrame) -> DataFrame:
    return feat.attach_rna(_rna_grid(rna.sparkSession), rna, genes, "umi", 20_000, at="gene")


@query("bins_genetable", """b AS (SELECT chrom, size, CAST(unnest(range(0, size, 100000)) AS BIGINT) AS start FROM sizes)
SELECT b.chrom, b.start, least(b.start + 100000, size) AS "end", count(g.id) AS n_genes, coalesce(string_agg(g.id, ';' ORDER BY g.id), '') AS gene_ids FROM b LEFT JOIN genes g ON g.chrom = b.chrom AND g.start < least(b.start + 100000, size) AND g."end" > b.start GROUP BY b.chrom, b.start, size""", "genes", "sizes")
def bins_genetable(genes: DataFrame, sizes: DataFrame) -> DataFrame:
    return feat.bins_of_genes(genes, sizes, 100_000)


PAIR_GENES = "c AS (SELECT cell, gene, count(*) AS count FROM pairs p JOIN genes g ON g.chrom = p.chrom1 AND p.pos1 >= g.start AND p.pos2 <= g.\"end\" WHERE chrom1 = chrom2 AND pos2 > pos1 GROUP BY ALL)"


@query("pairs_in_gene", f"{PAIR_GENES} SELECT * FROM c", "pairs", "genes")
def pairs_in_gene(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    return feat.genes_of_pairs(pairs, genes)


@query("scgad", f"""{PAIR_GENES}, f AS (SELECT a.cell, b.gene, coalesce(c.count, 0) AS n FROM (SELECT DISTINCT cell FROM c) a CROSS JOIN (SELECT DISTINCT gene FROM c) b LEFT JOIN c ON c.cell = a.cell AND c.gene = b.gene),
s AS (SELECT *, n * 1.0e0 / sum(n) OVER (PARTITION BY cell) AS r FROM f), d AS (SELECT *, (r - avg(r) OVER (PARTITION BY gene)) * (r - avg(r) OVER (PARTITION BY gene)) AS d FROM s)
SELECT cell, gene, sqrt(d / sum(d) OVER (PARTITION BY cell) * (SELECT count(DISTINCT cell) FROM c)) AS score FROM d""", "pairs", "genes")
def scgad(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    return feat.scgad(feat.genes_of_pairs(pairs, genes))


@query("pairs_3d_distance", """l AS (SELECT read_id, concat(chrom1, CASE phase0 WHEN '0' THEN 'a' ELSE 'b' END) AS c1, pos1 - pos1 % 20000 AS p1, concat(chrom2, CASE phase1 WHEN '0' THEN 'a' ELSE 'b' END) AS c2, pos2 - pos2 % 20000 AS p2 FROM pairs WHERE phase0 <> '.' AND phase1 <> '.')
SELECT read_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance FROM l JOIN tdg a ON a.chrom = c1 AND a.pos = p1 JOIN tdg b ON b.chrom = c2 AND b.pos = p2""", "pairs", "tdg")
def pairs_3d_distance(pairs: DataFrame, tdg: DataFrame) -> DataFrame:
    return feat.pair_distances(pairs, tdg.drop("cell"), 20_000, keys=[]).select("read_id", "distance")


D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query("pairs_3d", f"SELECT a.chrom AS chrom1, a.pos AS pos1, b.chrom AS chrom2, b.pos AS pos2, sqrt({D2}) AS distance FROM tdg a JOIN tdg b ON (a.chrom < b.chrom OR (a.chrom = b.chrom AND a.pos < b.pos)) AND {D2} <= 4", "tdg")
def pairs_3d(tdg: DataFrame) -> DataFrame:
    return sp.proximity_pairs(tdg, 2.0).drop("cell")


@query("tdg2pairs", f"SELECT DISTINCT regexp_replace(a.chrom, '[ab]$', '') AS chrom1, a.pos AS pos1, regexp_replace(b.chrom, '[ab]$', '') AS chrom2, b.pos AS pos2, CASE WHEN a.chrom LIKE '%a' THEN '0' ELSE '1' END AS phase0, CASE WHEN b.chrom LIKE '%a' THEN '0' ELSE '1' END AS phase1, CASE WHEN a.chrom LIKE '%a' AND b.chrom LIKE '%a' THEN 1.0e0 ELSE 0 END AS phase_prob00 FROM tdg a JOIN tdg b ON (a.chrom < b.chrom OR (a.chrom = b.chrom AND a.pos < b.pos)) AND {D2} <= 2.25", "tdg")
def tdg2pairs(tdg: DataFrame) -> DataFrame:
    return sp.structure_to_pairs(tdg, 1.5).select("chrom1", "pos1", "chrom2", "pos2", "phase0", "phase1", "phase_prob00")


def _radius(aggregation: str, sql: str) -> None:
    inner = f"SELECT a.chrom, a.pos, {sql} AS v FROM tdg a LEFT JOIN tdg b ON (a.chrom <> b.chrom OR a.pos <> b.pos) AND {D2} <= 2.25 GROUP BY a.chrom, a.pos"

    @query(f"radius_{aggregation}", f"SELECT chrom, pos, CAST(v AS DOUBLE) AS value FROM ({inner})", "tdg")
    def run(tdg: DataFrame) -> DataFrame:
        return sp.feature_in_radius(tdg, "feature", 1.5, aggregation, name="value").select("chrom", "pos", "value")


for _name, _sql in (("sum", "coalesce(sum(b.feature), 0)"), ("mean", "avg(b.feature)"), ("max", "max(b.feature)"), ("min", "min(b.feature)"), ("count", "count(b.feature)")):
    _radius(_name, _sql)


@query("radius_rank", f"m AS (SELECT a.chrom, a.pos, avg(b.feature) AS v FROM tdg a JOIN tdg b ON {D2} <= 2.25 GROUP BY a.chrom, a.pos) SELECT chrom, pos, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0e0) / (count(*) OVER ()) AS value FROM m", "tdg")
def radius_rank(tdg: DataFrame) -> DataFrame:
    return sp.feature_in_radius(tdg, "feature", 1.5, "mean", True, True, name="value").select("chrom", "pos", "value")


@query("density", f"SELECT a.chrom, a.pos, count(*) AS n_near, count(*) / {4 / 3 * math.pi * 1.5**3!r}e0 AS density FROM tdg a JOIN tdg b ON {D2} <= 2.25 GROUP BY a.chrom, a.pos", "tdg")
def density(tdg: DataFrame) -> DataFrame:
    return sp.density(tdg, 1.5).drop("cell")


@query("knn_density", f"n AS (SELECT a.chrom, a.pos, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.chrom, a.pos ORDER BY {D2}, b.chrom, b.pos) AS r FROM tdg a JOIN tdg b ON a.chrom <> b.chrom OR a.pos <> b.pos) SELECT chrom, pos, 1 / (avg(d) + 1e-10) AS knn_density FROM n WHERE r <= 5 GROUP BY ALL", "tdg")
def knn_density(tdg: DataFrame) -> DataFrame:
    return sp.knn_density(tdg, 5, 2.0).drop("cell")


@query("intermingling", f"SELECT 'c0' AS cell, (SELECT count(*) FROM tdg a JOIN tdg b ON a.chrom = 'chr1a' AND b.chrom = 'chr2b' AND {D2} <= 4) * 1.0e0 / ((SELECT count(*) FROM tdg WHERE chrom = 'chr1a') * (SELECT count(*) FROM tdg WHERE chrom = 'chr2b')) AS intermingling", "tdg")
def intermingling(tdg: DataFrame) -> DataFrame:
    return sp.intermingling(tdg, "chr1a", "chr2b", 2.0)


@query("ripley_k", f"c AS (SELECT count(*) AS n FROM tdg a JOIN tdg b ON (a.chrom < b.chrom OR (a.chrom = b.chrom AND a.pos < b.pos)) AND {D2} <= 4), k AS (SELECT (SELECT count(*) FROM tdg) AS m, 1000 * 2.0e0 * n / ((SELECT count(*) FROM tdg) * ((SELECT count(*) FROM tdg) - 1)) AS k FROM c) SELECT 'c0' AS cell, m AS n, k, cbrt(k / {4 / 3 * math.pi!r}e0) AS l, cbrt(k / {4 / 3 * math.pi!r}e0) - 2 AS h FROM k", "tdg")
def ripley_k(tdg: DataFrame) -> DataFrame:
    return sp.ripley(tdg, 2.0, 1000.0)


@query("shell_counts", f"""p AS (SELECT greatest(CAST(ceil(sqrt({D2}) / 0.5e0) AS BIGINT) - 1, 0) AS s FROM tdg a JOIN tdg b ON {D2} <= 9), c AS (SELECT s, count(*) AS n FROM p GROUP BY s),
g AS (SELECT CAST(unnest(range(0, 6)) AS BIGINT) AS s) SELECT g.s AS shell, (g.s + 0.5e0) * 0.5e0 AS r, coalesce(n, 0) AS count, coalesce(n, 0) * 500.0e0 / ((SELECT count(*) FROM tdg) * (SELECT count(*) FROM tdg) * (4 * {math.pi!r}e0 * (g.s + 0.5e0) * 0.5e0 * (g.s + 0.5e0) * 0.5e0 * 0.5e0 + {math.pi / 3 * 0.125!r}e0)) AS g FROM g LEFT JOIN c ON c.s = g.s""", "tdg")
def shell_counts(tdg: DataFrame) -> DataFrame:
    return sp.shell_correlation(tdg, 0.5, 3.0, 500.0).drop("cell")


CENTER = "ctr AS (SELECT cell, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM tdg GROUP BY cell), rad AS (SELECT t.*, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS radial FROM tdg t JOIN ctr USING (cell))"


@query("radial_position", f"{CENTER} SELECT chrom, pos, radial FROM rad", "tdg")
def radial_position(tdg: DataFrame) -> DataFrame:
    return sp.radial_position(tdg).select("chrom", "pos", "radial")


@query("radial_scaled", f"{CENTER} SELECT chrom, pos, radial / max(radial) OVER () AS radial FROM rad", "tdg")
def radial_scaled(tdg: DataFrame) -> DataFrame:
    return sp.radial_position(tdg, "max").select("chrom", "pos", "radial")


@query("radial_rank", f"{CENTER} SELECT chrom, pos, row_number() OVER (ORDER BY radial, chrom, pos) * 1.0e0 / count(*) OVER () AS radial FROM rad", "tdg")
def radial_rank(tdg: DataFrame) -> DataFrame:
    return sp.radial_position(tdg, "rank").select("chrom", "pos", "radial")


@query("radial_distribution", f"{CENTER}, s AS (SELECT max(radial) / 10 AS step, max(radial) AS m FROM rad), b AS (SELECT CAST(floor(radial / step) AS BIGINT) AS bin, avg(feature) AS v FROM rad, s WHERE radial < m GROUP BY 1), g AS (SELECT CAST(unnest(range(0, 10)) AS BIGINT) AS bin) SELECT bin, coalesce(v, 0) AS mean FROM g LEFT JOIN b USING (bin)", "tdg")
def radial_distribution(tdg: DataFrame) -> DataFrame:
    return sp.radial_distribution(tdg, "feature").drop("cell")


@query("weighted_radial", f"{CENTER} SELECT cell, sum(radial * feature) / sum(feature) AS weighted_radial FROM rad GROUP BY cell", "tdg")
def weighted_radial(tdg: DataFrame) -> DataFrame:
    return sp.weighted_radial(tdg, "feature")


@query("gyration", "SELECT cell, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM tdg GROUP BY cell", "tdg")
def gyration(tdg: DataFrame) -> DataFrame:
    return sp.gyration(tdg, ["cell"])


@query("gyration_by_chrom", "SELECT cell, chrom, count(*) AS n, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM tdg GROUP BY ALL", "tdg")
def gyration_by_chrom(tdg: DataFrame) -> DataFrame:
    return sp.gyration(tdg, ["cell", "chrom"])


@query("territories", "SELECT cell, chrom, avg(x) AS center_x, avg(y) AS center_y, avg(z) AS center_z, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg, count(*) AS n FROM tdg GROUP BY ALL", "tdg")
def territories(tdg: DataFrame) -> DataFrame:
    return sp.territories(tdg)


@query("top_territories", "SELECT chrom, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg FROM tdg GROUP BY ALL ORDER BY rg DESC, chrom LIMIT 4", "tdg")
def top_territories(tdg: DataFrame) -> DataFrame:
    return sp.gyration(tdg, ["cell", "chrom"]).orderBy(F.desc("rg"), "chrom").limit(4).select("chrom", "rg")


@query("structural_metrics", "SELECT cell, count(*) AS n, avg(x) AS center_x, max(y) - min(y) AS range_y, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS box_volume, count(*) / ((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z))) AS box_density FROM tdg GROUP BY cell", "tdg")
def structural_metrics(tdg: DataFrame) -> DataFrame:
    return sp.structural_metrics(tdg).select("cell", "n", "center_x", "range_y", "rg", "box_volume", "box_density")


@query("expand", "SELECT chrom, pos, avg(x) OVER () + (x - avg(x) OVER ()) * 1.5e0 AS x, avg(y) OVER () + (y - avg(y) OVER ()) * 1.5e0 AS y, avg(z) OVER () + (z - avg(z) OVER ()) * 1.5e0 AS z FROM tdg", "tdg")
def expand(tdg: DataFrame) -> DataFrame:
    return sp.expand(tdg, 1.5).select("chrom", "pos", "x", "y", "z")


@query("expand_chromosomes", "SELECT chrom, pos, x + (avg(x) OVER (PARTITION BY chrom) - avg(x) OVER ()) * 0.5e0 AS x FROM tdg", "tdg")
def expand_chromosomes(tdg: DataFrame) -> DataFrame:
    return sp.expand_chromosomes(tdg, 1.5).select("chrom", "pos", "x")


_NORMAL = {
    "center": "x - avg(x) OVER () AS x, z - avg(z) OVER () AS z",
    "standardize": "(x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-10) AS x, (z - avg(z) OVER ()) / (stddev_pop(z) OVER () + 1e-10) AS z",
    "minmax": "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (z - min(z) OVER ()) / (max(z) OVER () - min(z) OVER ()) AS z",
}


def _normalize(method: str) -> None:
    @query(f"normalize_{method}", f"SELECT chrom, pos, {_NORMAL[method]} FROM tdg", "tdg")
    def run(tdg: DataFrame) -> DataFrame:
        return sp.normalize(tdg, method).select("chrom", "pos", "x", "z")


for _name in _NORMAL:
    _normalize(_name)


@query("normalize_unit_sphere", f"{CENTER} SELECT chrom, pos, (x - cx) / max(radial) OVER () AS x FROM rad JOIN ctr USING (cell)", "tdg")
def normalize_unit_sphere(tdg: DataFrame) -> DataFrame:
    return sp.normalize(tdg, "unit_sphere").select("chrom", "pos", "x")


@query("outliers_iqr", "q AS (SELECT " + ", ".join(f"quantile_cont({a}, 0.25) AS l{a}, quantile_cont({a}, 0.75) AS h{a}" for a in "xyz") + " FROM tdg) SELECT chrom, pos, " + " OR ".join(f"{a} < l{a} - (h{a} - l{a}) * 1.5e0 OR {a} > h{a} + (h{a} - l{a}) * 1.5e0" for a in "xyz") + " AS is_outlier FROM tdg, q", "tdg")
def outliers_iqr(tdg: DataFrame) -> DataFrame:
    return sp.outliers(tdg).select("chrom", "pos", "is_outlier")


@query("outliers_zscore", "SELECT chrom, pos, " + " OR ".join(f"abs(({a} - avg({a}) OVER ()) / stddev_pop({a}) OVER ()) > 2" for a in "xyz") + " AS is_outlier FROM tdg", "tdg")
def outliers_zscore(tdg: DataFrame) -> DataFrame:
    return sp.outliers(tdg, "zscore", 2.0).select("chrom", "pos", "is_outlier")


@query("outliers_distance", f"{CENTER} SELECT chrom, pos, radial > avg(radial) OVER () + 2 * stddev_pop(radial) OVER () AS is_outlier FROM rad", "tdg")
def outliers_distance(tdg: DataFrame) -> DataFrame:
    return sp.outliers(tdg, "distance", 2.0).select("chrom", "pos", "is_outlier")


@query("rotate_z90", "SELECT chrom, pos, -y AS x, x AS y, z FROM tdg", "tdg")
def rotate_z90(tdg: DataFrame) -> DataFrame:
    return sp.rotate(tdg, (0, 0, 90)).select("chrom", "pos", "x", "y", "z")


def _pairwise(metric: str, sql: str) -> None:
    @query(f"pairwise_{metric}", f"SELECT a.chrom, a.pos, b.chrom AS r_chrom, b.pos AS r_pos, {sql} AS distance FROM tdg a, tdg b WHERE a.chrom = 'chr1a' AND b.chrom = 'chr2a'", "tdg")
    def run(tdg: DataFrame) -> DataFrame:
        return sp.pairwise_distances(tdg.where("chrom = 'chr1a'"), tdg.where("chrom = 'chr2a'"), metric).drop("cell")


for _name, _sql in (("euclidean", f"sqrt({D2})"), ("manhattan", "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)"), ("chebyshev", "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z))")):
    _pairwise(_name, _sql)


def _pairwise_all(metric: str) -> None:
    @query(f"pairwise_all_{metric}", None, "tdg")
    def run(tdg: DataFrame) -> DataFrame:
        return sp.pairwise_distances(tdg, tdg, metric).drop("cell")


for _name in ("euclidean", "manhattan", "chebyshev"):
    _pairwise_all(_name)


@query("feature_distances", f"{CENTER} SELECT chrom, pos, radial AS distance FROM rad WHERE feature > 0", "tdg")
def feature_distances(tdg: DataFrame) -> DataFrame:
    return sp.feature_distances(tdg, "feature").drop("cell")


@query("abc_scores", f"g AS (SELECT concat(chrom, '_', pos) AS gene, x, y, z FROM tdg WHERE pos % 100000 = 0) SELECT a.gene, coalesce(sum(b.feature / (sqrt({D2}) + 1e-10)), 0) AS abc FROM g a LEFT JOIN tdg b ON {D2} <= 2.25 AND b.pos % 100000 <> 0 GROUP BY a.gene", "tdg")
def abc_scores(tdg: DataFrame) -> DataFrame:
    genes = tdg.where("pos % 100000 = 0").selectExpr("cell", "concat(chrom, '_', pos) AS gene", "x", "y", "z")
    return sp.abc_scores(tdg.where("pos % 100000 <> 0"), genes, "feature", 1.5).drop("cell")


@query("locus_distance", f"SELECT a.cell, sqrt({D2}) AS distance FROM cells3d a JOIN cells3d b ON a.cell = b.cell AND a.chrom = 'chr1' AND a.pos = 40000 AND b.chrom = 'chr2' AND b.pos = 60000", "cells3d")
def locus_distance(cells: DataFrame) -> DataFrame:
    return sp.locus_distance(cells, ("chr1", 40_000), ("chr2", 60_000))


@query("nearest_value", f"q AS (SELECT chrom AS point, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tdg GROUP BY chrom), r AS (SELECT a.point, b.feature, row_number() OVER (PARTITION BY a.point ORDER BY {D2}, b.chrom, b.pos) AS k FROM q a, tdg b) SELECT point, feature FROM r WHERE k = 1", "tdg")
def nearest_value(tdg: DataFrame) -> DataFrame:
    points = tdg.groupBy("cell", F.col("chrom").alias("point")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return sp.nearest_value(tdg, points, "feature").drop("cell")


@query("top_share", "SELECT chrom, pos FROM (SELECT *, row_number() OVER (ORDER BY feature DESC, chrom, pos) AS r, count(*) OVER () AS n FROM tdg) WHERE r <= floor(n * 0.1e0)", "tdg")
def top_share(tdg: DataFrame) -> DataFrame:
    return sp.top_share(tdg, "feature", 0.1).select("chrom", "pos")


@query("sample_rows", None, "tdg")
def sample_rows(tdg: DataFrame) -> DataFrame:
    return sp.sample(tdg, 50, ["chrom", "pos"], 1).select("chrom", "pos")


@query("compartments_by_median", "SELECT chrom, pos, CASE WHEN feature > (SELECT median(feature) FROM tdg) THEN 'A' ELSE 'B' END AS compartment FROM tdg", "tdg")
def compartments_by_median(tdg: DataFrame) -> DataFrame:
    return sp.compartments_by_median(tdg, "feature").select("chrom", "pos", "compartment")


@query("structure_summary", "SELECT cell, count(*) AS n, count(DISTINCT chrom) AS n_chrom, min(x) AS min_x, max(z) AS max_z, avg(y) AS mean_y FROM tdg GROUP BY cell", "tdg")
def structure_summary(tdg: DataFrame) -> DataFrame:
    return sp.summary(tdg).select("cell", "n", "n_chrom", "min_x", "max_z", "mean_y")


@query("structure_validate", "SELECT cell, count(*) AS n, CAST(0 AS BIGINT) AS n_bad, count(*) - count(DISTINCT (chrom, pos)) AS n_repeated FROM tdg GROUP BY cell", "tdg")
def structure_validate(tdg: DataFrame) -> DataFrame:
    return sp.validate(tdg)

