"""Queries that write the domain's files and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.operators import features as ft
from chromaloom.operators import preprocess as pre
from chromaloom.plans.base import Book
from chromaloom.plans.contacts import BAD_LEGS, CLEAN
from chromaloom.sources import readers as rd
from chromaloom.sources import writers as wr
from chromaloom.sources.shared import shared_dir

BOOK = Book()
query = BOOK.query


def _folder(df: DataFrame, name: str) -> str:
    """A new folder in the shared folder; readers name a sample by the file, so files are asked for by pattern."""
    return f"{shared_dir(df.sparkSession)}/files-{uuid.uuid4().hex}/{name}"


def _lines(df: DataFrame, columns: list[str], path: str) -> str:
    """Tab-separated lines, a part for each task."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
    return path


@query("file_pairs", "SELECT read_id, chrom1, pos1, chrom2, pos2, strand1, strand2, phase0, phase1, phase_prob00, phase_prob11 FROM pairs WHERE cell = 'c0'", "pairs")
def file_pairs(pairs: DataFrame) -> DataFrame:
    path = _folder(pairs, "c0.pairs")
    wr.write_pairs(pairs.where("cell = 'c0'"), path, ["## pairs format v1.0", "#sorted: chr1-chr2-pos1-pos2"])
    return rd.read_pairs(pairs.sparkSession, path).select("read_id", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2", "phase0", "phase1", "phase_prob00", "phase_prob11")


@query("file_header", "SELECT line_no, text FROM (VALUES (0, '## pairs format v1.0'), (1, '#columns: readID chrom1 pos1 chrom2 pos2')) t(line_no, text)", "pairs")
def file_header(pairs: DataFrame) -> DataFrame:
    path = _folder(pairs, "c0.pairs")
    wr.write_pairs(pairs.where("cell = 'c0'").select("read_id", "chrom1", "pos1", "chrom2", "pos2"), path, compress=False)
    return rd.read_header(pairs.sparkSession, path).select("line_no", "text")


@query("file_structure", "SELECT chrom, pos, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM tdg", "tdg")
def file_structure(tdg: DataFrame) -> DataFrame:
    path = _folder(tdg, "c0.3dg")
    wr.write_structure(tdg, path, 1.25)
    return rd.read_structure(tdg.sparkSession, path).select("chrom", "pos", *[F.round(F.col(a).cast("double"), 3).alias(a) for a in "xyz"])


@query("file_structure_middle", "SELECT chrom, pos + 10000 AS pos FROM tdg", "tdg")
def file_structure_middle(tdg: DataFrame) -> DataFrame:
    path = _folder(tdg, "c0.3dg")
    wr.write_structure(tdg, path)
    return rd.read_structure(tdg.sparkSession, path, to_middle=True).select("chrom", "pos")


@query("file_backbone", "SELECT 1.25e0 AS backbone_unit", "tdg")
def file_backbone(tdg: DataFrame) -> DataFrame:
    path = _folder(tdg, "c0.3dg")
    wr.write_structure(tdg, path, 1.25)
    return rd.backbone_units(tdg.sparkSession, path).select("backbone_unit")


@query("file_structure_alias", "SELECT concat('N', chrom) AS chrom, pos FROM tdg", "tdg")
def file_structure_alias(tdg: DataFrame) -> DataFrame:
    path = _folder(tdg, "c0.3dg")
    wr.write_structure(tdg, path)
    alias = tdg.select(F.col("chrom").alias("norm_name"), F.concat(F.lit("N"), "chrom").alias("alias")).distinct()
    return rd.read_structure(tdg.sparkSession, path, alias).select("chrom", "pos")


@query("bin_sizes", "SELECT cell, min(d) AS bin_size FROM (SELECT cell, pos - lag(pos) OVER (PARTITION BY cell, chrom ORDER BY pos) AS d FROM cells3d) WHERE d <> 0 GROUP BY cell", "cells3d")
def bin_sizes(cells: DataFrame) -> DataFrame:
    return rd.bin_sizes(cells)


@query("bins_to_start", "SELECT cell, chrom, pos FROM cells3d", "cells3d")
def bins_to_start(cells: DataFrame) -> DataFrame:
    return rd.shift_to_start(rd.shift_to_middle(cells)).select("cell", "chrom", "pos")


@query("chromosome_codes", "SELECT cell, chrom, pos, dense_rank() OVER (PARTITION BY cell ORDER BY chrom) - 1 AS chrom_code FROM cells3d", "cells3d")
def chromosome_codes(cells: DataFrame) -> DataFrame:
    return rd.chromosome_codes(cells).select("cell", "chrom", "pos", "chrom_code")


@query("file_gtf", "SELECT DISTINCT chrom, start, \"end\", gene FROM genes WHERE strand = '+'", "genes")
def file_gtf(genes: DataFrame) -> DataFrame:
    rows = genes.select("chrom", F.when(F.col("strand") == "+", "HAVANA").otherwise("ENSEMBL").alias("s"), F.lit("exon").alias("f"), "start", "end", F.lit(".").alias("n"), "strand", F.lit(".").alias("m"), F.concat(F.lit('gene_id "'), "id", F.lit('"; gene_name "'), "gene", F.lit('";')).alias("g"))
    gtf = rd.read_gtf(genes.sparkSession, _lines(rows, rows.columns, _folder(genes, "annotation.gtf")))
    named = gtf.withColumn("gene", rd.gtf_attribute("gene_name"))
    return pre.exons_of(named).join(named.select(F.col("seqname").alias("chrom"), "start", "end", "gene"), ["chrom", "start", "end"]).distinct()


@query("file_genes", "SELECT chrom, start, \"end\", id, gene, strand FROM genes", "genes")
def file_genes(genes: DataFrame) -> DataFrame:
    return rd.read_genes(genes.sparkSession, _lines(genes, ["chrom", "start", "end", "id", "gene", "strand"], _folder(genes, "genes.tsv")))


@query("file_sizes", "SELECT chrom, size FROM sizes", "sizes")
def file_sizes(sizes: DataFrame) -> DataFrame:
    return rd.read_sizes(sizes.sparkSession, _lines(sizes, ["chrom", "size"], _folder(sizes, "chrom.sizes")))


@query("file_bed", "SELECT chrom, start, \"end\", allele, strand FROM fragments", "fragments")
def file_bed(fragments: DataFrame) -> DataFrame:
    path = _lines(fragments.withColumn("score", F.lit(0)), ["chrom", "start", "end", "allele", "score", "strand"], _folder(fragments, "c0.bed"))
    return rd.read_bed(fragments.sparkSession, path).select("chrom", "start", "end", "allele", "strand")


@query("three_prime_ends", "SELECT cell, chrom, CASE WHEN strand = '+' THEN \"end\" - 1 ELSE start END AS start, CASE WHEN strand = '+' THEN \"end\" ELSE start + 1 END AS \"end\" FROM fragments", "fragments")
def three_prime_ends(fragments: DataFrame) -> DataFrame:
    return ft.three_prime_ends(fragments).select("cell", "chrom", "start", "end")


@query("file_bedgraph", "SELECT chrom, start, \"end\", value FROM bedgraph", "bedgraph")
def file_bedgraph(track: DataFrame) -> DataFrame:
    return rd.read_bedgraph(track.sparkSession, _lines(track, ["chrom", "start", "end", "value"], _folder(track, "a.bedgraph"))).select("chrom", "start", "end", "value")


@query("file_cpg", "SELECT chrom, start, \"end\", value FROM bedgraph", "bedgraph")
def file_cpg(track: DataFrame) -> DataFrame:
    bare = track.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return rd.read_cpg(track.sparkSession, _lines(bare, ["chrom", "start", "end", "value"], _folder(track, "cpg.tsv"))).select("chrom", "start", "end", "value")


@query("file_timing", "SELECT chrom, start, \"end\", rep_value FROM timing", "timing")
def file_timing(timing: DataFrame) -> DataFrame:
    return rd.read_timing(timing.sparkSession, _lines(timing, ["chrom", "start", "end", "rep_value"], _folder(timing, "rep.tsv")))


@query("file_bands", "SELECT chr1, bin1, chr2, bin2, diag, value FROM bandcounts WHERE cell = 'c0'", "bandcounts")
def file_bands(bands: DataFrame) -> DataFrame:
    some = bands.where("cell = 'c0'")
    return rd.read_bands(bands.sparkSession, _lines(some, ["chr1", "bin1", "chr2", "bin2", "diag", "value"], _folder(bands, "c0.bands"))).drop("cell")


@query("file_counts", "SELECT cell, gene, 'genome1' AS genome, coalesce(sum(umi) FILTER (genome = 'genome1'), 0) AS umi FROM rna GROUP BY cell, gene HAVING count(*) FILTER (genome = 'genome1') > 0", "rna")
def file_counts(rna: DataFrame) -> DataFrame:
    one = rna.where("genome = 'genome1'")
    cells = [r["cell"] for r in one.select("cell").distinct().orderBy("cell").collect()]
    path = _folder(rna, "counts.tsv")
    one.groupBy("gene").pivot("cell", cells).agg(F.sum("umi")).write.option("sep", "\t").option("header", True).csv(path)
    return rd.read_counts(rna.sparkSession, path, "genome1").where("umi IS NOT NULL")


@query("file_pixels", "SELECT cell, chrom, bin1, bin2, value FROM pixels WHERE chrom = 'chr2' AND bin1 >= 200000", "pixels")
def file_pixels(pixels: DataFrame) -> DataFrame:
    path = _folder(pixels, "pixels")
    wr.store(pixels, path)
    return rd.read_pixels(pixels.sparkSession, path).where("chrom = 'chr2' AND bin1 >= 200000").select("cell", "chrom", "bin1", "bin2", "value")


@query("file_split", "SELECT chrom1 AS chrom, count(*) AS n, sum(pos1) AS total FROM pairs GROUP BY 1", "pairs")
def file_split(pairs: DataFrame) -> DataFrame:
    path = _folder(pairs, "split")
    wr.split_by_chromosome(pairs.select("read_id", "chrom1", "pos1"), path)
    back = pairs.sparkSession.read.schema("read_id string, chrom1 string, pos1 bigint, chrom string").option("sep", "\t").csv(path)
    return back.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos1").alias("total"))


@query("file_records", "SELECT cell, count(*) AS n FROM pairs GROUP BY cell", "pairs")
def file_records(pairs: DataFrame) -> DataFrame:
    path = _folder(pairs, "records.json")
    wr.write_records(pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), path)
    return pairs.sparkSession.read.schema("cell string, n bigint").json(path)


@query("cli_clean_leg", f"{BAD_LEGS} SELECT read_id, chrom1, pos1, chrom2, pos2 FROM ({CLEAN}) WHERE cell = 'c0'", "pairs")
def cli_clean_leg(pairs: DataFrame) -> DataFrame:
    """The command line over a written file; the same rows as the operator's."""
    from chromaloom import cli

    spark: SparkSession = pairs.sparkSession
    source, out = _folder(pairs, "c0.pairs"), _folder(pairs, "clean.pairs")
    wr.write_pairs(pairs.where("cell = 'c0'"), source)
    cli.run(cli.parser().parse_args(["clean_leg", source, "-o", out, "-d", "4000", "-n", "15"]), spark)
    return rd.read_pairs(spark, out).select("read_id", "chrom1", "pos1", "chrom2", "pos2")
