"""Readers of the domain's text formats, for one file, many or a pattern.

Every frame has ``cell``: the file's name up to its first dot.  Gzip files are
read by one task each; a cohort's files spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chromaloom.functions.coords import sample_name, with_allele_letter
from chromaloom.sources import schema as sc

Paths = str | list[str]


def table(spark: SparkSession, paths: Paths, schema: StructType, header: bool = False, sep: str = "\t", comment: str | None = "#") -> DataFrame:
    """Separated text under a schema; files with fewer columns leave the last ones null, ``cell`` names the file."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("mode", "PERMISSIVE").option("nullValue", "").option("quote", "\u0000")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(paths).withColumn("cell", sample_name(F.col("_metadata.file_path")))


def read_pairs(spark: SparkSession, paths: Paths) -> DataFrame:
    """Contacts with the first 5 to 13 columns of the format, and _ord, the place of a row within its file."""
    return table(spark, paths, sc.PAIRS).withColumn("_ord", F.monotonically_increasing_id())


def read_header(spark: SparkSession, paths: Paths) -> DataFrame:
    """Comment lines by cell: cell, line_no, text."""
    lines = spark.read.text(paths).withColumn("cell", sample_name(F.col("_metadata.file_path"))).withColumn("_id", F.monotonically_increasing_id()).where(F.col("value").startswith("#"))
    return lines.select("cell", (F.row_number().over(W.partitionBy("cell").orderBy("_id")) - 1).alias("line_no"), F.col("value").alias("text"))


def backbone_units(spark: SparkSession, paths: Paths) -> DataFrame:
    """The number behind the colon of each structure's last comment: cell, backbone_unit."""
    lines = read_header(spark, paths)
    return lines.groupBy("cell").agg(F.max_by("text", "line_no").alias("_t")).select("cell", F.element_at(F.split("_t", ":"), -1).try_cast("double").alias("backbone_unit"))


def read_structure(spark: SparkSession, paths: Paths, alias: DataFrame | None = None, to_middle: bool = False) -> DataFrame:
    """Particles; chromosomes are renamed by ``alias`` (norm_name, alias) or, without it, by allele letter.

    A name that the aliases lack fails the read.  ``to_middle`` moves positions from bin starts to middles.
    """
    rows = table(spark, paths, sc.STRUCTURE)
    if alias is not None:
        named = rows.join(F.broadcast(alias.select(F.col("norm_name").alias("chrom"), "alias")), "chrom", "left")
        rows = named.withColumn("chrom", F.coalesce("alias", F.raise_error(F.concat(F.lit("unknown chromosome "), F.col("chrom"))).cast("string"))).drop("alias")
    else:
        rows = rows.withColumn("chrom", with_allele_letter("chrom"))
    rows = rows.select("cell", "chrom", "pos", "x", "y", "z")
    return shift_to_middle(rows) if to_middle else rows


def bin_sizes(rows: DataFrame) -> DataFrame:
    """The least step between positions of a chromosome, by cell: cell, bin_size; positions are put in order first."""
    step = F.col("pos") - F.lag("pos").over(W.partitionBy("cell", "chrom").orderBy("pos"))
    return rows.withColumn("_step", step).where("_step <> 0").groupBy("cell").agg(F.min("_step").alias("bin_size"))


def shift_to_middle(rows: DataFrame) -> DataFrame:
    return rows.join(bin_sizes(rows), "cell").withColumn("pos", F.col("pos") + F.floor(F.col("bin_size") / 2)).select(*rows.columns)


def shift_to_start(rows: DataFrame) -> DataFrame:
    """Positions from middles to starts of bins; a negative start fails."""
    moved = rows.join(bin_sizes(rows), "cell").withColumn("pos", F.col("pos") - F.floor(F.col("bin_size") / 2))
    checked = F.when(F.col("pos") >= 0, F.col("pos")).otherwise(F.raise_error(F.lit("a position would be negative")).cast("bigint"))
    return moved.withColumn("pos", checked).select(*rows.columns)


def chromosome_codes(rows: DataFrame) -> DataFrame:
    """Rows with chrom_code, the place of the chromosome among the cell's."""
    codes = rows.select("cell", "chrom").distinct().withColumn("chrom_code", (F.dense_rank().over(W.partitionBy("cell").orderBy("chrom")) - 1))
    return rows.join(codes, ["cell", "chrom"])


def read_bed(spark: SparkSession, paths: Paths) -> DataFrame:
    return table(spark, paths, sc.BED)


def read_bedgraph(spark: SparkSession, paths: Paths, allelic: bool = False) -> DataFrame:
    return table(spark, paths, sc.ALLELIC_BEDGRAPH if allelic else sc.BEDGRAPH)


def read_cpg(spark: SparkSession, paths: Paths) -> DataFrame:
    """A CpG track; chromosomes get the prefix chr where it is missing."""
    rows = table(spark, paths, sc.BEDGRAPH)
    return rows.withColumn("chrom", F.when(F.col("chrom").startswith("chr"), F.col("chrom")).otherwise(F.concat(F.lit("chr"), "chrom")))


def read_gtf(spark: SparkSession, paths: Paths) -> DataFrame:
    return table(spark, paths, sc.GTF).drop("cell")


def gtf_attribute(name: str, column: str = "group") -> Column:
    """An attribute out of the last column of a GTF."""
    return F.nullif(F.regexp_extract(column, rf'{name} "([^"]*)"', 1), F.lit(""))


def read_genes(spark: SparkSession, paths: Paths) -> DataFrame:
    return table(spark, paths, sc.GENES).drop("cell")


def read_sizes(spark: SparkSession, paths: Paths, header: bool = False, sep: str = "\t") -> DataFrame:
    return table(spark, paths, sc.SIZES, header, sep).drop("cell")


def read_bands(spark: SparkSession, paths: Paths) -> DataFrame:
    """Counts by band; trans contacts have diagonal -1."""
    return table(spark, paths, sc.BANDS).withColumn("diag", F.col("diag").try_cast("bigint"))


def read_timing(spark: SparkSession, paths: Paths) -> DataFrame:
    return table(spark, paths, sc.TIMING).drop("cell")


def read_distances(spark: SparkSession, paths: Paths) -> DataFrame:
    return table(spark, paths, sc.DISTANCES)


def read_segments(spark: SparkSession, paths: Paths) -> DataFrame:
    """Segment lines as they are, with their cell."""
    return spark.read.text(paths).withColumn("cell", sample_name(F.col("_metadata.file_path")))


def read_counts(spark: SparkSession, paths: Paths, genome: str) -> DataFrame:
    """A wide table of counts (gene, one column a cell) as rows: cell, gene, genome, umi."""
    wide = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(paths)
    cells = [c for c in wide.columns if c != "gene"]
    return wide.unpivot("gene", cells, "cell", "umi").select("cell", "gene", F.lit(genome).alias("genome"), F.col("umi").cast("double").alias("umi"))


def read_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels stored as Parquet by chromosome: a region's filter prunes the rest."""
    return spark.read.parquet(path)


def read_matrix_csr(spark: SparkSession, data: list[float], indices: list[int], indptr: list[int], chrom: str, resolution: int, cell: str = "") -> DataFrame:
    """Pixels of an upper-triangular matrix in compressed rows (as kept in HDF5 files, once read)."""
    rows = [(cell, chrom, i * resolution, indices[k] * resolution, float(data[k])) for i in range(len(indptr) - 1) for k in range(indptr[i], indptr[i + 1])]
    return spark.createDataFrame(rows, "cell string, chrom string, bin1 bigint, bin2 bigint, value double")
