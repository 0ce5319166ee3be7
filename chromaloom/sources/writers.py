"""Writers of the domain's text formats.

Lines are made by expressions and written by Spark's text sink, one folder a
call with a part for each task; headers, where a format needs one, go into the
same sink in front (a single-file export is for one cell and is ordered).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chromaloom.functions.coords import karyotype_order
from chromaloom.sources import schema as sc


def one_cell(df: DataFrame) -> DataFrame:
    """``df``, or an error if it holds several cells: a single ordered file is for one."""
    if "cell" in df.columns and len(names := df.select("cell").distinct().limit(2).collect()) > 1:
        raise ValueError(f"a single file is for one cell, not for {names[0]['cell']} and {names[1]['cell']}; write them apart or with store()")
    return df


def _text(lines: DataFrame, path: str, compress: bool = False) -> None:
    """``lines``: _block, _turn, value; written in that order as a single part."""
    ordered = lines.orderBy("_block", "_turn").select("value").coalesce(1)
    ordered.write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def _header(df: DataFrame, texts: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "_block int, _turn bigint, value string")


def _numbered(df: DataFrame, value: Column, order: list, block: int = 1) -> DataFrame:
    """Lines with their place; a range-partitioned sort precedes, so numbering is within parts only where it must be global."""
    return df.select(F.lit(block).alias("_block"), F.row_number().over(W.orderBy(*order)).cast("bigint").alias("_turn"), value.alias("value"))


def write_pairs(pairs: DataFrame, path: str, comments: list[str] | None = None, single: bool = True, compress: bool = True) -> None:
    """Tab-separated contacts under the comments, the last of which names the columns.

    ``single`` writes one ordered part; otherwise parts without header, as the frame is partitioned.
    """
    columns = [c for c in sc.PAIRS.fieldNames() if c in pairs.columns]
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns])
    if not single:
        pairs.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)
        return
    one_cell(pairs)
    names = ["readID" if c == "read_id" else c for c in columns]
    texts = [*(comments or ["## pairs format v1.0"])]
    texts = (texts[:-1] if texts[-1].startswith("#columns") else texts) + ["#columns: " + " ".join(names)]
    order = [c for c in ("chrom1", "chrom2", "pos1", "pos2", "read_id") if c in columns]
    _text(_header(pairs, texts).unionByName(_numbered(pairs, line, order)), path, compress)


def write_structure(particles: DataFrame, path: str, backbone_unit: float | None = None) -> None:
    """Tab-separated particles in order, under the backbone comment if one is given."""
    line = F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("pos", "x", "y", "z")])
    texts = [] if backbone_unit is None else [f"# backbone_unit: {backbone_unit}"]
    rows = _numbered(particles, line, ["chrom", "pos"])
    _text(_header(particles, texts).unionByName(rows) if texts else rows, path)


def write_columns(df: DataFrame, path: str, order: list[str]) -> None:
    """Comma-separated values with a header, in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def xyz_lines(particles: DataFrame) -> DataFrame:
    """An XYZ file: the number of particles, a comment, a line for each."""
    n = particles.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("_block"), F.lit(0).cast("bigint").alias("_turn"), F.col("n").cast("string").alias("value"))
    note = _header(particles, ["", "chromatin structure"]).where("_turn = 1")
    line = F.format_string("C %12.6f %12.6f %12.6f", *[F.col(a).cast("double") for a in "xyz"])
    return n.unionByName(note).unionByName(_numbered(particles, line, ["chrom", "pos"]))


def write_xyz(particles: DataFrame, path: str) -> None:
    one_cell(particles)
    _text(xyz_lines(particles), path)


def pdb_lines(particles: DataFrame, resolution: int) -> DataFrame:
    """ATOM records with a chain letter for each chromosome and the bin number as residue; END at the end."""
    place = F.dense_rank().over(W.orderBy("chrom")) - 1
    marked = particles.withColumn("_chain", F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), F.pmod(place, F.lit(62)) + 1, F.lit(1))).withColumn("_serial", F.row_number().over(W.orderBy("chrom", "pos")))
    line = F.format_string("ATOM  %5d  CA  ALA %s%4d    %8.3f%8.3f%8.3f  1.00  0.00           C", F.pmod("_serial", F.lit(100000)), F.col("_chain"), F.pmod(F.floor(F.col("pos") / resolution) + 1, F.lit(10000)), *[F.col(a).cast("double") for a in "xyz"])
    return _numbered(marked, line, ["chrom", "pos"]).unionByName(_header(particles, ["END"]).withColumn("_block", F.lit(2)))


def write_pdb(particles: DataFrame, path: str, resolution: int) -> None:
    one_cell(particles)
    _text(pdb_lines(particles, resolution), path)


def cif_lines(particles: DataFrame, name: str, resolution: int, factor: str | None = None, gap: int | None = None) -> DataFrame:
    """An mmCIF file: entities (chromosomes in karyotype order), atoms with a running number in each, bonds between neighbours.

    ``factor`` names a column for the temperature factor (50 by default); bonds
    join particles up to ``gap`` base pairs apart (any neighbours by default).
    """
    chroms = particles.select("chrom").distinct().withColumn("_entity", F.row_number().over(W.orderBy(karyotype_order("chrom"))))
    rows = particles.join(F.broadcast(chroms), "chrom")
    own = W.partitionBy("chrom").orderBy("pos")
    rows = rows.withColumn("_atom", F.row_number().over(own)).withColumn("_next", F.lead("pos").over(own))
    block = lambda texts, b: _header(particles, texts).withColumn("_block", F.lit(b))
    entity = F.concat_ws(" ", "_entity", "chrom", F.lit("polymer"))
    entities = chroms.select(F.lit(1).alias("_block"), F.col("_entity").cast("bigint").alias("_turn"), entity.alias("value"))
    b = F.format_string("%.2f", F.col(factor).cast("double") if factor else F.lit(50.0))
    atom = F.concat_ws(" ", F.lit("ATOM"), F.col("_atom"), F.lit("C CA CA"), F.col("_entity"), F.col("_atom"), "chrom", "pos", *[F.format_string("%.4f", F.col(a).cast("double")) for a in "xyz"], b)
    linked = rows.where(F.col("_next").isNotNull() if gap is None else F.col("_next") - F.col("pos") <= gap)
    bond = F.concat_ws(" ", F.lit("covale"), "chrom", "_atom", F.col("_atom") + 1)
    order = ["_entity", "_atom"]
    return (
        block([f"data_{name}", "loop_", "_entity.id", "_entity.description", "_entity.type"], 0)
        .unionByName(entities)
        .unionByName(block(["loop_", *(f"_atom_site.{c}" for c in ("group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "label_entity_id", "label_seq_id", "label_asym_id", "pos", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv"))], 2))
        .unionByName(_numbered(rows, atom, order, 3))
        .unionByName(block(["loop_", *(f"_struct_conn.{c}" for c in ("conn_type_id", "label_asym_id", "atom_1", "atom_2"))], 4))
        .unionByName(_numbered(linked, bond, order, 5))
    )


def write_cif(particles: DataFrame, path: str, name: str, resolution: int, factor: str | None = None, gap: int | None = None) -> None:
    one_cell(particles)
    _text(cif_lines(particles, name, resolution, factor, gap), path)


def summary_json(particles: DataFrame) -> DataFrame:
    """One JSON text for each cell: particles, chromosomes and ranges."""
    ranges = [F.struct(F.min(a).alias("min"), F.max(a).alias("max")).alias(a) for a in "xyz"]
    s = particles.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("chrom")).alias("chromosomes"), F.struct(*ranges).alias("ranges"))
    return s.select("cell", F.to_json(F.struct("n", "chromosomes", "ranges")).alias("summary"))


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a line."""
    records.write.mode("overwrite").json(path)


def store(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet by cell and chromosome, sorted by position, so that a region's filter prunes files and row groups."""
    by = [c for c in ("cell", "chrom") if c in df.columns] if by is None else by
    place = next((c for c in ("pos", "start", "bin1", "pos1") if c in df.columns), None)
    # a salt keeps one large chromosome from being one task's
    spread = df.repartition(*by, *([F.floor(F.col(place) / 50_000_000)] if place else []))
    (spread.sortWithinPartitions(*by, place) if place else spread).write.mode("overwrite").partitionBy(*by).parquet(path)


def split_by_chromosome(pairs: DataFrame, path: str) -> None:
    """One folder for each first chromosome."""
    pairs.withColumn("chrom", F.col("chrom1")).write.mode("overwrite").partitionBy("chrom").option("sep", "\t").csv(path)


def store_structures(particles: DataFrame, path: str) -> None:
    """One file for each cell, path/<cell>/<cell>.3dg, written where its rows are: a cell's particles fit a task."""
    spark = particles.sparkSession
    line = F.concat_ws("\t", "chrom", *[F.col(c).cast("string") for c in ("pos", "x", "y", "z")])
    rows = particles.repartition("cell").sortWithinPartitions("cell", "chrom", "pos").select(F.col("cell").alias("_cell"), line.alias("value"))
    rows.write.partitionBy("_cell").text(path)
    # the sink names parts by task; the format's readers name a sample by its file
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    base = jvm.org.apache.hadoop.fs.Path(path)
    files = base.getFileSystem(conf)
    for folder in files.listStatus(base):
        where = folder.getPath()
        if folder.isDirectory() and where.getName().startswith("_cell="):
            name = where.getName().removeprefix("_cell=")
            for part in files.listStatus(where):
                if part.getPath().getName().startswith("part-"):
                    files.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(where, f"{name}.3dg"))
            files.rename(where, jvm.org.apache.hadoop.fs.Path(base, name))
