"""Readers and writers, round trips, command line, streams."""

from __future__ import annotations

import glob
import gzip

import pytest

from chromaloom import cli
from chromaloom.sources import readers as rd
from chromaloom.sources import writers as wr
from chromaloom.streaming import windows as sw


def read_lines(path):
    out = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        with (gzip.open(f, "rt") if f.endswith(".gz") else open(f)) as src:
            out += src.read().splitlines()
    return out


@pytest.fixture
def pairs_file(tmp_path):
    path = tmp_path / "cellA.pairs.gz"
    rows = ["r1\tchr1\t100\tchr1\t5000\t+\t-", "r2\tchr1\t600\tchr2\t100\t+\t+", "r3\tchr1\t1100\tchr2\t9000\t-\t-", "r4\tchr1\t2101\tchr2\t20000\t+\t-"]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(["## pairs format v1.0", "#columns: readID", *rows]) + "\n")
    return str(path)


def test_pairs_round_trip(spark, pairs_file, tmp_path):
    df = rd.read_pairs(spark, pairs_file)
    assert df.count() == 4 and df.first()["cell"] == "cellA" and df.first()["phase0"] is None
    assert [r["text"] for r in rd.read_header(spark, pairs_file).orderBy("line_no").collect()] == ["## pairs format v1.0", "#columns: readID"]
    wr.write_pairs(df, str(tmp_path / "out"), ["## pairs format v1.0", "#columns: x"])
    lines = read_lines(tmp_path / "out")
    assert lines[0].startswith("## pairs") and lines[1].startswith("#columns: readID chrom1") and len(lines) == 6
    assert rd.read_pairs(spark, str(tmp_path / "out")).count() == 4


def test_cleaning_from_the_command_line(spark, pairs_file, tmp_path):
    args = cli.parser().parse_args(["clean_leg", pairs_file, "-o", str(tmp_path / "clean"), "-n", "2"])
    cli.run(args, spark)
    assert [x.split("\t")[0] for x in read_lines(tmp_path / "clean") if not x.startswith("#")] == ["r4"]


def test_structures(spark, tmp_path):
    path = tmp_path / "s1.3dg"
    path.write_text("#backbone_unit: 2.5\nchr1(pat)\t0\t0\t0\t0\nchr1(pat)\t20000\t1\t0\t0\nchr2(mat)\t0\t0\t1\t0\n")
    df = rd.read_structure(spark, str(path))
    assert {r["chrom"] for r in df.collect()} == {"chr1a", "chr2b"}
    assert rd.backbone_units(spark, str(path)).first()["backbone_unit"] == 2.5
    middle = rd.read_structure(spark, str(path), to_middle=True)
    assert sorted(r["pos"] for r in middle.collect()) == [10000, 10000, 30000]
    assert sorted(r["pos"] for r in rd.shift_to_start(middle).collect()) == [0, 0, 20000]
    assert {r["chrom_code"] for r in rd.chromosome_codes(df).collect()} == {0, 1}
    wr.write_cif(df, str(tmp_path / "cif"), "s1", 20000)
    cif = read_lines(tmp_path / "cif")
    assert cif[0] == "data_s1" and sum(x.startswith("ATOM") for x in cif) == 3 and sum(x.startswith("covale") for x in cif) == 1
    wr.write_xyz(df, str(tmp_path / "xyz"))
    assert read_lines(tmp_path / "xyz")[0] == "3"
    wr.write_pdb(df, str(tmp_path / "pdb"), 20000)
    assert read_lines(tmp_path / "pdb")[-1] == "END"
    wr.write_structure(df, str(tmp_path / "again"), 2.5)
    assert rd.read_structure(spark, str(tmp_path / "again")).count() == 3
    assert '"n":3' in wr.summary_json(df).first()["summary"]
    wr.store(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("chrom = 'chr1a'").count() == 2


def test_unknown_alias_fails(spark, tmp_path):
    path = tmp_path / "s.3dg"
    path.write_text("chrZ\t0\t0\t0\t0\n")
    alias = spark.createDataFrame([("1", "chr1")], "norm_name string, alias string")
    with pytest.raises(Exception, match="unknown chromosome"):
        rd.read_structure(spark, str(path), alias).collect()


def test_other_readers(spark, tmp_path):
    (tmp_path / "g.gtf").write_text('#c\nchr1\tHAVANA\texon\t5\t9\t.\t+\t.\tgene_id "g1"; x "y"\n')
    gtf = rd.read_gtf(spark, str(tmp_path / "g.gtf"))
    assert gtf.select(rd.gtf_attribute("gene_id").alias("g")).first()["g"] == "g1"
    (tmp_path / "n.tsv").write_text("gene\tc1\tc2\ng1\t1\t0\n")
    assert {(r["cell"], r["umi"]) for r in rd.read_counts(spark, str(tmp_path / "n.tsv"), "genome1").collect()} == {("c1", 1.0), ("c2", 0.0)}
    (tmp_path / "t.bed").write_text("1\t0\t5\t2.5\n")
    assert rd.read_cpg(spark, str(tmp_path / "t.bed")).first()["chrom"] == "chr1"
    px = rd.read_matrix_csr(spark, [1.0, 2.0], [0, 1], [0, 2, 2], "chr1", 10)
    assert [(r["bin1"], r["bin2"]) for r in px.collect()] == [(0, 0), (0, 10)]
    (tmp_path / "empty.pairs").write_text("")
    assert rd.read_pairs(spark, str(tmp_path / "empty.pairs")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('c', id % 2) AS cell", "'chr1' AS chrom", "id * 7 AS start")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed = sw.drained(sw.binned(sw.stream(spark, str(tmp_path / "in")), 100), "complete")
    key = lambda df: sorted((r["cell"], r["pos"], r["count"]) for r in df.collect())
    assert key(streamed) == key(sw.binned(rows, 100))
