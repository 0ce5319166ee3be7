"""Schemas of the domain's tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAIRS = T.StructType(
    [T.StructField(n, t) for n, t in [("read_id", T.StringType()), ("chrom1", T.StringType()), ("pos1", T.LongType()), ("chrom2", T.StringType()), ("pos2", T.LongType()), ("strand1", T.StringType()), ("strand2", T.StringType()), ("phase0", T.StringType()), ("phase1", T.StringType()), *((f"phase_prob{c}", T.DoubleType()) for c in ("00", "01", "10", "11"))]]
)
#: The columns' names in files.
PAIRS_HEADER = ["readID", *PAIRS.fieldNames()[1:]]
STRUCTURE = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("pos", T.LongType()), *(T.StructField(a, T.FloatType()) for a in "xyz")])
BED = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("allele", T.StringType()), T.StructField("score", T.StringType()), T.StructField("strand", T.StringType())])
BEDGRAPH = T.StructType([*BED.fields[:3], T.StructField("value", T.DoubleType())])
ALLELIC_BEDGRAPH = T.StructType([*BED.fields[:4], T.StructField("value", T.DoubleType())])
GENES = T.StructType([*BED.fields[:3], T.StructField("id", T.StringType()), T.StructField("gene", T.StringType()), T.StructField("strand", T.StringType())])
GTF = T.StructType([T.StructField(n, T.LongType() if n in ("start", "end") else T.StringType()) for n in ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "group")])
SIZES = T.StructType([T.StructField("chrom", T.StringType()), T.StructField("size", T.LongType())])
TIMING = T.StructType([*BED.fields[:3], T.StructField("rep_value", T.DoubleType())])
BEDPE = T.StructType([T.StructField(f"{n}{i}", T.StringType() if n == "chrom" else T.LongType()) for i in (1, 2) for n in ("chrom", "start", "end")])
BANDS = T.StructType([T.StructField("chr1", T.StringType()), T.StructField("bin1", T.LongType()), T.StructField("chr2", T.StringType()), T.StructField("bin2", T.LongType()), T.StructField("diag", T.StringType()), T.StructField("value", T.DoubleType())])
DISTANCES = T.StructType([T.StructField("chrom1", T.StringType()), T.StructField("pos1", T.LongType()), T.StructField("chrom2", T.StringType()), T.StructField("pos2", T.LongType()), T.StructField("distance", T.DoubleType())])
