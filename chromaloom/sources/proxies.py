"""Domain tables derived from the driver's tables, by one text that Spark and DuckDB both read.

Whole numbers and ratios only, so both engines agree.  Table names in braces are
frames for Spark and plain names for DuckDB.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Side length of the bins of the structure proxy.
BIN = 20_000

VIEWS: dict[str, str] = {
    "pairs": """
        SELECT read_id, cell, chrom1, pos1, chrom2, pos1 + q * q * 37 AS pos2, CASE WHEN q % 2 = 0 THEN '+' ELSE '-' END AS strand1, CASE WHEN q % 3 = 0 THEN '+' ELSE '-' END AS strand2, phase0, phase1,
          (CASE phase0 WHEN '0' THEN 1.0e0 WHEN '1' THEN 0.0e0 ELSE 0.5e0 END) * (CASE phase1 WHEN '0' THEN 1.0e0 WHEN '1' THEN 0.0e0 ELSE 0.5e0 END) AS phase_prob00,
          (CASE phase0 WHEN '0' THEN 1.0e0 WHEN '1' THEN 0.0e0 ELSE 0.5e0 END) * (CASE phase1 WHEN '1' THEN 1.0e0 WHEN '0' THEN 0.0e0 ELSE 0.5e0 END) AS phase_prob01,
          (CASE phase0 WHEN '1' THEN 1.0e0 WHEN '0' THEN 0.0e0 ELSE 0.5e0 END) * (CASE phase1 WHEN '0' THEN 1.0e0 WHEN '1' THEN 0.0e0 ELSE 0.5e0 END) AS phase_prob10,
          (CASE phase0 WHEN '1' THEN 1.0e0 WHEN '0' THEN 0.0e0 ELSE 0.5e0 END) * (CASE phase1 WHEN '1' THEN 1.0e0 WHEN '0' THEN 0.0e0 ELSE 0.5e0 END) AS phase_prob11
        FROM (SELECT concat(l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey) AS read_id, concat('c', l_orderkey % 8) AS cell, concat('chr', 1 + l_suppkey % 5) AS chrom1,
            l_partkey * 2000 + (l_orderkey * 7919) % 2000 AS pos1, CASE WHEN l_linenumber % 4 = 0 THEN concat('chr', 1 + l_orderkey % 5) ELSE concat('chr', 1 + l_suppkey % 5) END AS chrom2,
            CAST(l_quantity AS BIGINT) AS q, CASE l_linestatus WHEN 'F' THEN '0' ELSE '1' END AS phase0, CASE l_returnflag WHEN 'A' THEN '0' WHEN 'R' THEN '1' ELSE '.' END AS phase1 FROM {lineitem}) AS t""",
    "genes": """
        SELECT concat('chr', 1 + p_partkey % 5) AS chrom, p_partkey * 2000 AS start, p_partkey * 2000 + p_size * 1000 AS "end", concat('G', p_partkey) AS id, concat('g', p_partkey) AS gene,
          CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {part}""",
    "regions": """
        SELECT concat('chr', 1 + s_suppkey % 5) AS chrom, s_suppkey * 40000 AS start, s_suppkey * 40000 + 10000 + 100 * s_nationkey AS "end" FROM {supplier}""",
    "fragments": """
        SELECT concat('c', user_id % 8) AS cell, concat('chr', 1 + user_id % 5) AS chrom, event_id * 200 + user_id * 13 AS start, event_id * 200 + user_id * 13 + 50 + event_id % 150 AS "end",
          CASE event_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '1' ELSE '.' END AS allele, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand FROM {events}""",
    "bedgraph": """
        SELECT concat('chr', 1 + p_partkey % 5, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'b' END) AS chrom, p_partkey * 3000 AS start, p_partkey * 3000 + p_size * 1500 AS "end", CAST(p_size AS DOUBLE) AS value FROM {part}""",
    "tdg": """
        SELECT 'c0' AS cell, concat('chr', 1 + label % 5, CASE WHEN label < 5 THEN 'a' ELSE 'b' END) AS chrom, 20000 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS pos,
          10 * CAST(embedding[#0] AS DOUBLE) AS x, 10 * CAST(embedding[#1] AS DOUBLE) AS y, 10 * CAST(embedding[#2] AS DOUBLE) AS z, CAST(vec_id % 7 AS DOUBLE) AS feature FROM {embeddings}""",
    "cells3d": """
        SELECT concat('c', vec_id % 5) AS cell, concat('chr', 1 + label % 2) AS chrom, 20000 * (row_number() OVER (PARTITION BY vec_id % 5, label % 2 ORDER BY vec_id) - 1) AS pos,
          10 * CAST(embedding[#0] AS DOUBLE) AS x, 10 * CAST(embedding[#1] AS DOUBLE) AS y, 10 * CAST(embedding[#2] AS DOUBLE) AS z, CAST(vec_id % 7 AS DOUBLE) AS feature FROM {embeddings}""",
    "loci": """
        SELECT concat('c', o_custkey % 12) AS cell, concat('chr', 1 + o_orderkey % 3) AS chrom, CAST(o_orderkey % 40 AS BIGINT) * 20000 AS pos, CAST(avg(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE)) AS DOUBLE) AS value
        FROM {orders} GROUP BY 1, 2, 3""",
    "pixels": """
        SELECT 'bulk' AS cell, chrom1 AS chrom, least(pos1 - pos1 % 20000, pos2 - pos2 % 20000) AS bin1, greatest(pos1 - pos1 % 20000, pos2 - pos2 % 20000) AS bin2, CAST(count(*) AS DOUBLE) AS value
        FROM (SELECT concat('chr', 1 + l_suppkey % 5) AS chrom1, (l_partkey % 60) * 20000 + (l_orderkey * 7919) % 2000 AS pos1,
            (l_partkey % 60) * 20000 + (l_orderkey * 7919) % 2000 + CAST(l_quantity AS BIGINT) * CAST(l_quantity AS BIGINT) * 97 AS pos2 FROM {lineitem}) AS t GROUP BY 1, 2, 3, 4""",
    "track": """
        SELECT DISTINCT concat('chr', 1 + p_partkey % 5) AS chrom, (p_partkey % 75) * 20000 AS pos, CASE WHEN (p_partkey % 75) % 7 < 3 THEN 'A' ELSE 'B' END AS label, CAST(((p_partkey % 75) * 37) % 101 AS DOUBLE) / 100 AS cpg FROM {part}""",
    "timing": """
        SELECT concat('chr', 1 + p_partkey % 5) AS chrom, p_partkey * 2000 AS start, p_partkey * 2000 + 1000 + 100 * p_size AS "end", CAST(p_size - 25 AS DOUBLE) AS rep_value FROM {part}""",
    "sizes": """
        SELECT concat('chr', 1 + s) AS chrom, CAST(2000000 + 400000 * s AS BIGINT) AS size FROM (SELECT DISTINCT s_suppkey % 5 AS s FROM {supplier}) AS t""",
    "bedpe": """
        SELECT s_suppkey AS id, concat('chr', 1 + s_suppkey % 3) AS chrom1, s_suppkey * 7919 % 500000 AS start1, s_suppkey * 7919 % 500000 + 5000 AS end1, concat('chr', 1 + s_suppkey % 3) AS chrom2,
          600000 + s_suppkey * 104729 % 500000 AS start2, 600000 + s_suppkey * 104729 % 500000 + 5000 AS end2 FROM {supplier}""",
    "rna": """
        SELECT concat('c', o_custkey % 12) AS cell, concat('g', 1 + o_orderkey % 60) AS gene, CASE o_orderkey % 2 WHEN 0 THEN 'genome1' ELSE 'genome2' END AS genome, CAST(count(*) AS DOUBLE) AS umi FROM {orders} GROUP BY 1, 2, 3""",
    "segments": """
        SELECT concat('r', l_orderkey, '_', l_linenumber, '_', l_partkey, '_', l_suppkey, chr(9), 'chr', 1 + l_suppkey % 5, '!', l_partkey * 100, '!', l_partkey * 100 + 50, '!x!y!', l_partkey % 60, chr(9),
            'chr', 1 + l_orderkey % 5, '!', l_orderkey * 100, '!', l_orderkey * 100 + 71, '!x!y!', l_orderkey % 60) AS value FROM {lineitem}""",
    "bandcounts": """
        SELECT cell, chrom1 AS chr1, bin1, chrom2 AS chr2, bin2, CASE WHEN chrom1 = chrom2 THEN CAST(bin2 - bin1 AS BIGINT) ELSE CAST(-1 AS BIGINT) END AS diag, CAST(count(*) AS DOUBLE) AS value
        FROM (SELECT concat('c', l_orderkey % 8) AS cell, concat('chr', 1 + l_suppkey % 5) AS chrom1, CASE WHEN l_linenumber % 4 = 0 THEN concat('chr', 1 + l_orderkey % 5) ELSE concat('chr', 1 + l_suppkey % 5) END AS chrom2,
            l_partkey % 50 AS bin1, l_partkey % 50 + CAST(l_quantity AS BIGINT) % 12 AS bin2 FROM {lineitem}) AS t GROUP BY 1, 2, 3, 4, 5, 6""",
}

_TABLE = re.compile(r"\{(\w+)\}")


def duckdb_view(name: str) -> str:
    """The view as a DuckDB SELECT: lists count from 1."""
    return _TABLE.sub(r"\1", re.sub(r"#(\d)", lambda m: str(int(m[1]) + 1), VIEWS[name]))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a Spark DataFrame: lists count from 0."""
    text = re.sub(r"#(\d)", r"\1", VIEWS[name]).replace('"', "`")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(_TABLE.findall(text))}
    return spark.sql(text, **tables)


def with_views(sql: str, *names: str) -> str:
    """A DuckDB query with the views it uses in front."""
    return "WITH " + ",\n".join(f"{n} AS ({duckdb_view(n)})" for n in names) + ("\n" if sql.lstrip().upper().startswith("SELECT") else ",\n") + sql.strip()
