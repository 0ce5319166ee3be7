"""Queries on contacts: cleaning, coverage, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chromaloom.operators import coverage as cov
from chromaloom.operators import preprocess as pre
from chromaloom.plans.base import Book

BOOK = Book()
query = BOOK.query

BAD_LEGS = """
legs AS (SELECT cell, chrom1 AS chrom, pos1 AS pos FROM pairs UNION ALL SELECT cell, chrom2, pos2 FROM pairs),
near AS (SELECT cell, chrom, pos, count(*) OVER (PARTITION BY cell, chrom ORDER BY pos RANGE BETWEEN 4000 PRECEDING AND 4000 FOLLOWING) AS n FROM legs),
bad AS (SELECT DISTINCT cell, chrom, pos FROM near WHERE n > 15)
"""
CLEAN = "SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.cell = p.cell AND b.chrom = p.chrom1 AND b.pos = p.pos1) AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.cell = p.cell AND b.chrom = p.chrom2 AND b.pos = p.pos2)"


@query("clean_leg", f"{BAD_LEGS} SELECT read_id, chrom1, pos1, chrom2, pos2 FROM ({CLEAN})", "pairs")
def clean_leg(pairs: DataFrame) -> DataFrame:
    return pre.clean_legs(pairs, 4000, 15).select("read_id", "chrom1", "pos1", "chrom2", "pos2")


@query("clean_leg_summary", f"{BAD_LEGS} SELECT (SELECT count(*) FROM pairs) AS n_before, (SELECT count(*) FROM ({CLEAN})) AS n_after, ((SELECT count(*) FROM pairs) - (SELECT count(*) FROM ({CLEAN}))) * 100.0e0 / (SELECT count(*) FROM pairs) AS removed_percent", "pairs")
def clean_leg_summary(pairs: DataFrame) -> DataFrame:
    return pre.removed_share(pairs, pre.clean_legs(pairs, 4000, 15))


FLAGSHIP = f"""{BAD_LEGS}, cleaned AS ({CLEAN}),
b AS (SELECT cell, chrom, pos - pos % 20000 AS pos, count(*) AS count FROM (SELECT cell, chrom1 AS chrom, pos1 AS pos FROM cleaned UNION ALL SELECT cell, chrom2, pos2 FROM cleaned) GROUP BY ALL)
SELECT cell, chrom, pos, count, count * 1e6 / sum(count) OVER (PARTITION BY cell) AS cpm FROM b"""


@query("clean_leg_cpm", FLAGSHIP, "pairs")
def clean_leg_cpm(pairs: DataFrame) -> DataFrame:
    return cov.pairs_to_bedgraph(pre.clean_legs(pairs, 4000, 15), 20_000)


@query(
    "clean_isolated",
    """SELECT a.read_id FROM pairs a JOIN pairs b ON a.cell = b.cell AND a.chrom1 = b.chrom1 AND a.chrom2 = b.chrom2
    AND (sqrt(abs(a.pos1 - b.pos1)) + sqrt(abs(a.pos2 - b.pos2))) * (sqrt(abs(a.pos1 - b.pos1)) + sqrt(abs(a.pos2 - b.pos2))) <= 40000 * (1 + 1e-12)
    GROUP BY a.read_id HAVING count(*) >= 6""",
    "pairs",
)
def clean_isolated(pairs: DataFrame) -> DataFrame:
    return pre.clean_isolated(pairs, 40_000, 5).select("read_id").distinct()


@query("clean_splicing", "SELECT read_id FROM pairs p WHERE NOT (chrom1 = chrom2 AND EXISTS (SELECT 1 FROM genes g WHERE g.chrom = p.chrom1 AND g.start < least(pos1, pos2) AND g.\"end\" >= greatest(pos1, pos2)))", "pairs", "genes")
def clean_splicing(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    return pre.clean_splicing(pairs, genes).select("read_id")


PARTICLES = "particles AS (SELECT cell, chrom1 AS chrom, CAST(g AS BIGINT) AS pos FROM (SELECT DISTINCT cell, chrom1 FROM pairs) t, range(0, 4000000, 20000) r(g))"
EVIDENCE = f"""{PARTICLES}, ok AS (SELECT * FROM pairs WHERE greatest(phase_prob00, phase_prob01, phase_prob10, phase_prob11) >= 0.75),
legs AS (SELECT cell, chrom1 AS chrom, pos1 AS pos FROM ok UNION ALL SELECT cell, chrom2, pos2 FROM ok),
ev AS (SELECT p.cell, p.chrom, p.pos, count(l.pos) AS n_legs FROM particles p LEFT JOIN legs l ON l.cell = p.cell AND l.chrom = p.chrom AND l.pos >= p.pos - 30000 AND l.pos < p.pos + 30000 GROUP BY ALL)"""


def _particles(pairs: DataFrame) -> DataFrame:
    return pairs.select("cell", F.col("chrom1").alias("chrom")).distinct().select("*", F.explode(F.expr("sequence(0L, 3999999L, 20000L)")).alias("pos"))


@query("structure_evidence", f"{EVIDENCE} SELECT * FROM ev", "pairs")
def structure_evidence(pairs: DataFrame) -> DataFrame:
    return pre.evidence(_particles(pairs), pre.phased(pairs), 30_000)


@query("clean3", f"{EVIDENCE}, gate AS (SELECT cell, quantile_cont(n_legs, 0.06) AS g FROM ev GROUP BY cell) SELECT cell, chrom, pos, pos / 2.0e0 AS x, n_legs FROM ev JOIN gate USING (cell) WHERE n_legs > g", "pairs")
def clean3(pairs: DataFrame) -> DataFrame:
    particles = _particles(pairs).withColumns({"x": F.col("pos").cast("double"), "y": F.lit(0.0), "z": F.lit(0.0)})
    return pre.clean_structure(particles, pairs, 0.06, 30_000, 2.0).select("cell", "chrom", "pos", "x", "n_legs")


HAP = " UNION ALL ".join(
    f"SELECT read_id, cell, concat(chrom1, '{pre.SUFFIX[c[0]]}') AS d1, concat(chrom2, '{pre.SUFFIX[c[1]]}') AS d2, chrom1, pos1, chrom2, pos2, '{c[0]}' AS phase0, '{c[1]}' AS phase1 FROM pairs WHERE phase_prob{c} >= 0.75"
    for c in ("00", "01", "10", "11")
)


@query("sep_clean_dip", f"SELECT read_id, d1 AS chrom1, d2 AS chrom2, phase0, phase1 FROM ({HAP})", "pairs")
def sep_clean_dip(pairs: DataFrame) -> DataFrame:
    return pre.separate_haplotypes(pairs)[0].select("read_id", "chrom1", "chrom2", "phase0", "phase1")


@query("sep_clean_hickit", f"SELECT read_id, chrom1, chrom2, phase0, phase1 FROM ({HAP})", "pairs")
def sep_clean_hickit(pairs: DataFrame) -> DataFrame:
    return pre.separate_haplotypes(pairs)[1].select("read_id", "chrom1", "chrom2", "phase0", "phase1")


@query(
    "sep_clean_isolated",
    f"""h AS ({HAP}) SELECT a.read_id, a.d1 AS chrom1, a.d2 AS chrom2 FROM h a JOIN h b ON a.cell = b.cell AND a.d1 = b.d1 AND a.d2 = b.d2
    AND (sqrt(abs(a.pos1 - b.pos1)) + sqrt(abs(a.pos2 - b.pos2))) * (sqrt(abs(a.pos1 - b.pos1)) + sqrt(abs(a.pos2 - b.pos2))) <= 40000 * (1 + 1e-12) GROUP BY ALL HAVING count(*) >= 4""",
    "pairs",
)
def sep_clean_isolated(pairs: DataFrame) -> DataFrame:
    return pre.separate_and_clean(pairs, 40_000, 3)[0].select("read_id", "chrom1", "chrom2").distinct()


@query("filter_phase_prob", "SELECT read_id FROM pairs WHERE greatest(phase_prob00, phase_prob01, phase_prob10, phase_prob11) >= 0.75", "pairs")
def filter_phase_prob(pairs: DataFrame) -> DataFrame:
    return pre.phased(pairs).select("read_id")


@query(
    "dedup_pairs",
    """a AS (SELECT *, CASE WHEN pos1 - lag(pos1) OVER (PARTITION BY cell, chrom1 ORDER BY pos1) <= 500 THEN 0 ELSE 1 END AS f1, CASE WHEN pos2 - lag(pos2) OVER (PARTITION BY cell, chrom2 ORDER BY pos2) <= 500 THEN 0 ELSE 1 END AS f2 FROM pairs),
    b AS (SELECT *, sum(f1) OVER (PARTITION BY cell, chrom1 ORDER BY pos1 RANGE UNBOUNDED PRECEDING) AS k1, sum(f2) OVER (PARTITION BY cell, chrom2 ORDER BY pos2 RANGE UNBOUNDED PRECEDING) AS k2 FROM a),
    c AS (SELECT read_id, row_number() OVER (PARTITION BY cell, chrom1, chrom2, k1, k2 ORDER BY read_id) AS r FROM b) SELECT read_id FROM c WHERE r = 1""",
    "pairs",
)
def dedup_pairs(pairs: DataFrame) -> DataFrame:
    return pre.dedup_pairs(pairs).select("read_id")


@query("sort_pairs", "SELECT DISTINCT chrom1, pos1, chrom2, pos2, strand1, strand2 FROM pairs", "pairs")
def sort_pairs(pairs: DataFrame) -> DataFrame:
    return pre.sort_pairs(pairs).select("chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2")


@query(
    "pairs_bedgraph_cpm",
    """b AS (SELECT cell, chrom, pos - pos % 20000 AS pos, count(*) AS count FROM (SELECT cell, chrom1 AS chrom, pos1 AS pos FROM pairs UNION ALL SELECT cell, chrom2, pos2 FROM pairs) GROUP BY ALL),
    g AS (SELECT cell, chrom, CAST(unnest(range(0, size, 20000)) AS BIGINT) AS pos FROM (SELECT DISTINCT cell FROM pairs) t, sizes),
    d AS (SELECT cell, chrom, pos, coalesce(count, 0) AS count FROM g LEFT JOIN b USING (cell, chrom, pos))
    SELECT cell, chrom, pos, count, count * 1e6 / nullif(sum(count) OVER (PARTITION BY cell), 0) AS cpm FROM d""",
    "pairs",
    "sizes",
)
def pairs_bedgraph_cpm(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    return cov.pairs_to_bedgraph(pairs, 20_000, sizes)


@query("bed_bedgraph", "b AS (SELECT cell, chrom, (start + \"end\") // 2 - (start + \"end\") // 2 % 20000 AS pos, count(*) AS count FROM fragments GROUP BY ALL) SELECT *, count * 1e6 / sum(count) OVER (PARTITION BY cell) AS cpm FROM b", "fragments")
def bed_bedgraph(fragments: DataFrame) -> DataFrame:
    return cov.bed_to_bedgraph(fragments, 20_000)


@query("pairs_coverage", "SELECT cell, chrom1 AS chrom, p - p % 10000 AS pos, count(*) AS count FROM (SELECT cell, chrom1, CASE WHEN chrom1 <> chrom2 OR abs(pos1 - pos2) > 1000 THEN pos1 ELSE (pos1 + pos2) // 2 END AS p FROM pairs) GROUP BY ALL", "pairs")
def pairs_coverage(pairs: DataFrame) -> DataFrame:
    return cov.pairs_coverage(pairs, 10_000)


@query("pairs_describe", "SELECT cell, count(*) AS n_pairs, avg(CASE WHEN chrom1 <> chrom2 THEN 1.0e0 ELSE 0 END) AS trans_ratio, avg(CASE WHEN chrom1 = chrom2 AND pos2 - pos1 < 1000 THEN 1.0e0 ELSE 0 END) AS near_ratio FROM pairs GROUP BY cell", "pairs")
def pairs_describe(pairs: DataFrame) -> DataFrame:
    return cov.pairs_describe(pairs)


@query("min_contacts", "SELECT read_id FROM pairs WHERE cell IN (SELECT cell FROM pairs GROUP BY cell HAVING count(*) > 7500)", "pairs")
def min_contacts(pairs: DataFrame) -> DataFrame:
    return cov.few_contacts(pairs, 7500).select("read_id")


@query(
    "seg2pairs",
    """f AS (SELECT string_split(value, chr(9)) AS f FROM segments), s AS (SELECT f[1] AS read_id, string_split(f[2], '!') AS a, string_split(f[len(f)], '!') AS b FROM f)
    SELECT read_id, a[1] AS chrom1, (CAST(a[2] AS BIGINT) + CAST(a[3] AS BIGINT)) // 2 AS pos1, b[1] AS chrom2, (CAST(b[2] AS BIGINT) + CAST(b[3] AS BIGINT)) // 2 AS pos2 FROM s WHERE CAST(a[6] AS INT) > 20 AND CAST(b[6] AS INT) > 20""",
    "segments",
)
def seg2pairs(segments: DataFrame) -> DataFrame:
    return cov.segments_to_pairs(segments, 20)


INSIDE = "EXISTS (SELECT 1 FROM regions r WHERE r.chrom = p.chrom{i} AND r.start <= p.pos{i} AND p.pos{i} < r.\"end\")"


@query("remove_regions", f"SELECT read_id FROM pairs p WHERE NOT {INSIDE.format(i=1)} AND NOT {INSIDE.format(i=2)}", "pairs", "regions")
def remove_regions(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.remove_regions(pairs, regions).select("read_id")


@query(
    "contacts_in_region",
    """SELECT a.chrom AS chrom1, a.start AS start1, a."end" AS end1, b.chrom AS chrom2, b.start AS start2, b."end" AS end2, count(DISTINCT read_id) AS n_contacts
    FROM pairs p JOIN regions a ON a.chrom = p.chrom1 AND p.pos1 >= a.start AND p.pos1 < a."end" JOIN regions b ON b.chrom = p.chrom2 AND p.pos2 >= b.start AND p.pos2 < b."end" GROUP BY ALL""",
    "pairs",
    "regions",
)
def contacts_in_region(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.contacts_in_regions(pairs, regions, ["read_id"])


@query(
    "trans_ratio_per_bin",
    """legs AS (SELECT chrom1 AS chrom, pos1 AS pos, CASE WHEN chrom1 <> chrom2 THEN 1.0e0 ELSE 0 END AS t FROM pairs UNION ALL SELECT chrom2, pos2, CASE WHEN chrom1 <> chrom2 THEN 1.0e0 ELSE 0 END FROM pairs)
    SELECT r.chrom, r.start, r."end", count(*) AS n_legs, avg(t) AS trans_ratio FROM legs l JOIN regions r ON r.chrom = l.chrom AND l.pos >= r.start AND l.pos < r."end" GROUP BY ALL""",
    "pairs",
    "regions",
)
def trans_ratio_per_bin(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.trans_ratio_per_bin(pairs, regions)


@query(
    "tss_enrichment",
    """t AS (SELECT chrom, CASE WHEN strand = '+' THEN start ELSE "end" END AS tss FROM genes), w AS (SELECT chrom, greatest(tss - 2050, 0) AS ws, tss + 2050 AS we FROM t),
    h AS (SELECT greatest(f.start - ws, 0) AS a, least(f."end" - ws, 4100) AS b FROM fragments f JOIN w ON w.chrom = f.chrom AND f.start < we AND ws < f."end"),
    m AS (SELECT sum(greatest(least(b, 100) - greatest(a, 0), 0)) / 100.0e0 AS first, sum(greatest(least(b, 2100) - greatest(a, 2000), 0)) / 100.0e0 AS middle, sum(greatest(least(b, 4100) - greatest(a, 4000), 0)) / 100.0e0 AS last FROM h)
    SELECT first, middle, last, middle / nullif((first + last) * 0.5e0, 0) AS enrichment FROM m""",
    "genes",
    "fragments",
)
def tss_enrichment(genes: DataFrame, fragments: DataFrame) -> DataFrame:
    return cov.tss_enrichment(genes.select("chrom", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")).alias("tss")), fragments)


PILE = """s AS (SELECT chrom, pos - pos % 10000 AS pos, CAST(count(*) AS DOUBLE) AS value FROM (SELECT chrom1 AS chrom, pos1 AS pos FROM pairs) GROUP BY ALL),
q AS (SELECT *, unnest(range(-3, 4)) AS o, (start + "end") // 2 - (start + "end") // 2 % 10000 AS m FROM regions),
f AS (SELECT q.chrom, q.start, q."end", CAST(o AS INT) AS "offset", value, count(*) OVER (PARTITION BY q.chrom, q.start, q."end") AS n FROM q JOIN s ON s.chrom = q.chrom AND s.pos = q.m + 10000 * o)"""


def _signal(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("chrom1").alias("chrom"), cov.bin_start("pos1", 10_000).alias("pos")).agg(F.count(F.lit(1)).cast("double").alias("value"))


@query("bedgraph_pileup", f"{PILE} SELECT chrom, start, \"end\", \"offset\", value FROM f WHERE n = 7", "pairs", "regions")
def bedgraph_pileup(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.pileup(_signal(pairs), regions, 10_000, 30_000)


@query("pileup_enrichment", f"{PILE} SELECT 2 * avg(CASE WHEN \"offset\" = 0 THEN value END) / (avg(CASE WHEN \"offset\" = -3 THEN value END) + avg(CASE WHEN \"offset\" = 3 THEN value END)) AS enrichment FROM f WHERE n = 7", "pairs", "regions")
def pileup_enrichment(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.pileup_enrichment(cov.pileup(_signal(pairs), regions, 10_000, 30_000), 3)


@query(
    "peak_windows",
    """c AS (SELECT chrom, start - start % 100 AS pos, count(*) AS count FROM fragments WHERE "end" - "end" % 100 = start - start % 100 + 100 GROUP BY ALL),
    q AS (SELECT *, unnest(range(-20, 21)) AS o, (start + "end") // 2 - (start + "end") // 2 % 100 AS m FROM regions)
    SELECT q.chrom, q.start, q."end", CAST(o AS INT) AS "offset", coalesce(count, 0) AS count FROM q LEFT JOIN c ON c.chrom = q.chrom AND c.pos = q.m + 100 * o""",
    "fragments",
    "regions",
)
def peak_windows(fragments: DataFrame, regions: DataFrame) -> DataFrame:
    return cov.peak_windows(fragments, regions)
