"""Driver queries of the corpus operators and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classlm, decontaminate, dedup, html_extract, langid, ordering, pii, quality, secrets
from .common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
  SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT cast(item_id AS VARCHAR) AS item, k, array_to_string(w[s:s + k - 1], ' ') AS gram FROM starts
), lengths AS (SELECT DISTINCT k FROM grams), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d
), hits AS (
  SELECT doc_id, p, l.k, g.item FROM places JOIN lengths l ON p + l.k - 1 <= len(w)
  JOIN grams g ON g.k = l.k AND g.gram = array_to_string(w[p:p + l.k - 1], ' ')
), words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary() -> tuple[str, str]:
    """Path of the rank file and the pattern that cuts texts into pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), ids=False)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.learnable()))
    return langid.predict(docs.withColumn("held_out", ~langid.learnable()), model, ["doc_id", "held_out"])


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, width = ordering.encoded(table(spark, sf_dir, "documents"), *vocabulary())
    found = ordering.materialise(ids, ordering.folder_for(ids), F.col(ordering.PAYLOAD), width, ordering.ID, key=20240229)
    return found.withColumnRenamed(ordering.ID, "doc_id")


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", classlm.remainder(10) == 0)
    model, counts = classlm.learn(docs.where(~F.col("held_out")))
    coded = classlm.code(docs, model, counts, ["doc_id", "held_out"])
    if model.words:
        model = classlm.with_transitions(model, coded.where(~F.col("held_out")))
    return classlm.rate(coded, model, ["doc_id", "held_out"])


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept", "doc_failed", "host_rejected", "host_risk")


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3
), g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM p
), many AS (SELECT doc_id, a, b, c FROM g GROUP BY ALL HAVING count(*) > 1
), r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM g JOIN many USING (doc_id, a, b, c)) GROUP BY 1
), m AS (
  SELECT w.doc_id, source, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, cast(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), f AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 100 * n_symbols > 10 * n_words AS f2, 100 * n_dup_lines > 20 * n_words AS f3, word_chars < 2 * n_words OR word_chars > 20 * n_words AS f4 FROM m
), each_rule AS (
  SELECT source, r, f FROM (SELECT source, unnest([0, 1, 2, 3, 4]) AS r, unnest([f0, f1, f2, f3, f4]) AS f FROM f)
), h AS (SELECT source, r, count(*) AS n, sum(cast(f AS BIGINT)) AS k FROM each_rule GROUP BY source, r
), q AS (
  SELECT r, sum(k)::DOUBLE / sum(n) AS mean, coalesce(var_samp(k::DOUBLE / n), 0) - sum(k)::DOUBLE / sum(n) * (1 - sum(k)::DOUBLE / sum(n)) * avg(1.0::DOUBLE / n) AS spread FROM h GROUP BY r
), priors AS (SELECT r, mean, CASE WHEN spread > 0 THEN least(1000.0, greatest(2.0, mean * (1 - mean) / spread - 1)) ELSE 1000.0 END AS weight FROM q
), s AS (SELECT source, n, mean, weight, (k + mean * weight) / (n + weight) AS shrunk FROM h JOIN priors USING (r)
), bad AS (
  SELECT source, max((shrunk - 2 * sqrt(shrunk * (1 - shrunk) / (n + weight + 1))) / least(0.75::DOUBLE, greatest(0.3::DOUBLE, 3 * mean))) AS risk FROM s GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4) AND NOT risk > 1 AS kept, f0 OR f1 OR f2 OR f3 OR f4 AS doc_failed, risk > 1 AS host_rejected, round(risk, 6) AS host_risk
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_language_id": op4_language_id,
    "op5_training_order": op5_training_order,
    "op6_class_lm": op6_class_lm,
    "op7_personal_data": op7_personal_data,
    "op8_quality_rules": op8_quality_rules,
    "op9_secret_scan": op9_secret_scan,
    "op10_html_extract": op10_html_extract,
}

ORACLE_SQL = {
    "op1_decontaminate": OP1_SQL,
    "op8_quality_rules": OP8_SQL,
}
