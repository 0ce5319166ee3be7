"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  Stages work on whole
texts and on every row that their predecessor kept; all but the last return the
columns of ``documents``, the last adds the token columns to them.

Secrets are masked in place; ``n_chars`` then counts the new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm import bpe, decontaminate, dedup, quality, secrets
from chromaloom.llm.common import remove, scope, table
from chromaloom.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and whose source is not rejected."""
    return quality.filter_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each class of near-duplicates."""
    return dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with n_tokens, ids_sha256, decoded_sha256 and token_ids."""
    return bpe.with_tokens(docs, *vocabulary())


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", bpe_stage),
]

#: SQL has no near-duplicate search nor tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs, done = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scope(spark) as keep:  # what a stage leaves behind goes, but for its result
            docs = keep(stage(spark, docs, sf_dir))
        remove(spark, done)
        done = keep.folders
    return STAGES[-1][1](spark, docs, sf_dir)
