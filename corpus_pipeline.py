"""A training corpus from ``documents``: rules, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  :func:`run` writes every stage's result as Parquet in the shared scratch
folder and reads it again for the next, so that a lost executor costs no more
than a stage.  All stages but the last return the columns of ``documents``.

Defined results: an empty table passes through every stage; null texts have no
words and go in the first stage; repeated rows go in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadflow.llm import edit_matching, fertility, randomness, simhash, vector_packing
from roadflow.llm.shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a fertility band rejects go."""
    return fertility.keep_sound(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its error budget go."""
    return edit_matching.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and ``n_chars`` follows."""
    return randomness.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return vector_packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate),
          ("secret_scan", secret_scan), ("pack", pack)]

#: Tokenisers, fingerprints and edit distances are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
