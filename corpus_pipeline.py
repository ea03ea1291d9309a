"""A corpus pipeline of five stages; each takes what the one before kept.

quality_rules drops documents that the adaptive rules reject; near_dup keeps one document of each
group of near-duplicates (five-word shingles, similarity 0.8 or more); decontaminate drops documents
that hold benchmark passages; secret_scan replaces secrets in the texts by their kind and keeps every
document; byte_bpe encodes the texts and returns token counts and digests. All but the last return
the columns of documents, whatever else they are named.

Rows with null or empty texts have no words, so the first stage drops them. Rows are judged one by one,
also where doc_ids are null or repeated; near_dup keeps rows without a doc_id, takes rows of one doc_id as
one document and keeps one of exact repeats. Of near-duplicates the least doc_id stays. An empty table
passes through as an empty table, an empty benchmark drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bpe, decontaminate, near_dup, quality_rules, secrets, textscan


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, textscan.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trips(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_dup", dedup),
    ("decontaminate", clean_of_benchmark),
    ("secret_scan", redact_secrets),
    ("byte_bpe", tokens),
]
#: Near-duplicate groups, suffix search and BPE are beyond SQL; tests/llm has brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; between stages the rows are written to the checkpoint folder and read again."""
    textscan.shared_dir(spark)
    docs = textscan.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
