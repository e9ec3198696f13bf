"""A corpus pipeline: quality rules, near-dedup, decontamination, secret masking and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's ``docs``. All but the last keep the columns of ``documents``; further columns,
whatever their names, are carried along. Stages take nulls in any column, empty and very long texts, repeated
rows and empty tables; what becomes of each is said below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, nearcopies, packing, quality, secrets, simhash
from millrace.llm.common import drop_table, prepare, settle, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go; the others lose their boilerplate lines,
    which are counted once for each class of near copies. Null and empty texts go, as they have under 50
    words; a null source is a source of its own; equal rows fare alike; a line at its limit stays."""
    prepare(spark)
    return quality.apply(docs, copies=nearcopies.labels(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8) one document stays: the one with
    the smallest doc_id (none comes last), of equal ids the one with the least text hash, and of rows that
    repeat it one. Null and empty texts are one class. Links come from SimHash fingerprints and their pivot table, each
    verified by the exact similarity; ``nearcopies`` says why their bits and radius aren't those of op9."""
    prepare(spark)
    return simhash.keep_one(docs, nearcopies.labels(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays. Null and empty texts stay as they are."""
    prepare(spark)
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their ids, their sequence and their place there. A null or empty
    text is its end id alone; repeated rows are each packed."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_masking", secret_masking),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can neither tokenise nor hash as the stages do; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
