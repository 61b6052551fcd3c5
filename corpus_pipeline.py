"""The corpus pipeline: documents to packed training sequences.

Stages in order: reject toxic documents, keep one of each group of near copies,
remove documents that hold benchmark passages, redact personal data, pack. Each
stage works on all rows that the one before it kept; run() writes every stage's
result as Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conspectus.llm import common, decontam, neardup, packing, pii, queries, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows but those that the classifier chain, learned from the labels, takes for toxic.

    Null and empty texts stay, repeated rows share their fate, all columns stay whatever
    their names; an empty table, or one without labels, passes whole.
    """
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of documents with 80 % of their five-word shingles in common.

    The row of the smallest id stays, and of ties one that their contents settle. Null and
    empty texts all stay; unrelated texts under one id are different documents.
    """
    return neardup.keep_one(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows but those that hold a verified stretch of a benchmark item; null and empty texts stay."""
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a tag for every span of personal data in their text, and n_chars as it then is."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and offset; a null or empty text is one piece."""
    return packing.pack_documents(docs, queries.VOCABULARY)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL cannot express the learned, sketched and packed stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep; a stage's table goes when the next one is written."""
    work = common.Workspace(spark)
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, work.save(stage(spark, docs, sf_dir), name)
        work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
