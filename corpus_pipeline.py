"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, PII, BPE.

Every stage takes all rows that the one before it kept, written as Parquet in the shared folder and read again. Stages but the
last return the columns of documents; the last returns encoded documents. A stage's tables, and the documents it read, are
deleted once its result is written.

Defined cases: null and empty texts, and those without a letter, go in the first stage. Rows with a null doc_id stay unless they
hold a benchmark item. Repeated rows are near copies of each other, so one stays. Very long texts are worked on whole, and an
empty table gives no rows. Further columns, whatever their names, stay up to the last stage, which returns its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqframe.llm import bpe, decontaminate, langid, pii, simhash
from seqframe.llm.common import cut, drop, scratch, small_batches
from seqframe.llm.queries import table, vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text, go."""
    small_batches(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document of the smallest doc_id stays."""
    small_batches(spark)
    return simhash.deduplicate(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are replaced in the texts."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of what they decode to."""
    small_batches(spark)
    return bpe.encode_digest(docs, vocabulary(), ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate_benchmark),
    ("pii", remove_personal_data),
    ("bpe", encode),
]

#: SQL cannot express out-of-place language ID, 64-bit XXH64 fingerprints or BPE; tests hold the rows against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            kept = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made[:] = [t for t in made if t is not kept]
        drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
