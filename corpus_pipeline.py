"""A training corpus from raw documents: quality rules, toxicity, near-duplicates,
secrets, packing.

Each stage takes the rows that the one before kept, whole, and returns the columns
of ``documents``; the last returns the pieces of packed sequences.  Between stages
the rows are written to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salespark.llm import common, packing, quality, secrets, simhash, toxicity
from salespark.llm.queries import word_tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base tests and the learned rules keep."""
    return quality.kept(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold."""
    return toxicity.kept(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest doc_id."""
    common.ship(spark)
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their texts replaced."""
    return secrets.redacted(secrets.find(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full windows, lexical neighbours together, with their ids."""
    common.ship(spark)
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxic_documents),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("packing", pack),
]

#: The trained stages and the packing order can't be told in SQL; the tests hold
#: every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
