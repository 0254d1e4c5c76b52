"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's input.

Quality rules drop documents, near-duplicates keep one of each group, decontamination drops
documents that hold benchmark windows, secrets are replaced in place, and what is left is
packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyweave.llm import common, decontaminate, packing, quality, secrets, simhash
from tallyweave.llm.queries import table, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base test and the learnt decision list keep.

    Null and empty texts have no words and go; very long ones are measured whole; rows that repeat an id are judged
    each by its own text; without labels the list is empty; an empty table stays empty. All columns are returned as they are.
    """
    rules = quality.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, null ids last.

    Rows of one doc_id are judged each by its own text; null and empty texts form one component; texts are read whole;
    an empty table stays empty. All columns are returned as they are.
    """
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window.

    Null and empty texts have none and stay; rows that repeat an id are judged each by its own text; texts and items of any
    length are read whole; an empty table, or an empty benchmark, changes nothing. All columns are returned as they are.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind and n_chars counted again.

    Null texts stay null; repeated rows are treated alike; texts of any length are scanned whole; an empty table stays
    empty. All other columns are returned as they are.
    """
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows are packed each; long texts are cut over sequences, and lose
    nothing; an empty table gives no piece; other columns are left out.
    """
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scans", secret_stage),
    ("packing", packing_stage),
]

#: A learnt list, fingerprints and tokenisation are beyond SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
