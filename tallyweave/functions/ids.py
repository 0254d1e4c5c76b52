"""Identifiers out of content: the first sixteen hexadecimal digits of SHA-256."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def content_hash() -> Column:
    parts = ("role", "currency", "amount_minor", "direction", "ts_ns", "counterparty", "business_id")
    return short_hash(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))


def with_identity(records: DataFrame) -> DataFrame:
    """Add content_hash, record_id and stable_key."""
    out = records.withColumn("content_hash", content_hash())
    return out.withColumns(
        {
            "record_id": F.concat(F.lit("rec_"), short_hash(F.concat_ws("|", "source_id", F.col("source_line").cast("string"), "content_hash"))),
            "stable_key": F.concat_ws("|", "role", "external_id", "content_hash"),
        }
    )


def group_id(record_ids: Column) -> Column:
    """Of a sorted array of record ids."""
    return F.concat(F.lit("mg_"), short_hash(F.concat(F.array_join(record_ids, "\n"), F.lit("\n"))))


def discrepancy_id(kind: Column, record_ids: Column) -> Column:
    """Of record ids in the order given."""
    return F.concat(F.lit("disc_"), short_hash(F.concat(kind, F.lit("\n"), F.array_join(record_ids, "\n"), F.lit("\n"))))


def relation_id(kind: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("dup_"), short_hash(F.concat_ws("|", kind, F.least(a, b), F.greatest(a, b))))


def batch_digest(record_ids: Column) -> Column:
    """Aggregate: digest of a batch's valid record ids, sorted, each followed by a line feed."""
    return short_hash(F.concat(F.array_join(F.sort_array(F.collect_list(record_ids)), "\n"), F.lit("\n")))
