"""Duplicate layers: a relation from every duplicate to the canonical record of its group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import relation_id
from ..functions.lineage import cut, few
from ..plans.rules import DUPLICATE_LAYERS, Rule
from .rangejoin import HOUR_NS, floor_div

KEYS = {
    "exact_key": ("source_id", "external_id"),
    "content_fingerprint": ("source_id", "content_hash"),
    "retransmit": ("source_id", "content_hash", "external_id"),
}
OF_RECORD = ("record_id", "external_id", "batch_id")


def _order() -> Column:
    return F.struct("stable_key", "source_line", "batch_ord", *OF_RECORD)


def _repeated(records: DataFrame, kind: str) -> DataFrame | None:
    """The rows whose keys occur twice by their hash; None where these are many."""
    hash_ = F.xxhash64(*KEYS[kind]).alias("_hash")
    often = few(records.groupBy(hash_).count().where("count > 1").select("_hash"))
    return None if often is None else records.withColumn("_hash", hash_).join(often, "_hash", "left_semi").drop("_hash")


def layer(records: DataFrame, kind: str) -> DataFrame:
    """(dup_type, relation_id, canonical_id, duplicate_id, duplicate_batch, source_id) of one layer.

    The canonical record is the one with the smallest stable key, then line and batch. It is
    found by a grouped minimum, which is summed up before the shuffle, and joined back: a
    group of any size needs no sorting in one task. Only rows whose keys occur twice by
    their hash take part, as long as these are few.
    """
    keys = KEYS[kind]
    repeated = _repeated(records, kind)
    records = records if repeated is None else repeated
    canonical = records.groupBy(*keys).agg(F.min(_order()).alias("c"), F.count("*").alias("n")).where("n > 1").select(*keys, "c")
    pairs = records.join(canonical, list(keys))
    other = _order() != F.col("c")
    if kind == "content_fingerprint":
        other = other & (F.col("external_id") != F.col("c.external_id"))
    if kind == "retransmit":
        other = other & (F.col("batch_id") != F.col("c.batch_id"))
    return pairs.where(other).select(
        F.lit(kind).alias("dup_type"),
        relation_id(F.lit(kind), F.col("c.record_id"), F.col("record_id")).alias("relation_id"),
        F.col("c.record_id").alias("canonical_id"),
        F.col("record_id").alias("duplicate_id"),
        F.col("batch_id").alias("duplicate_batch"),
        "source_id",
    )


def detect(records: DataFrame, rule: Rule | None = None) -> DataFrame:
    """All layers over valid records, with the action of the first rule's policy. Only rows whose content repeats can be retransmitted."""
    rule = rule or Rule()
    valid = records.where(~F.col("isolated"))
    columns = {"stable_key", "source_line", "batch_ord", *OF_RECORD, *KEYS["exact_key"], *KEYS["retransmit"]}
    same = _repeated(valid.select(*columns), "content_fingerprint")
    same = valid if same is None else cut(same)
    parts = [layer(valid if kind == "exact_key" else same, kind).withColumn("action", F.lit(rule.action(kind))) for kind in DUPLICATE_LAYERS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def without_excluded(records: DataFrame, relations: DataFrame) -> DataFrame:
    """Records that no relation excludes; only the duplicate's own batch loses it."""
    gone = relations.where("action = 'exclude'").select(F.col("duplicate_id").alias("record_id"), F.col("duplicate_batch").alias("batch_id")).distinct()
    sent = few(gone)
    return records.join(gone if sent is None else sent, ["record_id", "batch_id"], "left_anti")


def suspected(records: DataFrame, window_ns: int) -> DataFrame:
    """Extension: neighbours of one source with equal amount and currency at most ``window_ns`` apart, as (record_id, previous_id).

    Neighbours are found within cells of time, so that a very common amount is spread over tasks;
    the first of a cell looks back at the last of the cell before, a row a cell.
    """
    keys, order = ["source_id", "currency", "amount_minor"], ["ts_ns", "stable_key", "source_line", "batch_ord", "record_id"]
    x = records.select(*keys, *order, floor_div(F.col("ts_ns"), max(64 * window_ns, HOUR_NS)).alias("_cell"))
    this = F.struct("record_id", "ts_ns")
    ends = x.groupBy(*keys, "_cell").agg(F.max_by(this, F.struct(*order)).alias("_end"))
    before = ends.select(*keys, "_cell", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_cell")).alias("_before"))
    within = Window.partitionBy(*keys, "_cell").orderBy(*order)
    found = x.withColumn("_last", F.lag(this).over(within)).join(before, [*keys, "_cell"]).withColumn("_last", F.coalesce("_last", "_before"))
    return found.where(F.col("ts_ns") - F.col("_last.ts_ns") <= window_ns).select("record_id", F.col("_last.record_id").alias("previous_id"))


def retransmits(own: DataFrame, earlier: DataFrame) -> DataFrame:
    """(record_id, earlier_id, earlier_batch): valid rows of a batch that earlier batches of the same file content had already; the last of these by line and batch counts."""
    keys = ["source_id", "external_id", "content_hash"]
    last = earlier.where(~F.col("isolated")).groupBy(*keys).agg(F.max_by(F.struct("record_id", "batch_id"), F.struct("source_line", "batch_id")).alias("e"))
    return own.where(~F.col("isolated")).join(last, keys).select(own["record_id"], F.col("e.record_id").alias("earlier_id"), F.col("e.batch_id").alias("earlier_batch"))
