"""A reconciliation run: duplicates, the rules' phases, leftovers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.lineage import cut
from ..operators import dedup, matching
from .rules import Rule


@dataclass
class Result:
    groups: DataFrame
    discrepancies: DataFrame
    duplicates: DataFrame
    records: DataFrame


@dataclass
class Matched:
    """What the phases of matching gave, and what they left free of the active records."""

    groups: list[DataFrame]
    discrepancies: list[DataFrame]
    duplicates: DataFrame
    active: DataFrame
    free: DataFrame


def union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def match(records: DataFrame, rules: list[Rule]) -> Matched:
    """Duplicates and the phases of all rules over written ``records``.

    The loop over rules runs on the driver, since rules are few and each sees what the ones
    before it left; all work on records is Spark's.
    """
    duplicates = cut(dedup.detect(records, rules[0] if rules else None))
    active = dedup.without_excluded(records.where(~F.col("isolated")), duplicates)
    out = Matched([], [], duplicates, active, active)

    def commit(g: DataFrame, d: DataFrame) -> None:
        """Write the results of a phase; what they claim is read off them, and records themselves are never written again."""
        out.groups.append(cut(g))
        out.discrepancies.append(cut(d))
        claimed = out.groups[-1].select(F.explode("record_ids").alias("record_id")).union(out.discrepancies[-1].select(F.col("record_ids")[0]))
        out.free = out.free.join(claimed, "record_id", "left_anti")

    for rule in rules:
        allowed = F.col("role").isin(*rule.allowed_roles)
        groups, left = matching.exact_id_phase(out.free.where(allowed))
        out.groups.append(groups)
        out.free = matching.without_exact(out.free, groups.select(F.explode("record_ids").alias("record_id")), allowed, left)
        if rule.one_to_many:
            commit(*matching.one_to_many(out.free.where(allowed), rule, written=rule is rules[0] and left is not None))
        commit(*matching.tolerance_phase(out.free.where(allowed), rule))
    return out


def invalid_records(records: DataFrame) -> DataFrame:
    """Isolated rows as discrepancies."""
    bad = records.where("isolated").select(F.lit("invalid_record").alias("type"), "currency", F.array("record_id").alias("record_ids"), F.array().cast("array<string>").alias("candidate_ids"), F.array().cast("array<bigint>").alias("score_tuple"), F.col("invalid_reason").alias("note"))
    return bad.withColumn("discrepancy_id", ids.discrepancy_id(F.col("type"), F.col("record_ids"))).select(*matching.DISC_COLUMNS)


def matched_groups(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """The groups of ``reconcile``. Judging leftovers gives none, so they are not."""
    m = match(cut(records), rules)
    groups = union(m.groups)
    return matching.exact_id_groups(m.active.where("false")) if groups is None else groups


def reconcile(records: DataFrame, rules: list[Rule], emit_invalid: bool = False, written: bool = False) -> Result:
    """Run all rules over ``records`` (``schema.RECORD_COLUMNS``); ``emit_invalid`` also reports isolated rows. ``written`` records are read off a table as they are."""
    records = records if written else cut(records)
    m = match(records, rules)
    discrepancies = [*m.discrepancies, cut(matching.classify(m.free, m.active, rules))]
    if emit_invalid:
        discrepancies.append(invalid_records(records))
    groups = union(m.groups)
    if groups is None:
        groups = matching.exact_id_groups(m.active.where("false"))
    seen = m.active.unionByName(records.where("isolated")) if emit_invalid else m.active
    return Result(groups, union(discrepancies), m.duplicates, seen)
