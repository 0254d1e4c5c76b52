"""A run brought up to date after a late batch: only what the batch touches is matched again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..functions.lineage import among, cut, marked
from ..functions.lineage import outside as without
from ..operators import dedup, matching
from ..operators.rangejoin import islands, time_bucket
from ..schema import ROLES
from . import engine
from .rules import Rule

SETTLED = ("ambiguous", "search_limit", "invalid_record")  # discrepancies that no later record changes but through what they share with it
AROUND = (-1, 0, 1)
REACHED = ("record_id", "role", "currency", "amount_minor", "ts_ns")


def _key(kind: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(kind), *columns)


def _shared_keys(valid: DataFrame, rules: list[Rule]) -> DataFrame:
    """(record_id, key): hashes of what records that may decide on each other share. Two keys of one hash only widen what is matched again."""
    pairs = [_key(0, "source_id", "external_id"), _key(1, "source_id", "content_hash"), F.when(F.col("business_id") != "", _key(2, "currency", "business_id"))]
    keys = valid.select("record_id", F.explode(F.array_compact(F.array(*pairs))).alias("key"))
    windows = [r.window_ns for r in rules if r.one_to_many]
    if windows:  # anchors pass members on from one to the next, so the whole island counts
        lines = islands(valid.select("record_id", "currency", "ts_ns"), ["currency"], max(windows))
        keys = keys.union(lines.select("record_id", _key(3, "currency", "island")))
    return keys


def _within_reach(frontier: DataFrame, valid: DataFrame, rule: Rule) -> DataFrame:
    """(record_id) of records that the rule's tolerance phase may pair with one of ``frontier``: an equi-join on currency, time and amount buckets."""
    side = REACHED
    bucket = matching._value_buckets(F.col("amount_minor"), rule.amount.absolute, rule.amount.bps)
    keyed = lambda df: df.select(*side, time_bucket(F.col("ts_ns"), rule.window_ns).alias("_time"), (F.lit(0).cast("long") if bucket is None else bucket).alias("_value"))
    a = keyed(frontier)
    for column, near in (("_time", rule.window_ns > 0), ("_value", bucket is not None)):
        if near:
            a = a.withColumn(column, F.explode(F.array(*[F.col(column) + k for k in AROUND])))
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in side], "_time", "_value")
    cell = F.xxhash64("currency", "_time", "_value").alias("_cell")
    b = among(keyed(valid).select("*", cell), a.select(F.xxhash64("l_currency", "_time", "_value").alias("_cell")).distinct()).drop("_cell")
    both = b.join(a, ["_time", "_value"]).where((F.col("currency") == F.col("l_currency")) & (F.col("role") != F.col("l_role")) & (F.abs(F.col("ts_ns") - F.col("l_ts_ns")) <= rule.window_ns))
    ok = money.within(F.abs(F.col("amount_minor") - F.col("l_amount_minor")), money.tolerance_base(F.col("amount_minor"), F.col("l_amount_minor")), rule.amount.absolute, rule.amount.bps)
    return both.where(ok).select("record_id")


def touched(valid: DataFrame, late: DataFrame, rules: list[Rule]) -> DataFrame:
    """(record_id): the late records and all that are tied to them through shared ids or contents, candidate pairs and, with one-to-many rules, time islands.

    No phase of any rule lets a record outside decide on one inside. A round joins what
    the last one found with the records' keys, of which only those that can be met are shuffled; rounds are as many as the longest tie.
    """
    keys = cut(_shared_keys(valid, rules))
    frontier = cut(valid.join(late.select("record_id"), "record_id", "left_semi").select("record_id").distinct())
    found = frontier
    while not frontier.isEmpty():
        shared = cut(among(keys, frontier).join(frontier, "record_id", "left_semi").select("key").distinct())
        near = [among(keys, shared).join(shared, "key", "left_semi").select("record_id")]
        at = cut(among(valid.select(*REACHED), frontier).join(frontier, "record_id", "left_semi"))
        near += [_within_reach(at, valid, r) for r in rules]
        frontier = cut(reduce(DataFrame.union, near).distinct().join(found, "record_id", "left_anti"))
        found = found.union(frontier)
    return cut(found)


def _ways(rules: list[Rule]) -> list[tuple[Column, bool]]:
    """How leftovers look for counterparts: (a bucket, whether its neighbours count too) of time and of value for every rule that judges some role."""
    out, judged = [], set()
    for rule in [*rules, Rule("none", ROLES)]:
        if set(rule.allowed_roles) <= judged:
            continue
        judged |= set(rule.allowed_roles)
        amount, fee = (matching._value_buckets(F.col(c), t.absolute, t.bps) for c, t in (("amount_minor", rule.amount), ("fee_minor", rule.fee)))
        value = amount if amount is not None else fee
        out += [(time_bucket(F.col("ts_ns"), rule.window_ns), rule.window_ns > 0), (F.lit(0).cast("long") if value is None else value, value is not None)]
    return out


def _that_see(rows: DataFrame, others: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` that one of ``others`` could be a counterpart of, or the other way round, and maybe some more, each once. Hashes of the keys of ``others`` are sent to the rows, which stay where they are."""
    ways = _ways(rules)
    out = rows
    for i, (bucket, wide) in enumerate(ways):
        key = F.explode(F.array(*[bucket + k for k in AROUND])) if wide else bucket
        keys = others.select("currency", key.alias("_key")).select(F.xxhash64("currency", "_key").alias("_k")).distinct()
        out = marked(out.withColumn("_k", F.xxhash64("currency", bucket)), keys, f"_hit{i}").drop("_k")
    return out.where(reduce(lambda x, y: x | y, [F.col(f"_hit{i}") for i in range(len(ways))])).select(*rows.columns)


def late_batch(previous: engine.Result, records: DataFrame, late: DataFrame, rules: list[Rule], emit_invalid: bool = False) -> engine.Result:
    """The result of a run over ``records`` and ``late`` together, from the ``previous`` result over ``records`` alone.

    ``records`` and ``late`` are written tables, all of the first and of the second; ``rules`` are those of the previous run. Records that
    the late ones touch are matched again as a run of their own, and their groups, duplicates and discrepancies take the
    place of the old ones. Leftovers elsewhere are judged again only where a late record, or one whose
    duplicates changed, could be their counterpart. An empty late batch gives the previous rows.
    """
    everyone = records.unionByName(late)
    valid = everyone.where(~F.col("isolated"))
    inside = touched(valid, late, rules)
    again = cut(among(everyone, inside).join(inside, "record_id", "left_semi"))
    m = engine.match(again, rules)

    outside = lambda df, of: without(df.withColumn("_in", of), inside.withColumnRenamed("record_id", "_in")).drop("_in")
    subject = F.col("record_ids")[0]
    groups = engine.union([outside(previous.groups, subject), *m.groups])
    duplicates = outside(previous.duplicates, F.col("canonical_id")).unionByName(m.duplicates)
    kept = outside(previous.discrepancies, subject)

    everyone_active = dedup.without_excluded(valid, duplicates)
    left = kept.where(~F.col("type").isin(*SETTLED)).select(subject.alias("record_id"))
    changed = again.where(~F.col("isolated"))
    side = everyone_active.select(*matching._SIDE)
    elsewhere = cut(among(_that_see(side, changed, rules), left).join(left, "record_id", "left_semi"))
    judged = cut(m.free.select(*matching._SIDE).unionByName(elsewhere))
    fresh = matching.classify(judged, _that_see(side, judged, rules), rules)
    settled = F.col("type").isin(*SETTLED)
    kept = kept.where(settled).unionByName(without(kept.where(~settled).withColumn("_again", subject), elsewhere.select(F.col("record_id").alias("_again"))).drop("_again"))
    parts = [kept, *m.discrepancies, cut(fresh)]
    if emit_invalid:
        parts.append(engine.invalid_records(late))
    seen = everyone_active.unionByName(everyone.where("isolated")) if emit_invalid else everyone_active
    return engine.Result(groups, engine.union(parts), duplicates, seen)
