"""The three matching phases and the classification of leftovers, as joins, groups and windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, money, timeparse
from ..functions.lineage import cut, few
from ..plans.rules import Rule
from ..schema import ROLES
from .nearest import nearest_amount
from .rangejoin import HOUR_NS, floor_div, time_bucket
from .subset import first_subsets

GROUP_COLUMNS = ["match_group_id", "type", "anchor_role", "record_ids", "score_tuple", "amount_minor", "currency"]
DISC_COLUMNS = ["discrepancy_id", "type", "currency", "record_ids", "candidate_ids", "score_tuple", "note"]
MAX_ROUNDS = 12
FEW_EDGES = 200_000  # that one task may finish after the rounds


def _groups(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumns({"match_group_id": ids.group_id(F.col("record_ids")), "type": F.lit(kind)}).select(*GROUP_COLUMNS)


def _discrepancies(rows: DataFrame) -> DataFrame:
    """From type, currency, record_ids, note and, of ambiguous ones, candidate_ids and score_tuple."""
    named = F.concat(F.col("record_ids"), F.col("candidate_ids"))
    return rows.withColumn("discrepancy_id", ids.discrepancy_id(F.col("type"), named)).select(*DISC_COLUMNS)


def _none() -> Column:
    return F.array().cast("array<string>")


# Phase 1


def exact_id_groups(records: DataFrame) -> DataFrame:
    """Groups of records that share currency and business id over at least two roles: one record a role, that of the smallest stable key."""
    return exact_id_phase(records)[0]


ID = ["currency", "business_id"]


def _firsts(named: DataFrame, row: Column) -> DataFrame:
    places = [f"r{i}" for i in range(len(ROLES) + 1)]  # unknown roles share the last
    first = named.groupBy(*ID).agg(F.count("*").alias("n"), *[F.min(F.when(F.col("role_rank") == i, row)).alias(r) for i, r in enumerate(places)])
    held = F.sort_array(F.array_compact(F.array(*[F.col(f"{r}.record_id") for r in places])))
    return first.select(*ID, "n", held.alias("record_ids"), F.coalesce(*places)["amount_minor"].alias("amount_minor"))


def exact_id_phase(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(groups, left): what ``exact_id_groups`` gives, written, and the ids of records with a business id that no group holds, to be sent to all executors; None if they are many.

    Stable keys are looked at only where two records of a role share a business id, as long as such ids are few.
    """
    named = records.where(F.col("business_id") != "")
    whole = F.struct("stable_key", "source_line", "batch_ord", "record_id", "amount_minor")
    firsts = cut(_firsts(named, F.struct("record_id", "amount_minor")))
    several = F.col("n") > F.size("record_ids")
    crowded = few(firsts.where(several).select(*ID))
    if crowded is None:
        firsts = cut(_firsts(named, whole))
        chosen = None
    else:
        chosen = cut(_firsts(named.join(crowded, ID, "left_semi"), whole))
        firsts = firsts.where(~several).unionByName(chosen)
    zero = F.array(*[F.lit(0).cast("long")] * 4)
    groups = _groups(firsts.where(F.size("record_ids") >= 2).withColumns({"anchor_role": F.lit(None).cast("string"), "score_tuple": zero}), "exact_id")
    open_ = None if chosen is None else few(firsts.where(several | (F.size("record_ids") < 2)).select(*ID))
    if open_ is None:
        return groups, None
    held = chosen.where(F.size("record_ids") >= 2).select(F.explode("record_ids").alias("record_id"))
    return groups, few(named.join(open_, ID, "left_semi").select("record_id").join(F.broadcast(held), "record_id", "left_anti").distinct())


def without_exact(records: DataFrame, claimed: DataFrame, allowed: Column | None = None, left: DataFrame | None = None) -> DataFrame:
    """``records`` whose ids are not among the ``claimed`` ones of ``exact_id_groups`` over those of ``allowed``.

    Only records with a business id can be, and mostly few of those are left: their ids move
    instead of the records. ``left`` are these ids where ``exact_id_phase`` gave them.
    """
    asked = F.coalesce(F.col("business_id"), F.lit("")) != ""
    if allowed is not None:
        asked = asked & allowed
    if left is None:
        left = few(records.where(asked).select("record_id").join(claimed, "record_id", "left_anti").distinct())
    if left is None:
        return records.where(~asked).unionByName(records.where(asked).join(claimed, "record_id", "left_anti"))
    return records.join(left.withColumn("_left", F.lit(True)), "record_id", "left").where(~asked | F.col("_left")).select(*records.columns)


# Phase 2


def one_to_many(records: DataFrame, rule: Rule, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(groups, search-limit discrepancies) of anchors whose amount is a sum of records of the many role."""
    found = first_subsets(records, rule, written=written)
    zero = F.lit(0).cast("long")
    groups = _groups(found.where("kind = 'group'").withColumns({"anchor_role": F.lit(rule.one_to_many.anchor_role), "score_tuple": F.array(F.lit(2).cast("long"), F.col("diff"), zero, zero)}), "one_to_many")
    limits = _discrepancies(found.where("kind = 'limit'").withColumns({"type": F.lit("search_limit"), "candidate_ids": _none(), "score_tuple": F.array().cast("array<bigint>")}))
    return groups, limits


# Phase 3

EDGE_SIDE = ("record_id", "role_rank", "role", "stable_key", "source_line", "batch_ord", "currency", "amount_minor", "fee_minor", "ts_ns")


def _candidate_pairs(side: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (l_*, r_*; l of the lower role) within the window that may be within the amount's tolerance: an equi-join on currency, the left role, time and amount buckets.

    Buckets are joined by fours in time and by eights in amount, so that most right rows go to one cell alone instead of nine.
    """
    value = _value_buckets(F.col("amount_minor"), rule.amount.absolute, rule.amount.bps)
    exact = rule.amount.absolute == 0 or rule.amount.bps == 0 or value is None
    value = value if value is not None else F.lit(0).cast("long")
    keyed = side.withColumns({"_time": time_bucket(F.col("ts_ns"), rule.window_ns), "_value": value})
    a = keyed.where(F.col("role_rank") < len(ROLES) - 1)
    b = keyed.where(F.col("role_rank") < len(ROLES)).withColumn("_role", F.explode(F.filter(F.array(*map(F.lit, range(len(ROLES)))), lambda r: r < F.col("role_rank"))))
    for column, near, width in (("_time", rule.window_ns > 0, 4), ("_value", not exact, 8)):
        if near:
            b = b.withColumn(column, F.explode(F.array_distinct(F.array(*[floor_div(F.col(column) + k, width) for k in (-1, 1)]))))
            a = a.withColumn(column, floor_div(F.col(column), width))
    a = a.select(*[F.col(c).alias(f"l_{c}") for c in side.columns], "_time", "_value", F.col("role_rank").alias("_role"))
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in side.columns], "_time", "_value", "_role")
    on = [a["l_currency"] == b["r_currency"], *(a[c] == b[c] for c in ("_time", "_value", "_role")), F.abs(a["l_ts_ns"] - b["r_ts_ns"]) <= F.lit(rule.window_ns).cast("long")]
    return a.join(b, on).drop("_time", "_value", "_role")


def tolerance_candidates(records: DataFrame, rule: Rule) -> DataFrame:
    """Edges between records of different roles within the window and the tolerances: a_*, b_* and score_tuple; a has the lower role."""
    pairs = _candidate_pairs(cut(records.select(*EDGE_SIDE)), rule)
    amount, fee = F.abs(F.col("l_amount_minor") - F.col("r_amount_minor")), F.abs(F.col("l_fee_minor") - F.col("r_fee_minor"))
    ok = money.within(amount, money.tolerance_base(F.col("l_amount_minor"), F.col("r_amount_minor")), rule.amount.absolute, rule.amount.bps)
    if rule.fee.enabled:
        ok = ok & money.within(fee, money.tolerance_base(F.col("l_fee_minor"), F.col("r_fee_minor")), rule.fee.absolute, rule.fee.bps)
    score = F.array(F.lit(1).cast("long"), amount, F.abs(F.col("l_ts_ns") - F.col("r_ts_ns")), fee)
    kept = pairs.where(ok).withColumn("score_tuple", score)
    return kept.select(*[F.col(f"{p}_{c}").alias(f"{q}_{c}") for p, q in (("l", "a"), ("r", "b")) for c in ("record_id", "stable_key", "source_line", "batch_ord", "amount_minor")], F.col("l_currency").alias("currency"), "score_tuple")


def ambiguous(edges: DataFrame) -> DataFrame:
    """Records with two or more candidates at their best score: (record_id, currency, score_tuple, candidate_ids), candidates by stable key."""
    ends = edges.select(F.col("a_record_id").alias("record_id"), F.struct(F.col("b_stable_key"), F.col("b_source_line"), F.col("b_batch_ord"), F.col("b_record_id").alias("id")).alias("other"), "currency", "score_tuple")
    ends = ends.union(edges.select("b_record_id", F.struct("a_stable_key", "a_source_line", "a_batch_ord", F.col("a_record_id").alias("id")), "currency", "score_tuple"))
    scores = ends.select("record_id", "currency", "score_tuple").repartition("record_id").groupBy("record_id", "currency", "score_tuple").agg(F.count("*").alias("n"))
    best = scores.groupBy("record_id", "currency").agg(F.min(F.struct("score_tuple", "n")).alias("m")).where("m.n >= 2").select("record_id", "currency", "m.score_tuple")
    sent = few(best)
    tied = ends.join(best if sent is None else sent, ["record_id", "currency", "score_tuple"]).groupBy("record_id", "currency", "score_tuple").agg(F.sort_array(F.collect_list("other")).alias("o"))
    return tied.where(F.size("o") >= 2).select("record_id", "currency", "score_tuple", F.transform("o", lambda x: x["id"]).alias("candidate_ids"))


def _greedy(edges: pd.DataFrame) -> pd.DataFrame:
    used: set[str] = set()
    keep = []
    for i, (a, b) in enumerate(zip(edges["a_record_id"], edges["b_record_id"])):
        if a not in used and b not in used:
            used |= {a, b}
            keep.append(i)
    return edges.iloc[keep][["o"]]


def commit_tolerance(edges: DataFrame, tied: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Edges that a greedy pass in order of score and stable keys takes, edges at ambiguous records left out.

    The order is total, so the greedy pass equals repeatedly taking every edge that is the
    best of both its ends; every round takes the first edge that is left at least. Few rounds
    suffice but for contrived chains: once ``max_rounds`` have gone by and at most ``FEW_EDGES``
    edges are left, the sequential pass itself finishes them per currency. The order is written
    as a number of each edge once, so that rounds move ids and numbers only; the columns of the order but the score are left out.
    """
    gone = tied.select("record_id").distinct()
    sent = few(gone)
    gone = gone if sent is None else sent
    order = ("score_tuple", "a_stable_key", "b_stable_key", "a_source_line", "b_source_line", "a_batch_ord", "b_batch_ord", "a_record_id", "b_record_id")
    rest = edges.join(gone.withColumnRenamed("record_id", "a_record_id"), "a_record_id", "left_anti").join(gone.withColumnRenamed("record_id", "b_record_id"), "b_record_id", "left_anti")
    kept = [c for c in edges.columns if c not in order or c in ("score_tuple", "a_record_id", "b_record_id")]
    count = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = cut(rest.repartitionByRange(count, *order).sortWithinPartitions(*order).select(*kept, F.monotonically_increasing_id().alias("o")))
    rest = ranked.select("a_record_id", "b_record_id", "currency", "o")
    taken, rounds = None, 0
    while not rest.isEmpty() and (rounds < max_rounds or rest.count() > FEW_EDGES):
        rounds += 1
        best = rest.select(F.col("a_record_id").alias("n"), "o").union(rest.select("b_record_id", "o")).groupBy("n").agg(F.min("o").alias("o"))
        both = best.groupBy("o").agg(F.count("*").alias("n")).where("n = 2").select("o")
        won = cut(rest.join(both, "o", "left_semi").select("a_record_id", "b_record_id", "o"))
        taken = won.select("o") if taken is None else taken.unionByName(won.select("o"))
        ends = won.select(F.col("a_record_id").alias("n")).union(won.select("b_record_id"))
        rest = cut(rest.join(ends.withColumnRenamed("n", "a_record_id"), "a_record_id", "left_anti").join(ends.withColumnRenamed("n", "b_record_id"), "b_record_id", "left_anti").select(*rest.columns))
    if not rest.isEmpty():
        last = rest.groupBy("currency").applyInPandas(lambda e: _greedy(e.sort_values("o")), "o long")
        taken = last if taken is None else taken.unionByName(last)
    return (ranked.where("false") if taken is None else ranked.join(taken, "o", "left_semi")).select(*kept)


def tolerance_phase(records: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(groups, ambiguous discrepancies) of one-to-one matching within tolerances."""
    edges = cut(tolerance_candidates(records, rule))
    tied = cut(ambiguous(edges))
    won = commit_tolerance(edges, tied)
    pairs = won.select(F.sort_array(F.array("a_record_id", "b_record_id")).alias("record_ids"), F.col("a_amount_minor").alias("amount_minor"), "currency", "score_tuple", F.lit(None).cast("string").alias("anchor_role"))
    note = "two or more candidates tied at the best score; cannot auto-resolve"
    unclear = tied.select(F.lit("ambiguous").alias("type"), "currency", F.array("record_id").alias("record_ids"), "candidate_ids", "score_tuple", F.lit(note).alias("note"))
    return _groups(pairs, "tolerance"), _discrepancies(unclear)


# Leftovers


# Which counterpart a lone record of a role lacks first.
MISSING_FIRST = {"internal": ("processor", "bank"), "processor": ("internal", "bank"), "bank": ("processor", "internal")}


def missing_type(role: str, allowed: tuple[str, ...]) -> str:
    """The type that names the counterpart a lone record of ``role`` lacks."""
    for r in (*MISSING_FIRST.get(role, ROLES), *ROLES):
        if r != role and r in allowed:
            return f"missing_{r}"
    return f"missing_{role}" if role in ROLES else "missing_internal"


def _value_buckets(value: Column, absolute: int | None, bps: int | None) -> Column | None:
    """A bucket such that values within the tolerance are at most one apart; null where no bound helps."""
    if absolute is not None:
        return floor_div(value, absolute + 1)
    if bps == 0:
        return value
    if bps is not None and bps < 10000:
        # equal signs, and magnitudes within a factor of 1 - bps: logarithms within a width, widened against rounding
        width = -float(np.log1p(-bps / 10000)) * 1.0001
        log = F.floor(F.log(F.abs(value.cast("double"))) / F.lit(width)).cast("long")
        return F.when(value == 0, F.lit(-10).cast("long")).otherwise(F.when(value > 0, log).otherwise(-log - (1 << 40)))
    return None


def classify(leftovers: DataFrame, everyone: DataFrame, rules: list[Rule]) -> DataFrame:
    """One discrepancy for each leftover record: the first rule that allows its role judges it.

    ``everyone`` is what counterparts are looked for in, matched or not. Ties fall to the
    first in order of source, line and batch. The nearest amount among time-aligned records
    comes from a search without pairs; only records without any go on to the join on amount buckets.
    """
    out, done = None, set()
    anyone = Rule("none", ROLES)
    for rule in [*rules, anyone]:
        roles = [r for r in (rule.allowed_roles if rule is not anyone else ROLES) if r not in done]
        done |= set(roles)
        if roles:
            part = _classify(leftovers.where(F.col("role").isin(*roles)), everyone.where(F.col("role").isin(*rule.allowed_roles)), rule)
            out = part if out is None else out.unionByName(part)
    return _discrepancies(out)


_SIDE = ("record_id", "role", "currency", "scale", "external_id", "timestamp_raw", "ts_ns", "amount_minor", "fee_minor", "source_id", "source_line", "batch_ord")
_NEAR = ("record_id", "role", "currency", "ts_ns", "amount_minor", "fee_minor", "source_id", "source_line", "batch_ord")


def _classify(left: DataFrame, others: DataFrame, rule: Rule) -> DataFrame:
    left, others = left.select(*_SIDE), others.select(*_SIDE)
    amount, fee = F.abs(F.col("l_amount_minor") - F.col("r_amount_minor")), F.abs(F.col("l_fee_minor") - F.col("r_fee_minor"))
    apart = F.abs(F.col("l_ts_ns") - F.col("r_ts_ns"))
    amount_ok = money.within(amount, money.tolerance_base(F.col("l_amount_minor"), F.col("r_amount_minor")), rule.amount.absolute, rule.amount.bps)
    fee_ok = money.within(fee, money.tolerance_base(F.col("l_fee_minor"), F.col("r_fee_minor")), rule.fee.absolute, rule.fee.bps) if rule.fee.enabled else F.lit(True)
    place = F.struct("r_source_id", "r_source_line", "r_batch_ord", "r_record_id")
    seen = F.struct(F.col("r_record_id").alias("record_id"), F.col("r_role").alias("role"), F.col("r_timestamp_raw").alias("timestamp_raw"), F.col("r_amount_minor").alias("amount_minor"), F.col("r_fee_minor").alias("fee_minor"), amount.alias("amount_diff"), fee.alias("fee_diff"), apart.alias("apart"), amount_ok.alias("amount_ok"), fee_ok.alias("fee_ok"))
    left = cut(left)
    near = nearest_amount(left, others.select(*_NEAR), rule.window_ns).select(F.col("asker").alias("l_record_id"), *[F.col(f"t.{c}").alias(f"r_{c}") for c in _NEAR])
    near = near.withColumn("r_timestamp_raw", F.lit(None).cast("string"))  # no note of these needs it
    pairs = left.select(*[F.col(c).alias(f"l_{c}") for c in _SIDE]).join(near, "l_record_id", "left")
    known = cut(pairs.select(*[F.col(f"l_{c}").alias(c) for c in _SIDE], F.when(F.col("r_record_id").isNotNull(), seen).alias("t")))
    alone = known.where("t is null").drop("t")
    far = _amount_aligned(alone, others, rule, amount_ok & fee_ok)
    far = far.where("l_role <> r_role and l_record_id <> r_record_id").groupBy(F.col("l_record_id").alias("record_id")).agg(F.min_by(seen, F.struct(apart, place)).alias("a"))
    x = known.join(far, "record_id", "left")
    missing = F.lit("missing_internal")
    for r in ROLES:
        missing = F.when(F.col("role") == r, missing_type(r, rule.allowed_roles)).otherwise(missing)
    kind = F.when(F.col("t").isNotNull() & ~F.col("t.amount_ok"), "amount_mismatch").when(F.col("t").isNotNull() & ~F.col("t.fee_ok"), "fee_mismatch").when(F.col("t").isNull() & F.col("a").isNotNull(), "time_mismatch").otherwise(missing)
    x = x.withColumn("type", kind).withColumn("c", F.when(F.col("type") == "time_mismatch", F.col("a")).when(F.col("type").isin("amount_mismatch", "fee_mismatch"), F.col("t")))
    text = lambda c: money.render(c, F.coalesce("scale", F.lit(2)))
    note = (
        F.when(F.col("type") == "amount_mismatch", F.concat(F.lit("amounts differ by "), F.col("c.amount_diff").cast("string"), F.lit(" minor units: "), "role", F.lit("="), text(F.col("amount_minor")), F.lit(" "), F.col("c.role"), F.lit("="), text(F.col("c.amount_minor"))))
        .when(F.col("type") == "fee_mismatch", F.concat(F.lit("fees differ by "), F.col("c.fee_diff").cast("string"), F.lit(" minor units: "), "role", F.lit("="), text(F.col("fee_minor")), F.lit(" "), F.col("c.role"), F.lit("="), text(F.col("c.fee_minor"))))
        .when(F.col("type") == "time_mismatch", F.concat(F.lit("timestamps differ by "), timeparse.render_duration(F.col("c.apart")), F.lit(": "), "role", F.lit("="), "timestamp_raw", F.lit(" "), F.col("c.role"), F.lit("="), F.col("c.timestamp_raw")))
        .otherwise(F.concat(F.lit("no counterpart found for "), "role", F.lit(" record "), "external_id"))
    )
    return x.select("type", "currency", F.when(F.col("c").isNotNull(), F.array("record_id", "c.record_id")).otherwise(F.array("record_id")).alias("record_ids"), _none().alias("candidate_ids"), F.array().cast("array<bigint>").alias("score_tuple"), note.alias("note"))


def _amount_aligned(alone: DataFrame, others: DataFrame, rule: Rule, ok: Column) -> DataFrame:
    """Pairs of one currency and two roles within the tolerances at any time, the nearest in time among them. Buckets of the amount, or else of the fee, make it an equi-join.

    What is joined are the different values of both sides, not records, so a common amount forms no pairs: a record asks for
    the nearest in time of each role and value within its tolerances.
    """
    values = [c for c, tolerance in (("amount_minor", rule.amount), ("fee_minor", rule.fee)) if tolerance.enabled]
    for column, tolerance in (("amount_minor", rule.amount), ("fee_minor", rule.fee)):
        bucket = _value_buckets(F.col(column), tolerance.absolute, tolerance.bps)
        if bucket is not None:
            keys = ["currency", "role", *values]
            asked = cut(alone.select(*keys, bucket.alias("_own")).distinct()).withColumn("_v", F.explode(F.array(*[F.col("_own") + k for k in (-1, 0, 1)]))).drop("_own")
            near = few(asked.select("currency", "_v").distinct())
            near = asked.select("currency", "_v").distinct() if near is None else near
            others = others.withColumn("_v", bucket).join(near, ["currency", "_v"], "left_semi")
            a = asked.select(*[F.col(c).alias(f"l_{c}") for c in keys], "_v")
            b = others.select(*keys, "_v").distinct().select(*[F.col(c).alias(f"r_{c}") for c in keys], "_v")
            met = cut(a.join(b, (a["l_currency"] == b["r_currency"]) & (a["_v"] == b["_v"]) & (a["l_role"] != b["r_role"])).where(ok).drop("_v"))
            kept = few(met.select(*[F.col(f"r_{c}").alias(c) for c in keys]).distinct())
            if kept is not None:
                others = others.join(kept, keys, "left_semi")
            mine = alone.select(*[F.col(c).alias(f"l_{c}") for c in keys], "ts_ns", F.struct("record_id", "role", "ts_ns", "amount_minor", "fee_minor").alias("_l"))
            asking = mine.join(met, [f"l_{c}" for c in keys]).select(*[F.col(f"r_{c}").alias(c) for c in keys], "ts_ns", "_l")
            return _nearest_of(asking, others.drop("_v"), keys)
    if not rule.amount.enabled and not rule.fee.enabled:
        return _nearest_in_time(alone, others)
    if not rule.fee.enabled:
        return _amount_aligned_by_sign(alone, others, rule, ok)
    # only both tolerances at a hundred percent and more: no bucket bounds what is within
    return _sides(alone, others, F.lit(0)).where(ok)


def _sides(alone: DataFrame, others: DataFrame, left_key: Column, right_key: Column | None = None) -> DataFrame:
    a = alone.select(*[F.col(c).alias(f"l_{c}") for c in alone.columns], left_key.alias("_v"))
    b = others.select(*[F.col(c).alias(f"r_{c}") for c in others.columns], (left_key if right_key is None else right_key).alias("_v"))
    return a.join(b, (a["l_currency"] == b["r_currency"]) & (a["_v"] == b["_v"])).drop("_v")


def _amount_aligned_by_sign(alone: DataFrame, others: DataFrame, rule: Rule, ok: Column) -> DataFrame:
    """Pairs within a percentage of a hundred or more, which is taken of the larger signed amount.

    Two amounts of zero or more are always within it; two negative ones have magnitudes
    within a factor; a negative and a positive one are looked at only beyond a hundred percent.
    """
    positive = F.col("amount_minor") >= 0
    out = _nearest_in_time(alone.where(positive), others.where(positive))
    width = float(np.log1p(rule.amount.bps / 10000)) * 1.0001
    bucket = F.floor(F.log(F.abs(F.col("amount_minor").cast("double"))) / F.lit(width)).cast("long")
    steps = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: bucket + k))
    spread = alone.where(~positive).select("*", steps.alias("_b"))
    both = _sides(spread, others.where(~positive), F.col("_b"), bucket).drop("l__b").where(ok)
    out = out.unionByName(both)
    if rule.amount.bps > 10000:
        out = out.unionByName(_sides(alone.where(positive), others.where(~positive), F.lit(0)).where(ok)).unionByName(_sides(alone.where(~positive), others.where(positive), F.lit(0)).where(ok))
    return out


def _nearest_in_time(alone: DataFrame, others: DataFrame) -> DataFrame:
    """Without any tolerance: for each record the nearest ones of each role before and after, in order of time."""
    return _nearest_of(alone.select("currency", "ts_ns", F.struct(*alone.columns).alias("_l")), others, ["currency"])


def _nearest_of(asking: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """For each row of ``asking`` (keys, ts_ns, _l) the nearest others of its keys and of each role before and after, in order of time.

    Of others at one time the first in order of source, line and batch stands for all. Windows
    run over an hour of the keys; from other hours come their first and last records, of
    which only one an hour is sorted for all of a currency, or of whatever else the keys are.
    """
    place = F.struct("source_id", "source_line", "batch_ord", "record_id")
    single = others.groupBy(*dict.fromkeys([*keys, "ts_ns", "role"])).agg(F.min_by(F.struct(*others.columns), place).alias("_r"))
    both = asking.unionByName(single, allowMissingColumns=True).withColumn("_hour", floor_div(F.col("ts_ns"), HOUR_NS))
    mine = [F.col("_r")] if "role" in keys else [F.when(F.col("role") == r, F.col("_r")) for r in ROLES]
    at = [F.when(v.isNotNull(), F.col("ts_ns")) for v in mine]
    ends = [pick(v, t).alias(f"{name}{i}") for name, pick in (("_last", F.max_by), ("_first", F.min_by)) for i, (v, t) in enumerate(zip(mine, at))]
    hours = both.groupBy(*keys, "_hour").agg(*ends)
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(f"{end}{i}", True).over(over).alias(f"{name}{i}") for name, end, over in (("_before", "_last", earlier), ("_after", "_first", later)) for i in range(len(mine))]
    x = both.join(hours.select(*keys, "_hour", *carried), [*keys, "_hour"])
    up = Window.partitionBy(*keys, "_hour").orderBy("ts_ns").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "_hour").orderBy(F.desc("ts_ns")).rangeBetween(Window.unboundedPreceding, 0)
    found = [F.coalesce(F.last(v, True).over(over), f"{name}{i}") for name, over in (("_before", up), ("_after", down)) for i, v in enumerate(mine)]
    x = x.withColumn("_near", F.array_compact(F.array(*found))).where("_l is not null").withColumn("_n", F.explode("_near"))
    return x.select("_l", "_n").select(*[F.col(f"_l.{c}").alias(f"l_{c}") for c in asking.schema["_l"].dataType.names], *[F.col(f"_n.{c}").alias(f"r_{c}") for c in others.columns])
