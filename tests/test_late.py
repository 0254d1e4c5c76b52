"""A run brought up to date after a late batch against a run over everything."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import lineage
from tallyweave.functions.ids import with_identity
from tallyweave.functions.lineage import cut
from tallyweave.plans import engine, late
from tallyweave.plans.rules import OneToMany, Rule, Tolerance
from tallyweave.schema import RECORD_COLUMNS, role_rank

S = 1_000_000_000
EXCLUDE = {"exact_key": "exclude", "retransmit": "report", "content_fingerprint": "report"}
ROLES = ("internal", "processor", "bank")
RULES = {
    "absolute": [Rule("a", ROLES, Tolerance(3), Tolerance(0), 20 * S, EXCLUDE)],
    "percent, then absolute": [Rule("p", ("internal", "bank"), Tolerance(None, 200), Tolerance(), 5 * S, EXCLUDE), Rule("a", ROLES, Tolerance(2), Tolerance(1), 30 * S)],
    "one to many": [Rule("m", ("bank", "processor"), Tolerance(0), Tolerance(), 8 * S, EXCLUDE, OneToMany("bank", "processor", 3), 50)],
    "no tolerance": [Rule("n", ("internal", "processor"), Tolerance(), Tolerance(), 2 * S)],
}


def frame(spark, n, seed):
    rng = random.Random(seed)
    flat = []
    for i in range(n):
        role = rng.choice(ROLES)
        # ids and contents repeat, so that duplicates, ambiguous records and changed canonical ones occur
        flat.append((role, role, f"E{rng.randint(0, n)}", rng.choice(["", "", f"B{rng.randint(0, n // 2)}"]), rng.randint(1, 400), rng.choice([0, 0, 1]), rng.choice(["USD", "EUR"]), rng.randint(0, 12 * n) * S, i, f"b{rng.randint(0, 2)}", rng.random() < 0.03))
    df = spark.createDataFrame(flat, "role string, source_id string, external_id string, business_id string, amount_minor long, fee_minor long, currency string, ts_ns long, source_line long, batch_id string, isolated boolean")
    fixed = {"batch_ord": F.lit(0), "direction": F.lit(""), "counterparty": F.lit(""), "memo": F.lit(""), "invalid_reason": F.when(F.col("isolated"), "amount: missing").otherwise(""), "timestamp_raw": F.col("ts_ns").cast("string"), "role_rank": role_rank(F.col("role")), "scale": F.lit(2)}
    return cut(with_identity(df.withColumns(fixed)).select([F.col(c).cast(t).alias(c) for c, t in RECORD_COLUMNS.items()]))


def rows(result):
    return {name: sorted(str([getattr(r, c) for c in sorted(r.asDict())]) for r in getattr(result, name).collect()) for name in ("groups", "discrepancies", "duplicates")}


@pytest.mark.parametrize("kind,seed", [(k, i) for i, k in enumerate(RULES)])
def test_late_batch_equals_a_full_run(spark, kind, seed):
    rules, everything = RULES[kind], frame(spark, 260, seed)
    is_late = F.col("source_line") % 9 == 4
    early, after = everything.where(~is_late), everything.where(is_late)
    before = engine.reconcile(early, rules, emit_invalid=True)
    got = rows(late.late_batch(before, early, after, rules, emit_invalid=True))
    assert got == rows(engine.reconcile(everything, rules, emit_invalid=True))
    assert got != rows(before) and all(got.values())


def test_nothing_late_changes_nothing(spark):
    rules, early = RULES["absolute"], frame(spark, 60, 9)
    before = engine.reconcile(early, rules)
    assert rows(late.late_batch(before, early, early.where("false"), rules)) == rows(before)


def test_only_what_a_late_record_is_tied_to_is_matched_again(spark):
    everything = frame(spark, 400, 5).where("not isolated")
    one = everything.orderBy("record_id").limit(1)
    inside = late.touched(everything, cut(one), RULES["absolute"]).count()
    assert 1 <= inside < 60


@pytest.mark.parametrize("most", [10**6, 0])
def test_rows_stay_where_keys_come_to_them(spark, monkeypatch, most):
    """Records that see others, or are outside a set, are told without a shuffle of records."""
    monkeypatch.setattr(lineage, "FEW_KEYS", most)
    monkeypatch.setattr(lineage, "BITS", 1 << 18)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        everything = frame(spark, 300, 3)
        some = everything.where("source_line % 60 = 0")
        seen = late._that_see(everything, some, RULES["absolute"])
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        at = lambda r: (r.currency, r.ts_ns // (20 * S), r.amount_minor // 4)
        others = [at(r) for r in some.collect()]
        want = {r.record_id for r in everything.collect() if any(c == at(r)[0] and (abs(b - at(r)[1]) < 2 or abs(v - at(r)[2]) < 2) for c, b, v in others)}
        got = [r.record_id for r in seen.collect()]
        assert want <= set(got) and len(got) <= everything.count() and (most == 0 or set(got) == want)
        ids = some.select("record_id")
        gone = {r.record_id for r in ids.collect()}
        assert sorted(r.record_id for r in lineage.outside(everything, ids).collect()) == sorted(r.record_id for r in everything.collect() if r.record_id not in gone)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
