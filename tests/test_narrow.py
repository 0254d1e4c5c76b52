"""Steps that move keys instead of records give the same rows where the keys are too many to be sent."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import lineage
from tallyweave.operators import dedup, matching
from tallyweave.plans.rules import Rule, Tolerance
from tallyweave.sources import payments

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def resent(spark):
    return lineage.cut(payments.resent(spark, SMALL))


def test_few_keys_or_many(spark, resent, monkeypatch):
    def all_of():
        relations = dedup.detect(resent, Rule(dup_policy={"exact_key": "exclude"}))
        active = dedup.without_excluded(resent, relations)
        groups = matching.exact_id_groups(active)
        claimed = groups.select(F.explode("record_ids").alias("record_id"))
        free = matching.without_exact(active, claimed, F.col("role") != "bank")
        plain = active.where("business_id = '' or role = 'bank'").union(active.where("business_id <> '' and role <> 'bank'").join(claimed, "record_id", "left_anti").select(*active.columns))
        assert sorted(map(tuple, free.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
        return [sorted(map(tuple, x.collect()), key=str) for x in (relations, active, free)]

    sent = all_of()
    monkeypatch.setattr(lineage, "FEW_KEYS", 0)
    assert all_of() == sent and all(sent)


@pytest.mark.parametrize("amount", [Tolerance(5), Tolerance(None, 50), Tolerance(0), Tolerance()])
def test_each_pair_meets_once_in_wide_cells(spark, amount):
    rng = random.Random(7)
    rows = [(f"r{i}", i % 3, rng.randint(-90, 90), rng.randint(-60, 60)) for i in range(240)]
    side = spark.createDataFrame(rows, "record_id string, role_rank int, amount_minor long, ts_ns long").withColumn("currency", F.lit("USD"))
    rule = Rule(amount=amount, window_ns=7)
    pairs = [(r.l_record_id, r.r_record_id) for r in matching._candidate_pairs(side, rule).collect()]
    assert len(pairs) == len(set(pairs))
    within = lambda a, b: (amount.absolute is None or abs(a - b) <= amount.absolute) and (amount.bps is None or abs(a - b) * 10000 <= amount.bps * abs(max(a, b)))
    want = {(x[0], y[0]) for x in rows for y in rows if x[1] < y[1] and abs(x[3] - y[3]) <= 7 and within(x[2], y[2])}
    assert want <= set(pairs) and want


def test_few_cells_a_record(spark):
    """A record goes to fewer cells than the nine neighbouring buckets."""
    rows = [(f"r{i}", 1, 17 * i, 31 * i) for i in range(2000)]
    side = spark.createDataFrame(rows, "record_id string, role_rank int, amount_minor long, ts_ns long").withColumn("currency", F.lit("USD"))
    plan = matching._candidate_pairs(side, Rule(amount=Tolerance(5), window_ns=7))
    tree = plan._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("Generate explode") == 3 and "array_distinct" in tree
