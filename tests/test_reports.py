"""Reports written as files against those built on the driver; trees of digests against sets."""

import glob
import hashlib
import json
import random

import pytest

from tallyweave.operators import merkle, report
from tallyweave.plans import engine
from tallyweave.plans.rules import DEFAULT_RULE
from test_units import S, records


def result(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["internal", "processor", "bank"]), f'E"{i}, <&>', rng.choice(["", "", f"B{i // 3}"]), rng.choice([rng.randint(-3, 12), rng.randint(100, 5000)]), rng.randint(0, 500) * S) for i in range(120)]
    return engine.reconcile(records(spark, rows), [DEFAULT_RULE])


def text(path):
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_files_hold_the_report(spark, tmp_path):
    r = result(spark)
    assert {d.type for d in r.discrepancies.select("type").collect()} >= {"ambiguous", "amount_mismatch"}
    built = report.build(r, "run", "2026-01-02T03:04:05Z", 7, ["b2", "b1"])
    report.write_csv(r, f"{tmp_path}/csv", 7)
    assert text(f"{tmp_path}/csv") == report.to_csv(built)
    report.write_json(r, f"{tmp_path}/json", "run", "2026-01-02T03:04:05Z", 7, ["b2", "b1"])
    got = json.loads(text(f"{tmp_path}/json"))
    assert got == json.loads(report.to_json(built)) and list(got) == list(json.loads(report.to_json(built)))
    with pytest.raises(Exception, match="(?i)exists"):
        report.write_csv(r, f"{tmp_path}/csv", 7)


def test_report_of_nothing(spark, tmp_path):
    r = engine.reconcile(records(spark, []), [DEFAULT_RULE])
    report.write_json(r, f"{tmp_path}/json", "run", "t", 1, [])
    assert json.loads(text(f"{tmp_path}/json")) == json.loads(report.to_json(report.build(r, "run", "t", 1, [])))


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_differences_of_trees(spark, depth):
    rng = random.Random(depth)
    a = {(k, f"id{rng.randint(0, 400)}") for k in "xy" for _ in range(200)}
    b = {p for p in a if rng.random() > 0.03} | {("y", f"new{i}") for i in range(3)} | {("z", "alone")}
    frame = lambda s: spark.createDataFrame(sorted(s), "k string, id string")
    got = {(r.k, r.id, r.side) for r in merkle.differences(frame(a), frame(b), ["k"], depth).collect()}
    assert got == {(*p, "a") for p in a - b} | {(*p, "b") for p in b - a}
    roots = lambda s: {r.k: (r.n, r.digest) for r in merkle.roots(frame(s), ["k"], depth).collect()}
    assert roots(a) == roots(set(a)) and roots(a)["x"] != roots(b)["x"] and roots(a)["x"][0] == sum(k == "x" for k, _ in a)
    assert merkle.leaf_depth(256) == 0 and merkle.leaf_depth(257) == 1 and merkle.leaf_depth(10**9) == 6


@pytest.mark.parametrize("n", [0, 1, 700])
def test_digest_in_blocks_is_that_of_the_text(spark, monkeypatch, n):
    """No row gathers the ids of a run, and blocks end wherever they like."""
    monkeypatch.setattr(report, "BLOCK_IDS", 7)
    ids_ = lambda p, k: [(f"{p}_{random.Random(i).random()}", i) for i in range(k)]
    groups = spark.createDataFrame(ids_("mg", n), "match_group_id string, amount_minor long").repartition(3)
    found = spark.createDataFrame(ids_("disc", n // 2), "discrepancy_id string, n long")
    r = engine.Result(groups, found, None, None)
    got = report.short_digest(r, 3)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    (want,) = [hashlib.sha256(x.digest.encode()).hexdigest()[:16] for x in report.content_digest(r, 3).collect()]
    assert [x.digest for x in got.collect()] == [want]


def test_the_query_gathers_no_ids(spark):
    from oracle import DATA

    from tallyweave.plans import queries

    assert "collect_list" not in queries.report_digest(spark, DATA)._jdf.queryExecution().toString()
