"""Feeds through the ledger to the report."""

import json

import pytest

from tallyweave.plans.rules import DEFAULT_RULE, RuleSet
from tallyweave.sources.feeds import Source
from tallyweave.sources.ledger import Conflict, Fault, Ledger
from tallyweave.streaming.arrivals import ingest_stream

HEAD = "external_id,amount,timestamp,fee,direction,business_id\n"


def line(ext, amount, at, direction, bid):
    return f"{ext},{amount},2026-01-02T03:{at}Z,0.00,{direction},{bid}\n"


FEEDS = {
    "internal": HEAD + line("INT001", "100.00", "04:05", "credit", "BIZ100") + line("INT002", "50.00", "05:05", "credit", "BIZ050") + line("INT003", "75.00", "06:05", "credit", "BIZ075") + line("INT004", "200.00", "07:05", "debit", "BIZ200") + line("INT005", "30.00", "08:05", "credit", "BIZ030") + line("INT006", "88.88", "09:05", "credit", "BIZAMBIG"),
    "processor": HEAD + line("PRC001", "100.00", "04:06", "credit", "BIZ100") + line("PRC002", "50.05", "05:06", "credit", "BIZ050") + line("PRC003", "75.00", "06:30", "credit", "BIZ075") + line("PRC004", "205.00", "07:06", "debit", "BIZ200") + line("PRC005", "30.00", "08:06", "credit", "BIZ030") + line("PRC006a", "88.88", "09:06", "credit", "") + line("PRC006b", "88.88", "09:06", "credit", ""),
    "bank": HEAD + line("BNK001", "100.00", "04:10", "credit", "BIZ100") + line("BNK002", "50.00", "05:10", "credit", "BIZ050") + line("BNK003", "75.00", "06:40", "credit", "BIZ075") + line("BNK004", "200.00", "07:10", "debit", "BIZ200"),
}
# The identifiers that these feeds must give.
GROUPS = ["mg_0501d42fc6659c13", "mg_2d3c8b5caca94b0f", "mg_55778722fef7707a", "mg_8734df4e7f45d4b8", "mg_97ccdaf9f76f4d4a"]
DISCREPANCIES = ["disc_d8eab2bb9df1c438", "disc_319417cbeb0245fb", "disc_2877dfe9a5def9a3"]


def ledger(spark, tmp_path, **kw):
    out = Ledger(spark, str(tmp_path / "ledger"), "2026-01-02T03:04:05Z", **kw)
    for role in FEEDS:
        out.add_source(Source(role, role))
        (tmp_path / f"{role}.csv").write_text(FEEDS[role])
    out.put_ruleset(RuleSet((DEFAULT_RULE,), 1))
    return out


def test_golden_run(spark, tmp_path):
    led = ledger(spark, tmp_path)
    ids = [led.submit_batch(r, str(tmp_path / f"{r}.csv"), f"k-{r}", batch_id=f"b-{r}") for r in FEEDS]
    led.start_run("run1", ids)
    text = led.report("run1")
    report = json.loads(text)
    assert [g["match_group_id"] for g in report["match_groups"]] == GROUPS
    assert [d["discrepancy_id"] for d in report["discrepancies"]] == DISCREPANCIES
    assert [d["type"] for d in report["discrepancies"]] == ["ambiguous", "missing_internal", "missing_internal"]
    assert report["match_groups"][0]["members"][0] == {"record_id": "rec_c304f764f3a137d0", "role": "processor", "external_id": "PRC001", "amount": "100.00", "currency": "USD", "timestamp_utc": "2026-01-02T03:04:06Z"}
    assert report["discrepancies"][0]["sort_key"] == "USD|ambiguous|internal|INT006|ef138f47e296f0d6"
    assert [c["record_id"] for c in report["discrepancies"][0]["evidence"][0]["candidates"]] == ["rec_900acee0584356ec", "rec_a8a42ef7c7812d97"]
    s = report["summary"]
    assert (s["matched_count"], s["matched_amount_minor"]) == (5, 45500)
    assert s["discrepancy_counts"] == {"ambiguous": 1, "missing_internal": 2} and s["discrepancy_amounts"] == {"ambiguous": 8888, "missing_internal": 17776}
    assert s["by_currency"]["USD"]["matched_amount_minor"] == 45500
    assert led.report("run1") == text
    rows = led.report("run1", "csv").splitlines()
    assert rows[0] == "discrepancy_id,type,currency,note,evidence_record_ids,sort_key" and rows[-1] == "# summary matched=5 matched_amount_minor=45500 discrepancies=3 rule_revision=1"
    with pytest.raises(Conflict):
        led.start_run("run1", ids)
    with pytest.raises(Conflict):
        led.cancel_run("run1")


def test_idempotency_policies_and_faults(spark, tmp_path):
    led = ledger(spark, tmp_path)
    path = str(tmp_path / "internal.csv")
    first = led.submit_batch("internal", path, "k")
    assert led.submit_batch("internal", path, "k") == first
    with pytest.raises(Conflict):
        led.submit_batch("internal", str(tmp_path / "bank.csv"), "k")
    again = led.submit_batch("internal", path, "k2")
    assert led.retransmits(again).count() == 6 and led.retransmits(first).count() == 6
    (tmp_path / "bad.csv").write_text(HEAD + line("X", "1", "00:00", "credit", "") + line("", "1", "00:00", "credit", ""))
    atomic = led.submit_batch("internal", str(tmp_path / "bad.csv"), "k3", "atomic")
    isolate = led.submit_batch("internal", str(tmp_path / "bad.csv"), "k4")
    states = {r.id: (r.status, json.loads(r.detail)) for r in led.batches().collect()}
    assert states[atomic][0] == "failed" and states[isolate][0] == "committed"
    assert (states[isolate][1]["valid_count"], states[isolate][1]["invalid_count"]) == (1, 1)
    with pytest.raises(ValueError):
        led.start_run("r", [atomic])
    led.faults = ("staging_commit",)
    with pytest.raises(Fault):
        led.submit_batch("bank", str(tmp_path / "bank.csv"), "k5")
    led.faults = ("result_commit",)
    with pytest.raises(Fault):
        led.start_run("r2", [first])
    assert led.run("r2").status == "failed"
    led.faults = ()
    assert led.submit_batch("bank", str(tmp_path / "bank.csv"), "k5")
    led._publish("run", "lost", "running")
    led.recover()
    assert led.run("lost").status == "failed"
    led._publish("run", "open", "running")
    led.cancel_run("open")
    assert led.run("open").status == "cancelled"


def test_stream_gives_the_batch_result(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text(FEEDS["internal"])
    for _ in range(2):
        q = ingest_stream(spark, str(folder), Source("internal", "internal"), str(tmp_path / "out"), str(tmp_path / "ck"), "*.csv", available_now=True)
        q.awaitTermination(60)
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.where("record_id = 'rec_d664452fc11d7c94'").count() == 1
