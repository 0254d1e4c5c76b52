"""Cases of parsing, rounding, tolerances, timestamps, feeds, duplicates and matching."""

import itertools
import json
import random
import re
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import money, timeparse
from tallyweave.operators import dedup, matching
from tallyweave.operators.rangejoin import islands, last_mark, range_join
from tallyweave.plans import engine
from tallyweave.plans.rules import DEFAULT_RULE, OneToMany, Rule, Tolerance, ruleset_from_document
from tallyweave.schema import RECORD_SCHEMA
from tallyweave.functions.ids import with_identity
from tallyweave.sources import feeds

S = 1_000_000_000


def parsed(spark, cases, mode="reject", scale=2):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return [tuple(r.p) for r in df.select("i", money.parse(F.col("t"), F.lit(scale), mode).alias("p")).orderBy("i").collect()]


def plain_parse(text, mode="reject", scale=2):
    """(minor, code) by Python's Decimal; half-even looks at the first discarded digit alone, and at scale 0 both half modes go away from zero."""
    t = (text or "").strip()
    if not t:
        return None, "empty_amount"
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)", t, re.ASCII):
        return None, "bad_format"
    with localcontext() as c:
        c.prec = 200
        size = abs(Decimal(t)).scaleb(scale)
        whole = int(size)
        rest = size - whole
        if rest and mode == "reject":
            return None, "too_many_digits"
        if mode != "trunc" and rest:
            tenth = int(rest * 10)
            whole += scale == 0 or tenth > 5 or (tenth == 5 and (mode == "half_up" or whole % 2 == 1))
        value = -whole if t.startswith("-") else whole
    return (value, None) if -(2**63) <= value < 2**63 else (None, "overflow")


def amounts(seed, n):
    """Texts of amounts in all spellings, good and bad, many around the limits."""
    rng = random.Random(seed)
    digits = lambda most: "".join(rng.choice("0123459") for _ in range(rng.randint(0, most)))
    out = [None, "", "  ", ".", "+", "-", "+.", "0" * 60 + "7", "8" * 45]
    for _ in range(n):
        t = rng.choice(["", "", "+", "-"]) + rng.choice([digits(4), digits(20), str(2**63 // 100 + rng.randint(-1, 1))]) + rng.choice(["", ".", "." + digits(3), "." + digits(6)])
        out.append(rng.choice(["", "", " ", "\t"]) + t + rng.choice(["", "", " ", rng.choice(["x", "e2", ",5", ".1", " 1", "-"])]))
    return out


def test_money_parsing_against_decimal(spark):
    for seed, mode, scale in [(1, "reject", 2), (2, "reject", 0), (3, "trunc", 2), (4, "half_up", 2), (5, "half_even", 2), (6, "half_up", 0), (7, "half_even", 0), (8, "half_even", 3)]:
        cases = amounts(seed, 400)
        got = parsed(spark, cases, mode, scale)
        assert got == [plain_parse(t, mode, scale) for t in cases]
        assert {c for _, c in got} >= {None, "empty_amount", "bad_format", "overflow"} and (mode != "reject" or "too_many_digits" in {c for _, c in got})


def test_odd_rounding_rules(spark):
    # what the rules say where usual rounding says otherwise
    assert parsed(spark, ["7.6251", "7.6351"], "half_even") == [(762, None), (764, None)]
    assert parsed(spark, ["31.01", "-31.01", "31.00"], "half_even", 0) == [(32, None), (-32, None), (31, None)]


def test_rendering_is_parsing_backwards(spark):
    rng = random.Random(9)
    values = [(v, s) for s in (0, 1, 2, 3) for v in [0, 1, -1, -(2**63), 2**63 - 1, *(rng.randint(-(10**n), 10**n) for n in range(1, 18))]]
    df = spark.createDataFrame(values, "v long, s int").withColumn("t", money.render(F.col("v"), F.col("s")))
    for r in df.withColumn("back", money.parse(F.col("t"), F.col("s"))).collect():
        assert r.back.minor == r.v and len(r.t.partition(".")[2]) == r.s and Decimal(r.t) == Decimal(r.v).scaleb(-r.s)


def test_tolerance(spark):
    cases = [(5, None, 5, 0, True), (5, None, 6, 0, False), (None, 50, 5, 1000, True), (None, 50, 6, 1000, False), (5, 50, 5, 1000, True), (5, 50, 6, 1000, False), (5, 50, 2, 200, False), (5, 50, 1, 200, True), (None, None, 10**18, 0, True), (None, 50, 10**15, 2 * 10**17, True)]
    for a, b, diff, base, want in cases:
        assert spark.range(1).select(money.within(F.lit(diff).cast("long"), F.lit(base).cast("long"), a, b)).first()[0] is want
    assert [spark.range(1).select(money.compare_tolerance(F.lit(d).cast("long"), F.lit(1000).cast("long"), 5, 40)).first()[0] for d in (3, 4, 5)] == [-1, 0, 1]


def test_timestamps(spark):
    cases = [
        ("2026-01-02T03:04:05Z", "UTC", 1767323045 * S), ("2026-01-02T03:04:05.123456789Z", "UTC", 1767323045 * S + 123456789), ("2026-01-02T11:04:05+08:00", "UTC", 1767323045 * S),
        ("2026-01-02 09:00:00", "Asia/Shanghai", 1767315600 * S), ("2026-01-02T09:00:00.5", "Asia/Shanghai", 1767315600 * S + S // 2), ("2026-01-02", "Asia/Shanghai", 1767283200 * S),
        ("2026-01-02 07:00:00", "No/Where", 1767337200 * S), (" 2026-01-02T03:04:05Z ", "", 1767323045 * S), ("2026-01-02 03:04:05+08:00", "UTC", None), ("2026-1-2", "UTC", None),
        ("2026-13-02T03:04:05Z", "UTC", None), ("2026-02-30", "UTC", None), ("not-a-time", "UTC", None), ("1969-12-31T23:59:59.5Z", "UTC", -S // 2),
    ]
    row = spark.range(1).select(*[timeparse.parse_ns(F.lit(t), z) for t, z, _ in cases]).first()
    got = list(row)
    assert got == [c[2] for c in cases]
    shown = spark.createDataFrame([(1767323045 * S + 120_000_000,), (-S // 2,)], "n long").select(timeparse.render_ns(F.col("n"))).collect()
    assert [r[0] for r in shown] == ["2026-01-02T03:04:05.12Z", "1969-12-31T23:59:59.5Z"]
    spans = [(60 * S, "1m0s"), (S, "1s"), (3_723_500_000_000, "1h2m3.5s"), (250_000_000, "250ms"), (1_500, "1.5µs"), (7, "7ns"), (0, "0s")]
    assert [r[0] for r in spark.createDataFrame([(i, n) for i, (n, _) in enumerate(spans)], "i int, n long").orderBy("i").select(timeparse.render_duration(F.col("n"))).collect()] == [t for _, t in spans]


# Feeds


def read(spark, text, source=None, **kw):
    source = source or feeds.Source("s", "internal", **kw)
    files = spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")
    return feeds.parse_files(files, source, "b").orderBy("source_line").collect()


def test_csv_grammar():
    assert feeds.split_csv('a,b\r\n"x,1","say ""hi"""\rq"r,"ab"c\n\n') == [["a", "b"], ["x,1", 'say "hi"'], ['q"r', "abc"], [""]]
    assert feeds.split_csv("") == []
    assert feeds.split_csv('a\n""') == [["a"], [""]]
    with pytest.raises(feeds.FeedError):
        feeds.split_csv('a\n"b')


def test_csv_errors_in_order(spark):
    text = "external_id,amount,timestamp,direction,currency,fee\n" + "\n".join(["a,12.34,2026-01-02T03:04:05Z,Credit,,0.10", ",1,2026-01-02,credit,,", "c,,2026-01-02,credit,,", "d,1,2026-01-02,credit,XYZ,", "e,abc,2026-01-02,credit,,", "f,1.234,2026-01-02,credit,,", "g,1,2026-01-02,sideways,,", "h,1,,credit,,", "i,1,nope,credit,,", "j,1,2026-01-02,credit,,x", "", "k,5,2026-01-02,,jpy,,"]) + "\n"
    rows = read(spark, text)
    assert [(r.source_line, r.error.field if r.error else None, r.error.code if r.error else None) for r in rows] == [(1, None, None), (2, "external_id", "missing"), (3, "amount", "missing"), (4, "currency", "unknown_currency"), (5, "amount", "bad_format"), (6, "amount", "too_many_digits"), (7, "direction", "invalid"), (8, "timestamp", "missing"), (9, "timestamp", "invalid"), (10, "fee", "bad_format"), (11, "external_id", "missing"), (12, None, None)]
    assert (rows[0].amount_minor, rows[0].fee_minor, rows[0].direction, rows[11].amount_minor, rows[11].scale) == (1234, 10, "credit", 5, 0)
    assert rows[1].record_id == "rec_invalid_s_2" and rows[1].isolated and rows[1].stable_key == "internal|invalid|2"


def test_csv_short_rows_duplicate_headers_and_quotes(spark):
    rows = read(spark, 'external_id,amount,timestamp,memo,memo\n"TX,1",1,2026-01-02,first,"hello, ""world"""\nx,2\n')
    assert (rows[0].external_id, rows[0].memo) == ("TX,1", 'hello, "world"')
    assert rows[1].error.code == "missing" and rows[1].error.field == "timestamp"
    assert read(spark, "") == [] and read(spark, "external_id,amount\n") == []


def test_ndjson(spark):
    text = '{"external_id":"a","amount":"5.00","timestamp":"2026-01-02"}\n\n{"external_id":"b","amount":12345678.5,"timestamp":"2026-01-02","memo":true}\r\n{"external_id":"c","amount":0.0005,"timestamp":"2026-01-02"}\nnonsense\n[1]\n{"ref":"d"}'
    rows = read(spark, text, format="ndjson")
    assert [(r.source_line, r.amount_minor, r.error.code if r.error else None) for r in rows] == [(1, 500, None), (2, 1234567850, None), (3, 0, "too_many_digits"), (4, 0, "decode"), (5, 0, "decode"), (6, 0, "missing")]
    assert rows[1].memo == "true"
    mapped = feeds.Source("s", "bank", format="ndjson", field_map={"external_id": "ref.id"})
    assert read(spark, '{"ref.id":"z","amount":"1","timestamp":"2026-01-02"}', mapped)[0].external_id == "z"


# Duplicates and matching


def records(spark, rows, currency="USD"):
    """rows: (role, external_id, business_id, amount, seconds or ns, fee, batch, line)."""
    full = []
    for i, r in enumerate(rows):
        role, ext, bid, amount, at, fee, batch, line, *cur = (*r, *(None,) * (8 - len(r))) if len(r) < 8 else r
        full.append((role, role, batch or f"b-{role}", line if line is not None else i + 1, ext, bid or "", amount, fee or 0, cur[0] if cur else currency, at))
    df = spark.createDataFrame(full, "source_id string, role string, batch_id string, source_line long, external_id string, business_id string, amount_minor long, fee_minor long, currency string, ts_ns long")
    df = df.withColumns({"role_rank": F.when(F.col("role") == "internal", 0).when(F.col("role") == "processor", 1).otherwise(2), "batch_ord": F.when(F.col("batch_id") == "b2", 1).otherwise(0), "scale": F.lit(2), "direction": F.lit("credit"), "counterparty": F.lit(""), "memo": F.lit(""), "timestamp_raw": F.col("ts_ns").cast("string"), "isolated": F.lit(False), "invalid_reason": F.lit("")})
    return with_identity(df).select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in RECORD_SCHEMA.split(", ")])


def run(spark, rows, *rules):
    r = engine.reconcile(records(spark, rows), list(rules or [DEFAULT_RULE]))
    return sorted((g.type, len(g.record_ids), tuple(g.score_tuple)) for g in r.groups.collect()), sorted(d.type for d in r.discrepancies.collect())


def test_duplicate_layers(spark):
    r = records(spark, [("internal", "A", "", 1, S), ("internal", "A", "", 2, S), ("internal", "B", "", 5, S), ("internal", "C", "", 5, S), ("processor", "P", "", 1, S, 0, "b1", 7), ("processor", "P", "", 1, S, 0, "b2", 8)])
    found = {(x.dup_type, x.source_id) for x in dedup.detect(r, DEFAULT_RULE).collect()}
    assert found == {("exact_key", "internal"), ("content_fingerprint", "internal"), ("exact_key", "processor"), ("retransmit", "processor")}
    again = dedup.detect(r.orderBy(F.desc("source_line")), DEFAULT_RULE)
    assert {x.relation_id for x in again.collect()} == {x.relation_id for x in dedup.detect(r, DEFAULT_RULE).collect()}
    assert dedup.without_excluded(r, again).count() == 4


def test_resent_file_keeps_one_copy(spark):
    r = records(spark, [("internal", "A", "", 1, S, 0, "b1", 1), ("internal", "A", "", 1, S, 0, "b2", 1)])
    kept = dedup.without_excluded(r, dedup.detect(r, DEFAULT_RULE)).collect()
    assert [x.batch_id for x in kept] == ["b1"]


def test_exact_and_boundaries(spark):
    assert run(spark, [("internal", "I", "B1", 1, S), ("processor", "P", "B1", 999, 10**15), ("bank", "K", "B1", 3, S)]) == ([("exact_id", 3, (0, 0, 0, 0))], [])
    assert run(spark, [("internal", "I", "", 1000, S), ("processor", "P", "", 1005, S)])[0] == [("tolerance", 2, (1, 5, 0, 0))]
    assert run(spark, [("internal", "I", "", 1000, S), ("processor", "P", "", 1006, S)]) == ([], ["amount_mismatch"] * 2)
    assert run(spark, [("internal", "I", "", 1000, S), ("processor", "P", "", 1000, S, 5)]) == ([], ["fee_mismatch"] * 2)
    minute = Rule("r", amount=Tolerance(0), window_ns=60 * S)
    assert len(run(spark, [("internal", "I", "", 5, 0), ("processor", "P", "", 5, 60 * S)], minute)[0]) == 1
    assert run(spark, [("internal", "I", "", 5, 0), ("processor", "P", "", 5, 60 * S + 1)], minute) == ([], ["time_mismatch"] * 2)
    assert run(spark, [("internal", "I", "", 5, 0)]) == ([], ["missing_processor"])


def test_percent_and_unlimited_time_mismatch(spark):
    far = [("internal", "I", "", 1000, 0), ("processor", "P", "", 1005, 10**14), ("processor", "Q", "", 9, 10**13)]
    assert run(spark, far, Rule("p", amount=Tolerance(None, 50), window_ns=S)) == ([], ["missing_internal", "time_mismatch", "time_mismatch"])
    assert run(spark, far, Rule("u", window_ns=S)) == ([], ["time_mismatch"] * 3)


def test_ambiguity_claims_only_the_record(spark):
    g, d = run(spark, [("internal", "I", "", 100, S), ("processor", "P", "", 100, 2 * S), ("processor", "Q", "", 100, 2 * S)])
    assert (g, d) == ([], ["ambiguous", "missing_internal", "missing_internal"])


def many(limit=10_000, members=2, tolerance=Tolerance(0)):
    return Rule("m", ("bank", "processor"), tolerance, Tolerance(), 600 * S, {}, OneToMany("bank", "processor", members), limit)


def test_one_to_many(spark):
    rows = [("bank", "K", "", 100, S), ("processor", "P", "", 40, S), ("processor", "Q", "", 60, S)]
    assert run(spark, rows, many())[0] == [("one_to_many", 3, (2, 0, 0, 0))]
    five = [("bank", "K", "", 100, S), *[("processor", f"P{i}", "", 10, S) for i in range(5)]]
    assert "search_limit" in run(spark, five, many(limit=5, members=5))[1]
    exceed = [("bank", "K", "", 50, S), *[("processor", f"P{i}", "", 10, S) for i in range(5)]]
    r = engine.reconcile(records(spark, exceed), [many()])
    assert [x.note for x in r.discrepancies.where("type = 'search_limit'").collect()] == ["match requires more than max_members"]


def test_anchors_consume_members_in_order(spark):
    rows = [("bank", "K1", "", 30, S), ("bank", "K2", "", 30, S), ("processor", "P1", "", 10, S), ("processor", "P2", "", 20, S), ("processor", "P3", "", 20, S), ("processor", "P4", "", 10, S)]
    g, _ = run(spark, rows, many())
    assert g == [("one_to_many", 3, (2, 0, 0, 0))] * 2


def test_greedy_equals_mutual_best(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["internal", "processor", "bank"]), f"E{i}", "", rng.randint(0, 12), rng.randint(0, 40) * S) for i in range(150)]
    rule = Rule("g", amount=Tolerance(2), window_ns=3 * S)
    free = records(spark, rows)
    edges = matching.tolerance_candidates(free, rule)
    tied = matching.ambiguous(edges)
    skip = {r.record_id for r in tied.collect()}
    used, want = set(), set()
    for e in sorted(edges.collect(), key=lambda e: (list(e.score_tuple), e.a_stable_key, e.b_stable_key)):
        if not {e.a_record_id, e.b_record_id} & (skip | used):
            used |= {e.a_record_id, e.b_record_id}
            want.add((e.a_record_id, e.b_record_id))
    for rounds in (12, 1):
        assert {(e.a_record_id, e.b_record_id) for e in matching.commit_tolerance(edges, tied, rounds).collect()} == want


def test_range_join_and_islands(spark):
    rng = random.Random(5)
    rows = [(i, "x", rng.randint(-500, 500)) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, k string, ts_ns long")
    for w in (0, 7):
        got = {(r.l_i, r.r_i) for r in range_join(df, df, ["k"], w).collect()}
        assert got == {(a[0], b[0]) for a, b in itertools.product(rows, rows) if abs(a[2] - b[2]) <= w}
        cut = {r.i: r.island for r in islands(df, ["k"], w).collect()}
        ordered = sorted(rows, key=lambda r: r[2])
        for a, b in zip(ordered, ordered[1:]):
            assert (cut[a[0]] == cut[b[0]]) == (b[2] - a[2] <= w)


def test_run_ignores_order_and_partitions(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["internal", "processor", "bank"]), f"E{i}", rng.choice(["", "B1", "B2"]), rng.randint(90, 110), rng.randint(0, 600) * S, rng.choice([0, 0, 1]), None, i, rng.choice(["USD", "EUR"])) for i in range(80)]
    base = records(spark, rows)
    seen = set()
    for df in (base, base.repartition(7), base.orderBy(F.rand(1))):
        r = engine.reconcile(df, [DEFAULT_RULE])
        seen.add((tuple(sorted(x[0] for x in r.groups.select("match_group_id").collect())), tuple(sorted(x[0] for x in r.discrepancies.select("discrepancy_id").collect()))))
    assert len(seen) == 1


def test_empty_records(spark):
    r = engine.reconcile(spark.createDataFrame([], RECORD_SCHEMA), [DEFAULT_RULE])
    assert r.groups.count() == r.discrepancies.count() == r.duplicates.count() == 0


def test_rule_documents():
    doc = {"revision": 3, "rules": [{"rule_id": "a", "amount_tolerance": {"abs": 5, "pct_bps": 0}, "time_window_seconds": 120, "search_limit": 0}, {"rule_id": "b", "amount_tolerance": {"Abs": 1, "PctBps": 7}, "time_window_ns": 5}]}
    a, b = ruleset_from_document(json.loads(json.dumps(doc))).rules
    assert (a.amount, a.window_ns, a.search_limit) == (Tolerance(5, None), 120 * S, 10_000)
    assert (b.amount, b.window_ns) == (Tolerance(1, 7), 5)


def test_one_to_many_at_equal_times(spark):
    rows = []
    for i in range(60):
        at = (i * 1000 + 7) * S
        rows += [("bank", f"K{i}", "", 100 + i, at), ("processor", f"P{i}", "", 40, at), ("processor", f"Q{i}", "", 60 + i, at)]
    groups, limits = matching.one_to_many(records(spark, rows).repartition(5), many())
    assert groups.count() == 60 and limits.count() == 0


def test_percentages_of_a_hundred_and_more(spark):
    rng = random.Random(17)
    for bps in (10_000, 25_000):
        rows = [(rng.choice(["internal", "processor"]), f"E{i}", "", rng.choice([-300, -150, -100, -7, 0, 5, 90, 100, 200]), i * 10**13) for i in range(40)]
        r = engine.reconcile(records(spark, rows), [Rule("w", ("internal", "processor"), Tolerance(None, bps), Tolerance(), S)])
        named = {x.external_id: x.record_id for x in r.records.collect()}
        want = {}
        for role, ext, _, v, at in rows:
            near = [(abs(at - t), o, e) for o, e, _, w, t in rows if o != role and abs(v - w) * 10_000 <= bps * abs(max(v, w))]
            want[named[ext]] = min(near)[0] if near else None
        times = {named[e]: t for _, e, _, _, t in rows}
        for d in r.discrepancies.collect():
            best = want[d.record_ids[0]]
            assert (d.type == "time_mismatch") == (best is not None)
            assert best is None or abs(times[d.record_ids[0]] - times[d.record_ids[1]]) == best


def test_ndjson_lines_over_splits(spark, tmp_path):
    lines = [f'{{"external_id":"E{i}","amount":"{i}","timestamp":"2026-01-02"}}' if i % 5 else "  " for i in range(400)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.ndjson").write_bytes("\n".join(lines).encode() + b'\n{"external_id":"bad\xff","amount":"1","timestamp":"2026-01-02"}\r\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = feeds.read_feed(spark, str(tmp_path), feeds.Source("s", "bank", format="ndjson"), "b").select("source_line", "external_id", "record_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [x for x in lines if x.strip()]
    assert sorted(r.source_line for r in got) == sorted(2 * list(range(1, len(want) + 2)))
    assert all(r.external_id == (json.loads(want[r.source_line - 1])["external_id"] if r.source_line <= len(want) else "bad\ufffd") for r in got)


def test_report_is_frozen_once(spark, tmp_path):
    from tallyweave.operators import report

    r = engine.reconcile(records(spark, [("internal", "I", "", 5, 0), ("internal", "J", "B", 5, 0), ("bank", "K", "B", 5, 0)]), [DEFAULT_RULE])
    report.freeze(r, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report/groups")).count() == 1 and spark.read.parquet(str(tmp_path / "report/discrepancies")).count() == 1
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        report.freeze(r, str(tmp_path / "report"))


def test_candidates_of_one_minute_and_one_amount(spark):
    rng = random.Random(19)
    rows = [(rng.choice(["internal", "processor", "bank"]), f"E{i}", "", rng.choice([1000, 1000 + i]), rng.randint(0, 60) * S) for i in range(150)]
    for rule in (Rule("a", amount=Tolerance(3), window_ns=9 * S), Rule("b", amount=Tolerance(None, 40), window_ns=0), Rule("c", amount=Tolerance(0), window_ns=9 * S), Rule("d", window_ns=S)):
        got = sorted((e.a_record_id, e.b_record_id) for e in matching.tolerance_candidates(records(spark, rows), rule).collect())
        full = [(r.record_id, r.role_rank, r.amount_minor, r.ts_ns) for r in records(spark, rows).collect()]
        within = lambda a, b: (rule.amount.absolute is None or abs(a - b) <= rule.amount.absolute) and (rule.amount.bps is None or abs(a - b) * 10_000 <= rule.amount.bps * abs(max(a, b)))
        assert got == sorted((x[0], y[0]) for x in full for y in full if x[1] < y[1] and abs(x[3] - y[3]) <= rule.window_ns and within(x[2], y[2]))


def test_rounds_go_on_while_many_edges_are_left(spark, monkeypatch):
    # a chain whose edges get better along it: only its last edge is best at both ends, so each round takes one
    rows = [(("internal", "processor")[i % 2], f"E{i:02}", "", i * 100 - i * i, S) for i in range(16)]
    edges = matching.tolerance_candidates(records(spark, rows), Rule("c", ("internal", "processor"), Tolerance(99), Tolerance(), S))
    none = matching.ambiguous(edges).where("false")
    used, want = set(), set()
    for e in sorted(edges.collect(), key=lambda e: (list(e.score_tuple), e.a_stable_key, e.b_stable_key)):
        if not {e.a_record_id, e.b_record_id} & used:
            used |= {e.a_record_id, e.b_record_id}
            want.add((e.a_record_id, e.b_record_id))
    monkeypatch.setattr(matching, "FEW_EDGES", 0)
    assert len(want) > 3 and {(e.a_record_id, e.b_record_id) for e in matching.commit_tolerance(edges, none, 1).collect()} == want


def test_nearest_in_time_over_hours_and_ties(spark):
    rng = random.Random(23)
    rows = [(rng.choice(["internal", "processor", "bank"]), f"E{i}", "", 100 * i, rng.choice([rng.randint(0, 40) * 900 * S, rng.randint(0, 9) * 10**14]), 0, None, rng.randint(1, 9) * 1000 + i) for i in range(120)]
    all_of = records(spark, rows)
    got = {}
    pairs = matching._nearest_in_time(all_of, all_of).where("l_role <> r_role").collect()
    for p in pairs:
        key = (abs(p.l_ts_ns - p.r_ts_ns), p.r_source_id, p.r_source_line, p.r_batch_ord, p.r_record_id)
        got[p.l_record_id] = min(got.get(p.l_record_id, key), key)
    flat = all_of.collect()
    want = {a.record_id: min((abs(a.ts_ns - b.ts_ns), b.source_id, b.source_line, b.batch_ord, b.record_id) for b in flat if b.role != a.role) for a in flat}
    assert got == want


def test_subset_search_on_a_dense_time_line(spark):
    rng = random.Random(31)
    rows = [(rng.choice(["bank", "processor", "processor", "processor"]), f"E{i}", "", rng.randint(1, 40), rng.randint(0, 900) * S) for i in range(160)]
    rule = Rule("m", ("bank", "processor"), Tolerance(0), Tolerance(), 60 * S, {}, OneToMany("bank", "processor", 3), 10_000)
    rec = records(spark, rows)
    flat = sorted(rec.collect(), key=lambda r: (r.stable_key, r.source_line, r.batch_ord))
    taken, want = set(), set()
    for a in (r for r in flat if r.role == "bank"):
        near = [r for r in flat if r.role == "processor" and r.record_id not in taken and abs(r.ts_ns - a.ts_ns) <= rule.window_ns]
        for chosen in (c for n in (2, 3) for c in itertools.combinations(near, n)):
            if sum(r.amount_minor for r in chosen) == a.amount_minor:
                ids = {a.record_id, *(r.record_id for r in chosen)}
                taken |= ids
                want.add(tuple(sorted(ids)))
                break
    groups, _ = matching.one_to_many(rec, rule)
    assert len(want) > 5 and {tuple(r.record_ids) for r in groups.collect()} == want


def test_last_mark_over_hours(spark):
    rng = random.Random(41)
    at = lambda: rng.choice([rng.randint(0, 60), 10**6 + rng.randint(0, 60)]) * 600 * S
    rows = [(i, rng.choice("xyz"), at()) for i in range(150)]
    marks = list({(k, t): (k, t, n) for n, (k, t) in enumerate((rng.choice("xy"), at()) for _ in range(25))}.values())
    got = {r.i: r.mark.n if r.mark else None for r in last_mark(spark.createDataFrame(rows, "i long, k string, ts_ns long"), spark.createDataFrame(marks, "k string, ts_ns long, n long"), ["k"]).collect()}
    assert got == {i: max(((t, n) for key, t, n in marks if key == k and t <= ts), default=(0, None))[1] for i, k, ts in rows}


def test_members_between_anchors_do_not_chain_them(spark):
    # one member a second, an anchor every ten minutes: each anchor is on its own
    rows = [("processor", f"P{i}", "", 1000 + i, i * S) for i in range(0, 3600, 5)] + [("bank", f"K{i}", "", 2005 + 2 * i, i * S) for i in range(300, 3600, 600)]
    rule = Rule("m", ("bank", "processor"), Tolerance(0), Tolerance(), 20 * S, {}, OneToMany("bank", "processor", 2), 10_000)
    groups, limits = matching.one_to_many(records(spark, rows), rule)
    assert groups.count() == 6 and limits.count() == 0


def test_time_mismatch_of_one_common_amount(spark):
    rng = random.Random(41)
    rule = Rule("c", ("internal", "processor", "bank"), Tolerance(2), Tolerance(1), S)
    rows = [("internal", f"E{i}", "", rng.choice([1, 2, 3, 5]), rng.randint(0, 9999) * 7000 * S, rng.choice([0, 1, 2]), None, rng.randint(1, 9) * 1000 + i) for i in range(80)]
    rows += [(rng.choice(["processor", "bank"]), f"F{i}", "", rng.choice([1, 4, 6, 9]), rng.randint(0, 9999) * 7000 * S, rng.choice([0, 1, 3]), None, rng.randint(1, 9) * 1000 + i) for i in range(60)]
    both = records(spark, rows)
    amount, fee = (F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) for c in ("amount_minor", "fee_minor"))
    pairs = matching._amount_aligned(both, both, rule, (amount <= 2) & (fee <= 1)).collect()
    key = lambda p: (abs(p.l_ts_ns - p.r_ts_ns), p.r_source_id, p.r_source_line, p.r_batch_ord, p.r_record_id)
    got = {}
    for p in pairs:
        got[p.l_record_id] = min(got.get(p.l_record_id, key(p)), key(p))
    flat = both.collect()
    near = {a.record_id: [(abs(a.ts_ns - b.ts_ns), b.source_id, b.source_line, b.batch_ord, b.record_id) for b in flat if b.role != a.role and abs(a.amount_minor - b.amount_minor) <= 2 and abs(a.fee_minor - b.fee_minor) <= 1] for a in flat}
    assert got == {a: min(n) for a, n in near.items() if n}
    # two neighbours of each role, amount and fee at most, however many records have them
    assert len(pairs) <= 2 * 2 * 4 * 3 * len(flat) and all(p.l_role != p.r_role for p in pairs)
    many = records(spark, [(r, f"G{r}{i}", "", 7, i * 7000 * S, 0, None, i) for r in ("internal", "processor") for i in range(300)])
    assert matching._amount_aligned(many, many, rule, (amount <= 2) & (fee <= 1)).count() <= 2 * 600
