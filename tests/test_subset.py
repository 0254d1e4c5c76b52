"""The counted subset search and its rounds against plain enumeration."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.functions.ids import with_identity
from tallyweave.operators import subset
from tallyweave.plans.rules import OneToMany, Rule, Tolerance

S = 1_000_000_000


def rule(amount, fee=Tolerance(), window=60 * S, members=3, limit=10_000, roles=("bank", "processor")):
    return Rule("m", ("bank", "processor"), amount, fee, window, {}, OneToMany(*roles, members), limit)


def enumerate_all(anchor, amounts, fees, r):
    looked = 0
    for size in range(2, min(r.one_to_many.max_members, len(amounts)) + 1):
        for c in itertools.combinations(range(len(amounts)), size):
            if looked >= r.search_limit:
                return None, True
            looked += 1
            total, fee = sum(amounts[i] for i in c), sum(fees[i] for i in c)
            if subset.within(r.amount, abs(anchor[0] - total), max(anchor[0], total)) and (not r.fee.enabled or subset.within(r.fee, abs(anchor[1] - fee), max(anchor[1], fee))):
                return list(c), False
    return None, False


tolerances = st.builds(Tolerance, st.none() | st.integers(0, 9), st.none() | st.integers(0, 20_000))


@settings(max_examples=1500, deadline=None)
@given(st.integers(-60, 60), st.integers(0, 4), st.lists(st.tuples(st.integers(-30, 30), st.integers(0, 3)), max_size=9), tolerances, tolerances, st.integers(2, 5), st.integers(1, 140))
def test_pruned_search_equals_enumeration(value, fee, members, amount, fees, most, limit):
    r = rule(amount, fees, members=most, limit=limit)
    args = (value, fee), [m[0] for m in members], [m[1] for m in members]
    assert subset.Search(*args, r).run() == enumerate_all(*args, r)


def test_branches_are_counted_without_being_formed():
    members = [100 + i for i in range(20)], [0] * 20
    search = subset.Search((10**6, 0), *members, rule(Tolerance(0), members=6, limit=100_000))
    assert search.run() == (None, False)
    assert search.counted == sum(math.comb(20, k) for k in range(2, 7)) == 60_439 and search.visited == 0
    search = subset.Search((10**6, 0), *members, rule(Tolerance(0), members=6, limit=10_000))
    assert search.run() == (None, True) and search.visited == 0


def frame(spark, rows):
    """Rows of (role, external id, amount, seconds) as records."""
    cols = "role string, external_id string, amount_minor long, ts_ns long, source_line long, source_id string, business_id string, batch_id string, batch_ord int, fee_minor long, currency string, direction string, counterparty string, memo string"
    flat = [(r, e, a, t * S, i, r, "", "b", 0, 0, "USD", "", "", "") for i, (r, e, a, t) in enumerate(rows)]
    return with_identity(spark.createDataFrame(flat, cols))


def in_turn(rows, r):
    """Anchors one after the other over all rows."""
    many, taken, out = r.one_to_many, set(), set()
    ordered = sorted(rows, key=lambda x: (x.stable_key, x.source_line, x.batch_ord))
    for a in (x for x in ordered if x.role == many.anchor_role):
        if a.record_id in taken:
            continue
        near = [m for m in ordered if m.role == many.many_role and m.record_id not in taken and m is not a and abs(m.ts_ns - a.ts_ns) <= r.window_ns]
        if len(near) < 2:
            continue
        found, limit = enumerate_all((a.amount_minor, a.fee_minor), [m.amount_minor for m in near], [m.fee_minor for m in near], r)
        if found:
            ids = [a.record_id, *(near[i].record_id for i in found)]
            taken |= set(ids)
            out.add(("group", tuple(sorted(ids)), ""))
            continue
        total = sum(m.amount_minor for m in near)
        note = "combination search limit exceeded" if limit else "match requires more than max_members" if len(near) > many.max_members and subset.within(r.amount, abs(a.amount_minor - total), max(a.amount_minor, total)) else ""
        if note:
            taken.add(a.record_id)
            out.add(("limit", (a.record_id, *sorted(m.record_id for m in near)), note))
    return out


@pytest.mark.parametrize("seed,roles", [(1, ("bank", "processor")), (2, ("bank", "processor")), (3, ("bank", "bank"))])
def test_rounds_over_one_long_island_equal_anchors_in_turn(spark, seed, roles):
    rng = random.Random(seed)
    rows = [(rng.choice(["bank", "processor", "processor"]), f"E{i if seed == 2 else rng.randint(0, 10**6)}", rng.randint(1, 12), 4 * i + rng.randint(0, 9)) for i in range(400)]
    r = rule(Tolerance(0), window=20 * S, limit=12, roles=roles)
    df = frame(spark, rows)
    want = in_turn(df.collect(), r)
    for cell_rows in (10, 50_000):
        got = {(x.kind, tuple(x.record_ids), x.note) for x in subset.first_subsets(df, r, cell_rows).collect()}
        assert got == want and len({k for k, _, _ in want}) == 2 and len(want) > 12


@pytest.mark.parametrize("ticks", [3, 1 << 16])
def test_records_of_small_homes_are_written_once(spark, monkeypatch, ticks):
    """Islands far apart, some over the edges of ticks: records go to their anchors' home and nowhere else."""
    monkeypatch.setattr(subset, "TICKS", ticks, raising=False)
    wide, real = [], subset.cut
    monkeypatch.setattr(subset, "cut", lambda df: wide.append("stable_key" in df.columns) or real(df))
    rng = random.Random(7)
    rows = [(rng.choice(["bank", "processor", "processor"]), f"E{i}", rng.randint(1, 12), 3000 * (i // 14) + rng.randint(0, 90) - 45) for i in range(400)]
    r = rule(Tolerance(0), window=20 * S, limit=12)
    df = frame(spark, rows)
    got = {(x.kind, tuple(x.record_ids), x.note) for x in subset.first_subsets(df, r).collect()}
    assert got == in_turn(df.collect(), r) and len(got) > 12
    assert sum(wide) == 1
