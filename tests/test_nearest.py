"""The nearest amount in a window against a look at all pairs."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from tallyweave.operators import nearest

SCHEMA = "record_id string, role string, currency string, ts_ns long, amount_minor long, source_id string, source_line long, batch_ord int, batch_id string"


def records(seed, n, span, amounts):
    r = random.Random(seed)
    return [(f"r{i:06}", role := r.choice(["internal", "processor", "bank"]), r.choice(["USD", "USD", "EUR"]), r.randint(-span, span), r.choice(amounts), role, r.randint(1, 9), r.randint(0, 1), "b") for i in range(n)]


def brute(rows, window):
    out = {}
    for a in rows:
        near = [(abs(b[4] - a[4]), b[5], b[6], b[7], b[0]) for b in rows if b[1] != a[1] and b[2] == a[2] and abs(b[3] - a[3]) <= window]
        if near:
            out[a[0]] = min(near)[-1]
    return out


@pytest.mark.parametrize("window,slice_rows,shard_rows", [(50, 8192, 50_000), (50, 3, 7), (0, 2, 5), (100_000, 4, 30)])
def test_nearest_equals_all_pairs(spark, window, slice_rows, shard_rows):
    rows = records(window, 300, 400 if window else 6, [*range(-20, 20), 5, 5, 5, 2**63 - 1, 2**62, -(2**62)])
    rows = [x for x in rows if abs(x[4]) < 2**61] if window else rows[:0] + [x for x in rows if abs(x[4]) < 2**61]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.asker: r.t.record_id for r in nearest.nearest_amount(df, df, window, slice_rows, shard_rows).collect()}
    assert got == brute(rows, window)


def test_nobody_asks_and_nobody_is_there(spark):
    df = spark.createDataFrame(records(1, 5, 10, [1]), SCHEMA)
    assert nearest.nearest_amount(df.where("false"), df, 10).count() == 0
    assert nearest.nearest_amount(df, df.where("false"), 10).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=40), st.data())
def test_first_hit_equals_a_walk(times, data):
    t = np.array(times)
    at = data.draw(st.integers(0, len(t)))
    end = data.draw(st.integers(at, len(t)))
    since = data.draw(st.integers(0, 31))
    got = nearest.Runs(t, t).first(np.array([at]), np.array([end]), np.array([since]), np.array([10**9]))
    assert got[0] == next((i for i in range(at, end) if times[i] >= since), end)


def test_one_crowded_window_costs_in_proportion(spark):
    """Twice the records of one minute and one currency take well under four times as long."""
    took = []
    for n in (16_000, 16_000, 32_000):
        rows = records(7, n, 30_000_000_000, range(10**6))
        df = spark.createDataFrame([(*x[:2], "USD", *x[3:]) for x in rows], SCHEMA)
        began = time.time()
        assert nearest.nearest_amount(df, df, 60_000_000_000).count() == n
        took.append(time.time() - began)
    assert took[2] < 2 * took[1] + 2
