"""Derived records of orders with large keys."""

import duckdb
import pytest

from tallyweave.plans import queries
from tallyweave.sources import payments

KEYS = (0, 1, 2, 2_562_047, 2_562_048, 2_562_049, 2_562_048 + 7_500_000 - 1, 2_562_048 + 7_500_000, 32_562_046, 32_562_047)


@pytest.fixture(scope="module")
def large_keys(tmp_path_factory):
    """Four lines an order, of equal amounts for all orders."""
    folder = tmp_path_factory.mktemp("large")
    keys = ", ".join(f"({k})" for k in KEYS)
    duckdb.sql(f"copy (select k::bigint as l_orderkey, n::bigint as l_partkey, n::bigint as l_suppkey, n::int as l_linenumber, 1.0::double as l_quantity, (100 * n + n * n / 100)::double as l_extendedprice, timestamp '2000-01-01' as l_shipdate from (values {keys}) as t(k), range(1, 5) as r(n)) to '{folder}/lineitem.parquet' (format parquet)")
    return str(folder)


def test_orders_whose_hours_exceed_a_long(spark, large_keys):
    groups = queries.QUERIES["one_to_many_matches"](spark, large_keys).collect()
    assert len(groups) == len(KEYS) and {(r.amount_minor, r.amount_diff) for r in groups} == {(60_014, 0)}
    limits = queries.QUERIES["search_limit_discrepancies"](spark, large_keys).collect()
    assert len(limits) == len(KEYS) and {r.record_ids.count(",") for r in limits} == {4}
    shared = queries.QUERIES["shared_anchor_groups"](spark, large_keys).collect()
    assert len({r.record_ids for r in shared}) == len(shared) == len(KEYS) + sum(k % 2 == 0 for k in KEYS)


def test_orders_keep_apart(spark, large_keys):
    bank = payments.settlements(spark, large_keys).where("role = 'bank'").collect()
    at = {(r.source_line // 100): (r.currency, r.ts_ns) for r in bank}
    assert all(at[k] == ("USD", k * 3_600_000_000_000) for k in KEYS if k < payments.HOURS)
    places = sorted(at.values())
    assert all(a[0] != b[0] or b[1] - a[1] > 1_200_000_000_000 for a, b in zip(places, places[1:]))
    assert at[32_562_047][0] != "USD"


def test_islands_that_begin_with_ties(spark, tmp_path):
    """Orders of one time and currency at both ends of a gap. Which of them a row-wise sum meets first is left to chance, so the SQL must take peers together."""
    duckdb.sql(f"copy (select k::bigint as o_orderkey, (k % 2)::bigint as o_custkey, 'O' as o_orderstatus, (1000 + k)::double as o_totalprice, timestamp '2000-01-01' as o_orderdate, '' as o_orderpriority from (select 86400 * r + 150 * s as k from range(200) a(r), range(3) b(s))) to '{tmp_path}/orders.parquet' (format parquet)")
    sql = queries.ORACLE_SQL["time_islands"]
    got = queries.QUERIES["time_islands"](spark, str(tmp_path)).select("currency", "first_ns", "last_ns", "n_records").collect()
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall())
    assert "range unbounded preceding" in sql and "rows unbounded preceding" not in sql
