"""What a run shuffles: narrow rows once, with the results of wide ones."""

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import lineage
from tallyweave.operators import matching, nearest
from test_nearest import SCHEMA, brute, records


@pytest.mark.parametrize("most", [10**6, 0])
def test_among_keeps_every_key(spark, monkeypatch, most):
    monkeypatch.setattr(lineage, "FEW_KEYS", most)
    rows = spark.range(60_000).select(F.concat(F.lit("r"), "id").alias("record_id"), "id")
    kept = lineage.among(rows, rows.where("id % 7 = 0").select("record_id"))
    got = {r.id for r in kept.collect()}
    assert kept.columns == rows.columns and set(range(0, 60_000, 7)) <= got and len(got) < 9_000


def test_others_move_once_unless_a_cell_is_crowded(spark, monkeypatch):
    def no_slices(*args):
        raise AssertionError("slices of a cell that a task holds whole")

    df = spark.createDataFrame(records(5, 400, 3000, range(-50, 50)), SCHEMA).repartition(3)
    monkeypatch.setattr(nearest, "slices", no_slices)
    assert {r.asker: r.t.record_id for r in nearest.nearest_amount(df, df, 50).collect()} == brute([tuple(r) for r in df.collect()], 50)


def test_rounds_move_numbers(spark):
    """Edges that are taken come without the columns of their order, which are sorted once."""
    edges = spark.createDataFrame([(f"a{i}", f"b{j}", "x", "y", 1, 1, 0, 0, 5, 5, "USD", [1, abs(i - j), 0, 0]) for i in range(4) for j in range(4)], "a_record_id string, b_record_id string, a_stable_key string, b_stable_key string, a_source_line long, b_source_line long, a_batch_ord int, b_batch_ord int, a_amount_minor long, b_amount_minor long, currency string, score_tuple array<long>")
    won = matching.commit_tolerance(edges, edges.where("false").select(F.col("a_record_id").alias("record_id")))
    assert "a_stable_key" not in won.columns
    assert {(r.a_record_id, r.b_record_id) for r in won.collect()} == {(f"a{i}", f"b{i}") for i in range(4)}


def test_exact_groups_of_crowded_ids(spark, monkeypatch):
    rows = [("r1", "k2", 0), ("r0", "k3", 0), ("r2", "k1", 1), ("r3", "k9", 1)]
    frame = spark.createDataFrame([(r, k, rank, 1, 0, "USD", "A", 7) for r, k, rank in rows] + [("s", "k", 2, 1, 0, "USD", "B", 7)], "record_id string, stable_key string, role_rank int, source_line long, batch_ord int, currency string, business_id string, amount_minor long")
    groups, left = matching.exact_id_phase(frame)
    assert [r.record_ids for r in groups.collect()] == [["r1", "r2"]]
    assert {r.record_id for r in left.collect()} == {"r0", "r3", "s"}
    monkeypatch.setattr(lineage, "FEW_KEYS", 0)
    groups, left = matching.exact_id_phase(frame)
    assert [r.record_ids for r in groups.collect()] == [["r1", "r2"]] and left is None


def test_changed_records_go_by_leaves_of_bounded_size(spark, monkeypatch):
    """The trees are as deep as the number of ids asks for, and ids are derived once."""
    from oracle import DATA

    from tallyweave.operators import merkle
    from tallyweave.plans import queries

    seen = []
    monkeypatch.setattr(queries.merkle, "differences", lambda a, b, keys, depth: seen.append((a, b, depth)) or a)
    queries.changed_records(spark, DATA)
    ((a, b, depth),) = seen
    assert depth == merkle.leaf_depth(a.count()) and all(x.inputFiles() and "tallyweave-" in x.inputFiles()[0] for x in (a, b))


def test_groups_of_a_run_judge_no_leftovers(spark, monkeypatch):
    """Records that are written already aren't written again for the search of sums, and leftovers give no groups."""
    from oracle import DATA

    from tallyweave.operators import subset
    from tallyweave.plans import engine, queries
    from tallyweave.sources import payments

    rules = [queries.LINES_RULE, queries.DEFAULT_RULE]
    few_orders = payments.settlements(spark, DATA, shared=True).where("source_line < 20000")
    want = sorted(map(str, engine.reconcile(few_orders, rules).groups.collect()))
    written, real = [], subset.cut
    monkeypatch.setattr(subset, "cut", lambda df: written.append("stable_key" in df.columns) or real(df))
    monkeypatch.setattr(engine.matching, "classify", lambda *a: 1 / 0)
    assert sorted(map(str, engine.matched_groups(few_orders, rules).collect())) == want and len(want) > 20
    assert written and not any(written)
    queries.shared_anchor_groups(spark, DATA)
