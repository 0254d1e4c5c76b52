"""Groups of a stream are session windows: no Python runs per id, and the cut of micro-batches doesn't tell groups."""

import pytest
from pyspark.sql import functions as F
from test_units import S, records

from tallyweave.streaming.arrivals import closing_groups


@pytest.mark.parametrize("files", [1, 3])
def test_far_records_of_an_id_are_groups_of_their_own(spark, tmp_path, files):
    rows = [("internal", "I1", "A", 10, 5), ("bank", "B1", "A", 12, 160), ("processor", "P1", "A", 11, 400), ("bank", "B9", "end", 1, 10**6)]
    frame = records(spark, [(*x[:4], x[4] * S) for x in rows]).withColumn("isolated", F.lit(False))
    for r in rows:
        frame.where(F.col("external_id") == r[1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    groups = closing_groups(stream, 60 * S, "100 seconds")
    plan = groups._jdf.queryExecution().logical().toString()
    assert "session" in plan and "InPandas" not in plan
    groups.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
    got = {(r.business_id, r.type, len(r.record_ids), r.amount_minor) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("A", "exact_id", 2, 10), ("A", "missing_internal", 1, 11)}


def test_state_of_a_match_is_on_disk(spark, tmp_path, monkeypatch):
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    from tallyweave.plans import queries
    from tallyweave.streaming import arrivals

    before, started, real = {k: spark.conf.get(k, None) for k in arrivals.ON_DISK}, [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(real(self, *a, **k)) or started[-1])
    assert queries.stream_match(spark, "/root/testdata/sf0.001").count() > 0
    states = [s for p in started[0].recentProgress for s in p["stateOperators"]]
    assert states and any("rocksdbCommitCount" in s["customMetrics"] or any(m.startswith("rocksdb") for m in s["customMetrics"]) for s in states)
    assert {k: spark.conf.get(k, None) for k in arrivals.ON_DISK} == before


def test_state_of_closing_groups_is_on_disk(spark, monkeypatch):
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    from tallyweave.plans import queries

    started, real = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(real(self, *a, **k)) or started[-1])
    assert queries.stream_closing_groups(spark, "/root/testdata/sf0.001").count() > 0
    states = [s for p in started[0].recentProgress for s in p["stateOperators"]]
    assert states and any(m.startswith("rocksdb") for s in states for m in s["customMetrics"])
