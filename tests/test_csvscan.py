"""The CSV reader over pieces and splits against a walk over characters."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators.matching import exact_id_groups
from tallyweave.sources import csvscan, feeds
from tallyweave.streaming.arrivals import CLOSED, closing_groups, ingest_stream
from test_units import S, records

HEADER = "a,b,a\n"


def walk(text):
    """(records, whether a quote is left open), a character at a time."""
    out, row, cell, quoted, begun, i = [], [], "", False, False, 0
    while i < len(text):
        c, i, begun = text[i], i + 1, True
        pair = text[i : i + 1]
        if quoted:
            if c == '"' and pair == '"':
                cell, i = cell + c, i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c == ",":
            row, cell = [*row, cell], ""
        elif c in "\r\n":
            i += c == "\r" and pair == "\n"
            out.append([*row, cell.removesuffix("\r") if c == "\n" else cell])
            row, cell, begun = [], "", False
        else:
            cell += c
    return out + [[*row, cell]] * (begun and not quoted), quoted


def texts(seed, n, most, letters='ab,"\r\n"\n'):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


def test_records_equal_a_walk():
    for t in texts(1, 30000, 14):
        rows, open_ = csvscan.split_records(t)
        want, quoted = walk(t)
        assert (rows, open_) == (want, quoted), t


@pytest.mark.parametrize("sep", ["\n", "\r"])
def test_ends_tell_where_a_text_stands(sep):
    for t in texts(2, 20000, 14):
        t += sep
        for inside in (False, True):
            before = ['x,"', ""][not inside]
            rows, open_ = walk(before + t)
            assert csvscan.record_ends(t, inside) == (open_, len(rows)), (t, inside)


def written(folder, contents):
    for i, c in enumerate(contents):
        (folder / f"f{i:03}.csv").write_bytes(c.encode() if isinstance(c, str) else c)
    return str(folder)


def read(spark, path, **more):
    got = csvscan.read_csv(spark, path, **more).select(F.element_at(F.split("path", "/"), -1).alias("f"), "line", "cells").collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.f, r.line)):
        out.setdefault(r.f, []).append(r)
    return out


@pytest.mark.parametrize("sep", ["\n", "\r"])
def test_files_in_small_pieces_and_splits(spark, tmp_path, sep):
    ends = "\r" if sep == "\r" else "\n"
    contents = [c for c in (HEADER.replace("\n", ends) + t for t in texts(3, 60, 60)) if not walk(c)[1]][:8]
    contents += [f'h{ends}"long' + f"{ends}cell" * 40 + f'",z{ends}', "h", "", f"{ends}", f'"he{ends}ad",x{ends}1,2{ends}', "a\r\nb\r\n" * 9, "x" * 500]
    path = written(tmp_path, contents)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read(spark, path, sep=sep, piece_bytes=20)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for i, c in enumerate(contents):
        want = walk(c)[0]
        rows = got.get(f"f{i:03}.csv", [])
        assert [(r.line, r.cells) for r in rows] == list(enumerate(want))[1:], (i, c)


def test_columns_by_name(spark, tmp_path):
    path = written(tmp_path, ['b,"a\nx",b,c\n1,2,3,4\n5,6\n7,8,"9\n9",1,2\n\n', "c\nz\n"])
    got = read(spark, path, columns=["b", "a\nx", "c", "none"], piece_bytes=3)
    assert [tuple(r.cells) for r in got["f000.csv"]] == [("3", "2", "4", None), (None, "6", None, None), ("9\n9", "8", "1", None), (None, None, None, None)]
    assert [(r.line, tuple(r.cells)) for r in got["f001.csv"]] == [(1, (None, None, "z", None))]


def test_open_quotes_raise(spark, tmp_path):
    path = written(tmp_path, [HEADER + '1,"2\n3', HEADER + "1,2,3\n"])
    with pytest.raises(Exception, match="unterminated quote"):
        csvscan.read_csv(spark, path).collect()


def test_invalid_bytes_marks_and_headers(spark, tmp_path):
    path = written(tmp_path, [b"\xef\xbb\xbfexternal_id,amount,amount,timestamp\nA\xff,9,1.5,2026-01-02\nB,1\n\nC,1,2.5,2026-01-02,surplus"])
    rows = {r.source_line: r for r in feeds.read_feed(spark, path, feeds.Source("s", "bank"), "b").collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1].external_id, rows[1].amount_minor, rows[4].amount_minor) == ("A�", 150, 250)
    assert [rows[i].error.field for i in (2, 3)] == ["amount", "external_id"]


def test_two_checkpoints_keep_both_and_redelivery_adds_nothing(spark, tmp_path):
    target = str(tmp_path / "out")
    head = "external_id,amount,timestamp\n"
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "feed.csv").write_text(head + f"{name},1.00,2026-01-02\n")

    def run(folder, checkpoint):
        ingest_stream(spark, str(tmp_path / folder), feeds.Source("s", "bank"), target, str(tmp_path / checkpoint), "*.csv", available_now=True).awaitTermination(120)
        return sorted((r.external_id, r.batch_id) for r in spark.read.parquet(target).collect())

    run("one", "c1")
    both = run("two", "c2")
    assert [e for e, _ in both] == ["one", "two"] and len({b for _, b in both}) == 2
    assert run("one", "c3") == both
    (tmp_path / "two" / "copy.csv").write_text(head + "one,1.00,2026-01-02\n")
    assert run("two", "c2") == both
    (tmp_path / "two" / "late.csv").write_text(head + "three,1.00,2026-01-02\n")
    assert [e for e, _ in run("two", "c2")] == ["one", "three", "two"]


def test_groups_close_when_their_time_is_over(spark, tmp_path):
    rows = [("internal", "I1", "A", 10, 5), ("bank", "B1", "A", 12, 6), ("bank", "B0", "A", 13, 7), ("processor", "P1", "C", 1, 8), ("internal", "I2", "", 1, 8), ("bank", "B9", "end", 1, 10**6)]
    frame = records(spark, [(*x[:4], x[4] * S) for x in rows]).withColumn("isolated", F.lit(False))
    for k in (3, 0, 2, 1, 4, 5):  # a file each, in this order
        frame.where(F.col("external_id") == rows[k][1]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    closing_groups(stream, 60 * S, "100 seconds").writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination(120)
    got = {(r.business_id, r.type, len(r.record_ids), r.amount_minor) for r in spark.read.schema(CLOSED).parquet(str(tmp_path / "out")).collect()}
    assert got == {("A", "exact_id", 2, 10), ("C", "missing_internal", 1, 1)}
    want = exact_id_groups(frame).collect()
    assert [sorted(r.record_ids) for r in want] == [r.record_ids for r in spark.read.parquet(str(tmp_path / "out")).where("type = 'exact_id'").collect()]


def test_ndjson_arrives_too(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b.json").write_text('{"external_id":"x","amount":"1","timestamp":"2026-01-02"}\n\n[1]\n')
    ingest_stream(spark, str(folder), feeds.Source("s", "bank", format="ndjson"), str(tmp_path / "out"), str(tmp_path / "ck"), "*.json", available_now=True).awaitTermination(120)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("source_line").collect()
    assert [(r.source_line, r.external_id, r.isolated) for r in rows] == [(1, "x", False), (2, "", True)]


def test_parse_tasks_grow_with_the_pieces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n" + "".join(f"{i},v{i}\n" for i in range(6000)))
    got = csvscan.read_csv(spark, str(tmp_path / "a.csv"), ["y"], piece_bytes=64)
    pieces = (tmp_path / "a.csv").stat().st_size // 64
    assert got.rdd.getNumPartitions() >= pieces // csvscan.PIECES_OF_TASK > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted((r.line, r.cells[0]) for r in got.collect()) == [(i + 1, f"v{i}") for i in range(6000)]


def test_feed_files_sort_keys_before_texts(spark):
    """What csv_feed_lines sorts in one task a file are keys and numbers."""
    from tallyweave.plans import queries

    widths = []
    real = type(spark.range(1)).sortWithinPartitions

    def noted(self, *columns, **named):
        widths.append({f.dataType.simpleString() for f in self.schema.fields})
        return real(self, *columns, **named)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.range(1)), "sortWithinPartitions", noted)
        queries.csv_feed_lines(spark, "/root/testdata/sf0.001")
    assert widths and all("string" not in w for w in widths)
