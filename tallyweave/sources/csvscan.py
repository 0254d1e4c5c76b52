"""CSV feeds whose quoted cells hold line breaks, read in parallel.

A file is cut into pieces after line ends, wherever Spark's splits fall, and whether a piece begins
inside a quoted cell isn't known from the piece alone. So each piece tells, for both cases,
whether it ends inside one and how many records end in it; these functions are composed in
order, first over the pieces of a split and then over the splits of a file, which fixes
each piece's true start and the number of the record there. Then all pieces are parsed
apart. A record that reaches over pieces is put together from its fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut

PIECE_BYTES = 1 << 20
PEEK_BYTES = 1 << 20
ROWS_AT_ONCE = 4096
PIECES_OF_TASK = 16  # about, that are parsed in one task, however many there are

# A cell and what ends it; the last group is a quote that nothing closes.
_CELL = re.compile(r'(?:"([^"]*+(?:""[^"]*+)*+)"([^,\r\n]*+)|([^",\r\n][^,\r\n]*+|))(,|\r\n|\r|\n|\Z)|(")[\s\S]*+')
_END = re.compile(r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^",\r\n][^,\r\n]*+|)(,|\r\n|\r|\n|\Z)|(")[\s\S]*+')
_REST = re.compile(r'[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+(,|\r\n|\r|\n|\Z)')  # of a cell that began before
_BREAK = re.compile(r"\r\n|\r|\n")
BREAKS = ("\r\n", "\r", "\n")


class FeedError(ValueError):
    """A feed that can't be read at all."""


def split_records(text: str) -> tuple[list[list[str]], bool]:
    """(the records of a CSV text, whether the text ends within a quoted cell, in which case the record there is left out).

    Line feeds, carriage returns and their pairs end a record; an empty line is a record of
    one empty cell; a quote inside a bare cell is a character; text after a closing quote
    goes on with the cell; one carriage return at the end of a quoted last cell goes if a line feed alone follows.
    """
    if '"' not in text:
        lines = text.split("\n") if "\r" not in text else _BREAK.split(text)
        if not lines[-1]:
            lines.pop()
        return [line.split(",") for line in lines], False
    out, row, end = [], [], "\n"
    for quoted, rest, bare, end_, open_ in _CELL.findall(text):
        if open_:
            return out, True
        if not end_ and end != "," and not (quoted or rest or bare) and text[-1:] != '"':
            break  # nothing after the last record
        end = end_
        row.append((quoted.replace('""', '"') if '"' in quoted else quoted) + rest + bare)
        if end != ",":
            if end == "\n" and quoted and row[-1].endswith("\r"):
                row[-1] = row[-1][:-1]
            out.append(row)
            row = []
            if not end:
                break
    return out, False


def record_ends(text: str, inside: bool) -> tuple[bool, int]:
    """(whether a text that begins inside a quoted cell, or with a record, ends inside one; how many records end in it)."""
    ends, at = 0, 0
    if inside:
        m = _REST.match(text)
        if m is None:
            return True, 0
        ends, at = int(m[1] in BREAKS), m.end()
    if text.find('"', at) < 0:
        return False, ends + text.count("\n", at) + text.count("\r", at) - text.count("\r\n", at)
    found = _END.findall(text, at)
    return bool(found[-1][1] or len(found) > 1 and found[-2][1]), ends + sum(e in BREAKS for e, _ in found)


def _record_end(text: str, inside: bool) -> int:
    """Where the first record that ends in ``text`` ends; its length if none does."""
    at = 0
    if inside:
        m = _REST.match(text)
        if m is None:
            return len(text)
        at = m.end()
        if m[1] != ",":
            return at
    for m in _END.finditer(text, at):
        if m[2]:
            return len(text)
        if m[1] != ",":
            return m.end()
    return len(text)


def _open_start(text: str, at: int) -> int:
    """Where the record begins that ``text``, read from ``at`` on, ends within."""
    start = at
    for m in _END.finditer(text, at):
        if m[2]:
            break
        if m[1] in BREAKS:
            start = m.end()
    return start


def parse_piece(text: str, inside: bool) -> tuple[str | None, list[list[str]], str | None]:
    """(fragment of a record that began before, whole records, fragment of one that goes on) of a piece."""
    at = _record_end(text, True) if inside else 0
    head = text[:at] if inside else None
    rows, open_ = split_records(text[at:])
    if not open_:
        return head, rows, None
    return head, rows, text[_open_start(text, at) :]


def line_end(spark: SparkSession, path: str | list[str]) -> str:
    """The character that pieces are cut after: a line feed, or a carriage return for feeds whose first file has no line feed at its start. Both give the same rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    first = spark.read.format("binaryFile").load(path).select("path").agg(F.min("path")).first()[0]
    if first is None:
        return "\n"
    at = jvm.org.apache.hadoop.fs.Path(first)
    stream = at.getFileSystem(conf).open(at)
    try:
        head = bytes(stream.readNBytes(PEEK_BYTES))
    finally:
        stream.close()
    return "\r" if b"\r" in head and b"\n" not in head else "\n"


def _pieces(lines: DataFrame, sep: str, most: int) -> DataFrame:
    """Lines gathered to pieces of about ``most`` bytes: (path, start, seq, size, file_size, exit_out, ends_out, exit_in, ends_in, text)."""
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size = None, 0, [], 0

        def piece():
            text = mark.join(held) + mark
            body = text.decode("utf-8", "replace")
            here = body[1:] if sep == "\r" and body.startswith("\n") and (key[1] or seq) else body  # ends a pair that began before
            return pa.RecordBatch.from_pylist([dict(zip(names, (*key[:2], seq, size, key[2], *record_ends(here, False), *record_ends(body, True), text)))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            starts, names_ = batch.column("start").to_numpy(), batch.column("path").dictionary_encode()
            codes, values = names_.indices.to_numpy(), batch.column("value").to_pylist()
            lens = pc.binary_length(batch.column("value")).to_numpy()
            edges = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
            for at, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                now = (names_.dictionary[int(codes[at])].as_py(), int(starts[at]), batch.column("file_size")[at].as_py())
                if held and now != key:
                    yield piece()
                    held, size = [], 0
                if now != key:
                    key, seq = now, 0
                ends = np.cumsum(lens[at:stop] + 1)
                while at < stop:
                    # lines that still fit, or one that is longer than a piece
                    to = at + int(np.searchsorted(ends - (ends[0] - lens[at] - 1), most - size, "right"))
                    if to == at and not held:
                        to = at + 1
                    held += values[at:to]
                    size += int(lens[at:to].sum()) + to - at
                    ends, at = ends[to - at :], to
                    if at < stop:
                        yield piece()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield piece()

    kinds = {"path": pa.string(), "start": pa.int64(), "seq": pa.int64(), "size": pa.int64(), "file_size": pa.int64(), "exit_out": pa.bool_(), "ends_out": pa.int64(), "exit_in": pa.bool_(), "ends_in": pa.int64(), "text": pa.binary()}
    names, schema = list(kinds), pa.schema(list(kinds.items()))
    rows = lines.select("path", "start", "file_size", F.col("value").cast("binary").alias("value"))
    return rows.mapInArrow(run, "path string, start long, seq long, size long, file_size long, exit_out boolean, ends_out long, exit_in boolean, ends_in long, text binary")


def _compose(steps: list[tuple[bool, int, bool, int]]) -> list[tuple[bool, int, bool, int]]:
    """Running compositions of (exit and ends if entered outside, exit and ends if entered inside)."""
    out, now = [], (False, 0, True, 0)
    for step in steps:
        pick = lambda inside: (step[2], step[3]) if inside else (step[0], step[1])
        a, b = pick(now[0]), pick(now[2])
        now = (a[0], now[1] + a[1], b[0], now[3] + b[1])
        out.append(now)
    return out


STEP = "exit_out boolean, ends_out long, exit_in boolean, ends_in long"


def _within_splits(pieces: DataFrame) -> DataFrame:
    """(path, start, seq, size, file_size) with the composition of the split's pieces up to each, itself included."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        steps = list(zip(*(table.column(c).to_pylist() for c in ("exit_out", "ends_out", "exit_in", "ends_in"))))
        sums = [pa.array(c, k) for c, k in zip(zip(*_compose(steps)), (pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))]
        return pa.Table.from_arrays([*(table.column(c) for c in ("path", "start", "seq", "size", "file_size")), *sums], names=["path", "start", "seq", "size", "file_size", "exit_out", "ends_out", "exit_in", "ends_in"])

    return pieces.drop("text").groupBy("path", "start").applyInArrow(run, f"path string, start long, seq long, size long, file_size long, {STEP}")


def _over_splits(splits: DataFrame) -> DataFrame:
    """(path, start, inside, base, closing): how each split begins, and on the last split of a file how many bytes its last line end is short of.

    A file of a terabyte has some thousands of splits. Raises FeedError where a file ends inside a quoted cell.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("start")
        after = _compose(list(zip(*(table.column(c).to_pylist() for c in ("exit_out", "ends_out", "exit_in", "ends_in")))))
        if after[-1][0]:
            raise FeedError(f"unterminated quote in {table.column('path')[0]}")
        before = [(False, 0), *(a[:2] for a in after[:-1])]
        # a mark of three bytes at the start of a file isn't read
        bare = sum(table.column("size").to_pylist()) - table.column("file_size")[0].as_py() in (1, -2)
        closing = [False] * (len(before) - 1) + [bare]
        return pa.Table.from_arrays([table.column("path"), table.column("start"), *(pa.array(c, k) for c, k in zip(zip(*before), (pa.bool_(), pa.int64()))), pa.array(closing)], names=["path", "start", "inside", "base", "closing"])

    return splits.groupBy("path").applyInArrow(run, "path string, start long, inside boolean, base long, closing boolean")


def _places(pieces: DataFrame) -> DataFrame:
    """(path, start, seq, inside, leaves, base, closing), written: how every piece begins and ends, the number of the record there, and whether its last line end is not in the file."""
    sums = cut(_within_splits(pieces))
    whole = sums.groupBy("path", "start").agg(F.max_by(F.struct("exit_out", "ends_out", "exit_in", "ends_in"), "seq").alias("s"), F.max("seq").alias("last"), F.sum("size").alias("size"), F.max("file_size").alias("file_size"))
    begun = _over_splits(whole.select("path", "start", "size", "file_size", "s.*")).join(whole.select("path", "start", "last"), ["path", "start"])
    state = F.when(F.col("inside"), F.struct(F.col("exit_in").alias("exit"), F.col("ends_in").alias("ends"))).otherwise(F.struct(F.col("exit_out").alias("exit"), F.col("ends_out").alias("ends")))
    own = cut(sums.join(begun, ["path", "start"]).select("path", "start", "seq", state.alias("state"), "inside", "base", (F.col("closing") & (F.col("seq") == F.col("last"))).alias("closing")))
    earlier = own.select("path", "start", (F.col("seq") + 1).alias("seq"), F.col("state").alias("before"))
    at = own.join(earlier, ["path", "start", "seq"], "left")
    return cut(at.select("path", "start", "seq", F.coalesce("before.exit", "inside").alias("inside"), F.col("state.exit").alias("leaves"), (F.col("base") + F.coalesce("before.ends", F.lit(0))).alias("base"), "closing"))


def _aligned(cells: list[list[str]], header: list[str] | None, columns: list[str] | None) -> list[list[str | None]]:
    """The cells of ``columns`` by the names of the header, the last of equal names; all cells without either."""
    if header is None or columns is None:
        return cells
    index = {name: i for i, name in enumerate(header)}
    places = [index.get(c, len(header)) for c in columns]
    return [[row[i] if i < len(row) and i < len(header) else None for i in places] for row in cells]


def _cell_rows(path: str, lines: np.ndarray, cells: list[list[str | None]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, cells)]).astype(np.int32)
    flat = pa.ListArray.from_arrays(pa.array(ends), pa.array([c for row in cells for c in row], pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([path] * len(cells), pa.string()), pa.array(lines, pa.int64()), flat], ["path", "line", "cells"])


PIECE = ["path", "start", "seq", "inside", "leaves", "base", "closing", "header", "text"]


def _parse(placed: DataFrame, sep: str, fragments: bool, columns: list[str] | None = None) -> DataFrame:
    """Whole records as (path, line, cells), or fragments as (path, header, line, start, seq, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                text = r["text"][:-1] if r["closing"] else r["text"]
                body = text.decode("utf-8", "replace")
                if sep == "\r" and not r["inside"] and body.startswith("\n") and (r["start"] or r["seq"]):
                    body = body[1:]
                head, rows, tail = parse_piece(body, r["inside"])
                line = r["base"] + (head is not None and not (r["leaves"] and not rows and tail is None))
                if fragments:
                    found = [(r["base"], head)] * (head is not None) + [(line + len(rows), tail)] * (tail is not None)
                    if found:
                        yield pa.RecordBatch.from_pylist([{c: r[c] for c in ("path", "header", "start", "seq")} | {"line": n, "text": t} for n, t in found], schema=schema)
                    continue
                skip = r["header"] is not None and r["base"] == 0 and not r["inside"]  # the header itself
                for k in range(int(skip), len(rows), ROWS_AT_ONCE):
                    part = rows[k : k + ROWS_AT_ONCE]
                    yield _cell_rows(r["path"], np.arange(line + k, line + k + len(part)), _aligned(part, r["header"], columns))

    schema = pa.schema([("path", pa.string()), ("header", pa.list_(pa.string())), ("line", pa.int64()), ("start", pa.int64()), ("seq", pa.int64()), ("text", pa.string())])
    return placed.select(*PIECE).mapInArrow(run, "path string, header array<string>, line long, start long, seq long, text string" if fragments else "path string, line long, cells array<string>")


def _joined(fragments: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Records out of their fragments, in order of place."""
    whole = fragments.groupBy("path", "line").agg(F.sort_array(F.collect_list(F.struct("start", "seq", "text"))).alias("f"), F.max("header").alias("header")).select("path", "line", "header", F.array_join(F.transform("f", lambda x: x["text"]), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _cell_rows(r["path"], np.array([r["line"]]), _aligned(split_records(r["text"])[0], r["header"], columns))

    return whole.mapInArrow(run, "path string, line long, cells array<string>")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, sep: str | None = None, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, line, cells) of the CSV files at ``path``: lines from 1 without the header, the first record of a file.

    cells are those of ``columns`` in their order, by the names in the file's header (of equal
    names the last, null for one that the header or a short row lacks), or all cells of a row
    where no columns are named. Records are those of ``split_records`` over a whole file, invalid UTF-8 replaced. Spark
    splits the files; pieces of about a megabyte are written once to the shared folder with the text
    they hold, so that later steps don't depend on where splits fall. Empty files give no rows; a quote that
    nothing closes raises FeedError. ``sep`` is found by ``line_end`` unless given; a byte
    order mark at the start of a file is not part of its header.
    """
    sep = sep or line_end(spark, path)
    lines = spark.read.option("lineSep", sep).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("file_size"), "value")
    pieces = cut(_pieces(lines, sep, piece_bytes))
    texts, key = pieces.select("path", "start", "seq", "text"), ["path", "start", "seq"]
    places = _places(pieces)
    open_ = F.col("inside") | F.col("leaves")
    first = texts.join(places.where("base = 0").withColumn("header", F.lit(None).cast("array<string>")), key)
    header = _parse(first, sep, False).where("line = 0").unionByName(_joined(_parse(first.where(open_), sep, True).where("line = 0")))
    places = cut(places.join(header.select("path", F.col("cells").alias("header")), "path"))
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-pieces.count() // PIECES_OF_TASK))
    whole = _parse(texts.repartition(count, *key).join(places, key), sep, False, columns)
    broken = _parse(texts.join(places.where(open_), key), sep, True)
    return whole.unionByName(_joined(broken.where("line > 0"), columns))
