"""What the corpus operators share: the shared folder, tables that cut lineage, sorted runs, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    takes its place in local mode, where driver and executors are one process; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tallyweave-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark).rpartition("/")[0])


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROW, OWN = "tallyweave_row", "tallyweave_own"


def own_columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns]


def with_row(docs: DataFrame) -> DataFrame:
    """(ROW, OWN): a number of each row of ``docs`` and a struct of its columns, where no name can clash; written, so that the number stays the same."""
    return written(docs.select(F.monotonically_increasing_id().alias(ROW), F.struct(*own_columns(docs)).alias(OWN)))


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose texts have about ``most`` bytes; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0)
    start, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(column):
        yield start, len(column)


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Split a partition that is sorted by ``keys`` into tables of whole runs of equal keys.

    A table holds many runs; only the last run of a batch waits for the next batch, so
    memory is a batch and the largest run. Callers bound the runs before they come here.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        at = np.flatnonzero(change)
        if held and all(held[-1].column(k)[-1] == batch.column(k)[0] for k in keys):
            if not len(at):
                held.append(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, int(at[0]))])
            batch, at = batch.slice(int(at[0])), at[1:] - at[0]
        elif held:
            yield pa.Table.from_batches(held)
        if len(at):
            yield pa.Table.from_batches([batch.slice(0, int(at[-1]))])
            batch = batch.slice(int(at[-1]))
        held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    change = np.zeros(table.num_rows + 1, bool)
    change[[0, -1]] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def _give_back() -> None:
    """Return freed memory to the system: an idle worker shouldn't hold a task's peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_map(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``mapInArrow`` with a function from batches to ``pa.RecordBatch`` or ``pa.Table``."""

    def run(batches):
        for out in f(batches):
            yield from out.to_batches() if isinstance(out, pa.Table) else [out]
        _give_back()

    return df.mapInArrow(run, schema)


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Components of an undirected graph of long ids: (node, component), component the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a
    grouped minimum, summed up before the shuffle, and an equi-join, in which adaptive
    execution splits a hub's edges; the number of steps grows with the logarithm of the longest path. ``edges`` has columns (a, b). Each round is written to the shared
    folder. Raises if ``limit`` rounds don't suffice, rather than return a half result.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    for _ in range(limit):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = written(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = written(small.where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.union(nodes.select("component", "component").distinct())
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {limit} rounds")
