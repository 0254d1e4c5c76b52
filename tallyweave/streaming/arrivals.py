"""Feeds that keep arriving: a file stream whose micro-batches become record batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import missing_type
from ..schema import ROLES
from ..sources import feeds
from ..sources.feeds import Source


def ingest_stream(spark: SparkSession, folder: str, source: Source, target: str, checkpoint: str, glob: str = "*", available_now: bool = False) -> StreamingQuery:
    """Normalise every file that arrives in ``folder`` into ``target``, a batch a file, partitioned by batch.

    A batch is named by its source and the digest of the file's content, and only partitions
    that a micro-batch holds are replaced: a file that is delivered again, after a failure, under another name or to a
    stream with a checkpoint of its own, leaves the same rows in the same place and nothing else changes.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    files = files.select("path", F.col("_metadata.file_path").alias("name"), feeds.file_digest(F.col("content")).alias("digest"))

    def commit(batch: DataFrame, number: int) -> None:
        once = batch.groupBy("digest").agg(F.min(F.struct("path", "name")).alias("f")).select("digest", "f.*").collect()  # a row a file of the micro-batch
        if not once:
            return
        names = spark.createDataFrame([(r.name, f"s-{source.source_id}-{r.digest}") for r in once], "path string, batch_id string")
        records = feeds.read_feed(spark, [r.path for r in once], source, names)
        records.drop("error").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(target)

    writer = files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


STATE = "spark.sql.streaming.stateStore."
ON_DISK = {STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", STATE + "rocksdb.boundedMemoryUsage": "true", STATE + "rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB, in memory of a fixed size and on local disk, rather than on the heap."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    try:
        for k, v in ON_DISK.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def without_retransmits(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A record stream without rows that repeat an earlier one's source, external id and content: what is remembered of a row lasts at least ``delay`` of event time."""
    marked = records.withColumn("_seen", F.timestamp_micros((F.col("ts_ns").cast("decimal(20,0)") / 1000).cast("long"))).withWatermark("_seen", delay)
    return marked.dropDuplicatesWithinWatermark(["source_id", "external_id", "content_hash"]).drop("_seen")


CLOSED = "currency string, business_id string, type string, record_ids array<string>, amount_minor long"


def closing_groups(records: DataFrame, hold_ns: int, delay: str = "1 hour") -> DataFrame:
    """The exact-id groups of a record stream, each once its time is over: (currency, business_id, type, record_ids, amount_minor).

    State holds for every currency and business id the record of the smallest stable key of each
    role, so the order of arrival doesn't matter and a busy id takes three records. A group
    closes when the latest event is ``hold_ns`` and ``delay`` past its last record: it
    is then an ``exact_id`` group, or ``missing_...`` if one role alone has come. A record that comes
    after that opens the id again. Records without a business id or isolated take no part.

    That is a session window with a gap of both spans under a watermark at the latest event; records
    of an id further apart than the gap are groups of their own, however micro-batches are cut.
    """
    start = "timestamp_ntz'1970-01-01 00:00:00'"
    (delay_us,) = records.sparkSession.sql(f"select timestampdiff(microsecond, {start}, {start} + interval '{delay}')").first()
    row = F.struct("stable_key", "source_line", "batch_ord", "record_id", "amount_minor")
    places = [f"r{i}" for i in range(len(ROLES) + 1)]  # unknown roles share the last
    named = records.where("business_id <> '' and not isolated").withColumn("_at", F.timestamp_micros((F.col("ts_ns").cast("decimal(20,0)") / 1000).cast("long"))).withWatermark("_at", "0 seconds")
    open_ = F.session_window("_at", f"{-(-hold_ns // 1000) + delay_us} microseconds")
    first = named.groupBy("currency", "business_id", open_).agg(*[F.min(F.when(F.col("role_rank") == i, row)).alias(r) for i, r in enumerate(places)])
    held = F.sort_array(F.array_compact(F.array(*[F.col(f"{r}.record_id") for r in places])))
    lone = F.lit(missing_type("", ROLES))
    for r, role in zip(places, ROLES):
        lone = F.when(F.col(r).isNotNull(), missing_type(role, ROLES)).otherwise(lone)
    kind = F.when(F.size("record_ids") > 1, "exact_id").otherwise(lone)
    return first.withColumn("record_ids", held).select("currency", "business_id", kind.alias("type"), "record_ids", F.coalesce(*places)["amount_minor"].alias("amount_minor"))


def match_stream(left: DataFrame, right: DataFrame, window_ns: int, delay: str = "1 hour") -> DataFrame:
    """Extension: pairs of two record streams with one business id at most ``window_ns`` apart, under watermarks."""
    seconds = -(-window_ns // 1_000_000_000)
    side = lambda df, p: df.where("business_id <> ''").select(*[F.col(c).alias(f"{p}_{c}") for c in ("record_id", "currency", "business_id", "amount_minor", "ts_ns")], F.timestamp_micros((F.col("ts_ns").cast("decimal(20,0)") / 1000).cast("long")).alias(f"{p}_ts")).withWatermark(f"{p}_ts", delay)
    a, b = side(left, "a"), side(right, "b")
    apart = F.expr(f"b_ts between a_ts - interval {seconds} seconds and a_ts + interval {seconds} seconds")
    return a.join(b, (F.col("a_currency") == F.col("b_currency")) & (F.col("a_business_id") == F.col("b_business_id")) & apart).where(F.abs(F.col("a_ts_ns") - F.col("b_ts_ns")) <= window_ns)
