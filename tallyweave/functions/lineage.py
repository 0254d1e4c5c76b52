"""Cut the lineage of iterative plans with written tables, and name folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_KEYS = 2_000_000  # that are sent to all executors rather than joined by shuffling the other side
BITS = 1 << 28  # of the map that stands for more keys


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only in local mode, where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tallyweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark)}/tallyweave-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: computed once, and later plans read the columns they need."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)  # hexadecimal ids take half of what Snappy leaves
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(keys: DataFrame, most: int | None = None) -> DataFrame | None:
    """``keys`` computed once, to be sent to all executors; None if they are more than ``most``, by default ``FEW_KEYS``."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= (FEW_KEYS if most is None else most) else None


def marked(rows: DataFrame, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: true where their value is one of ``keys`` (one column of ``rows``) and, of more than ``FEW_KEYS`` keys, for some others too.

    ``rows`` are not shuffled: few keys are sent as they are; more are a map of 32 MB with a bit for each key's hash.
    """
    (name,) = keys.columns
    keys = cut(keys)
    if keys.count() <= FEW_KEYS:
        return rows.join(F.broadcast(keys.where(F.col(name).isNotNull()).distinct().withColumn(flag, F.lit(True))), name, "left").select(*rows.columns, F.coalesce(flag, F.lit(False)).alias(flag))
    bit = F.pmod(F.xxhash64(name), F.lit(BITS).cast("long"))
    maps = cut(keys.groupBy(F.bitmap_bucket_number(bit).alias("_map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bits")))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bits", (F.call_function("div", at, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (at % 8).cast("int")) == 1
    return rows.withColumn("_map", F.bitmap_bucket_number(bit)).join(F.broadcast(maps), "_map", "left").select(*rows.columns, F.coalesce(held, F.lit(False)).alias(flag))


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose value isn't one of ``keys`` (one column of ``rows``), and with all whose value is, to shuffle less in a join that follows."""
    return marked(rows, keys, "_held").where("_held").drop("_held")


def outside(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` whose value isn't one of ``keys`` (one column of ``rows``); of the others only those that a map can't tell are shuffled."""
    x = marked(rows, keys, "_held")
    return x.where("not _held").drop("_held").unionByName(x.where("_held").drop("_held").join(keys, keys.columns, "left_anti").select(*rows.columns))
