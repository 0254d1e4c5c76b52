"""Payment records derived from the star-schema tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..schema import RECORD_COLUMNS, currency_scale, role_rank

# Currencies by customer.
BY_CUSTOMER = ("USD", "EUR", "GBP", "CNY", "JPY")
SECOND = 1_000_000_000
# Orders whose hour, counted from 1970 by their key, a count of nanoseconds in a long can hold, with the
# lines after it; later ones are 1,210 s apart, 7.5 million to a currency. The rule of their queries looks 600 s around.
HOURS = 2_562_048
PLACES, PLACE_S = 7_500_000, 1_210


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where their files have fewer splits than there are cores; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def _records(rows: DataFrame) -> DataFrame:
    """Fill in what the derived records don't vary, and their identity."""
    fixed = {"batch_ord": F.lit(0), "direction": F.lit("credit"), "counterparty": F.lit(""), "memo": F.lit(""), "isolated": F.lit(False), "invalid_reason": F.lit(""), "timestamp_raw": F.col("ts_ns").cast("string")}
    out = rows.withColumns({k: v for k, v in fixed.items() if k not in rows.columns} | {"source_id": F.col("role"), "role_rank": role_rank(F.col("role")), "scale": currency_scale(F.col("currency"))})
    if "batch_id" not in rows.columns:
        out = out.withColumn("batch_id", F.concat(F.lit("b-"), "role"))
    return ids.with_identity(out).select([F.col(c).cast(t).alias(c) for c, t in RECORD_COLUMNS.items()])


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal, processor and bank records of every order, with duplicates, twins, gaps and fees at fixed strides."""
    k = F.col("k")
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderdate")).select(
        F.col("o_orderkey").alias("k"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("m"),
        F.element_at(F.array(*map(F.lit, BY_CUSTOMER)), (F.col("o_custkey") % 5 + 1).cast("int")).alias("currency"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + (F.col("o_orderkey") * 37 % 86400) * SECOND).alias("ns"),
    )
    bid = F.when(k % 4 != 0, F.concat(F.lit("BIZ"), k.cast("string"))).otherwise("")
    name = lambda p, s="": F.concat(F.lit(p), k.cast("string"), F.lit(s))
    fee = F.when(k % 31 == 0, 7).otherwise(0)
    wobble = k % 13 - 6

    def kind(here: Column, role: str, ext: Column, business: Column, amount: Column, fees: Column, ns: Column, line: int) -> Column:
        row = F.struct(F.lit(role).alias("role"), ext.alias("external_id"), business.alias("business_id"), amount.cast("long").alias("amount_minor"), fees.cast("long").alias("fee_minor"), ns.alias("ts_ns"), (k * 4 + line).alias("source_line"))
        return F.when(here, row)

    zero, none = F.lit(0), F.lit("")
    late = F.col("ns") + (k % 150) * SECOND
    rows = F.array(
        kind(k % 29 != 0, "internal", name("INT"), bid, F.col("m"), zero, F.col("ns"), 1),
        kind((k % 101 == 0) & (k % 29 != 0), "internal", name("INT"), bid, F.col("m"), zero, F.col("ns"), 2),
        kind(k % 23 != 0, "processor", name("PRC"), bid, F.col("m") + F.when(k % 4 == 0, wobble).otherwise(0), fee, late, 1),
        kind((k % 44 == 0) & (k % 23 != 0), "processor", name("PRC", "b"), none, F.col("m") + wobble, fee, late, 2),
        kind(k % 3 != 0, "bank", name("BNK"), bid, F.col("m"), zero, F.col("ns") + (k % 60) * SECOND, 1),
    )
    return _records(o.select("currency", F.explode(rows).alias("r")).where("r is not null").select("currency", "r.*"))


def resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``payments`` with every fiftieth order's processor records sent again in a later batch."""
    p = payments(spark, sf_dir)
    again = p.where("role = 'processor' and source_line div 4 % 50 = 0").withColumns({"batch_id": F.lit("b-resend"), "batch_ord": F.lit(1)})
    return p.unionByName(again)


def settlements(spark: SparkSession, sf_dir: str, shared: bool = False) -> DataFrame:
    """A bank record for each order over the sum of its first three lines, and a processor record for each line.

    With ``shared`` two bank records an order: over its first two lines, and over the next two or, for odd orders, the second and third.
    An order is in USD at the hour of its key, or from key ``HOURS`` on in another currency, over twenty minutes from any other up to key 32,562,047.
    """
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = li.select(F.col("l_orderkey").alias("k"), F.row_number().over(w).cast("long").alias("rn"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("v"))
    k, over = F.col("k"), F.col("k") - HOURS
    spaced = F.pmod(over, F.lit(PLACES))
    at = F.when(over < 0, k * F.lit(3600 * SECOND).cast("long")).otherwise(spaced * F.lit(PLACE_S * SECOND).cast("long"))
    turn = F.expr(f"pmod((k - {HOURS}) div {PLACES}, {len(BY_CUSTOMER) - 1})").cast("int")
    currency = F.when(over < 0, BY_CUSTOMER[0]).otherwise(F.element_at(F.array(*map(F.lit, BY_CUSTOMER[1:])), turn + 1)).alias("currency")
    common = {"business_id": F.lit(""), "fee_minor": F.lit(0).cast("long")}
    members = lines.select(F.lit("processor").alias("role"), F.concat(F.lit("LIN"), F.col("k").cast("string"), F.lit("-"), F.lpad(F.col("rn").cast("string"), 2, "0")).alias("external_id"), F.col("v").alias("amount_minor"), (at + F.col("rn") * SECOND).alias("ts_ns"), (F.col("k") * 100 + F.col("rn")).alias("source_line"), currency)
    if shared:
        first = F.sum(F.when(F.col("rn") <= 2, F.col("v"))).alias("a")
        second = F.sum(F.when(F.col("rn").between(3 - F.col("k") % 2, 4 - F.col("k") % 2), F.col("v"))).alias("b")
        pairs = lines.groupBy("k").agg(first, F.coalesce(second, F.lit(0)).alias("b")).select("k", F.explode(F.array(F.struct(F.lit("SETA").alias("name"), F.col("a").alias("v"), F.lit(0).alias("at")), F.struct(F.lit("SETB").alias("name"), F.col("b").alias("v"), F.lit(99).alias("at")))).alias("s"))
        anchors = pairs.select(F.lit("bank").alias("role"), F.concat("s.name", F.col("k").cast("string")).alias("external_id"), F.col("s.v").alias("amount_minor"), at.alias("ts_ns"), (F.col("k") * 100 + F.col("s.at")).alias("source_line"), currency)
        return _records(members.unionByName(anchors).withColumns(common))
    anchors = lines.groupBy("k").agg(F.sum(F.when(F.col("rn") <= 3, F.col("v"))).alias("amount_minor")).select(F.lit("bank").alias("role"), F.concat(F.lit("SET"), F.col("k").cast("string")).alias("external_id"), "amount_minor", at.alias("ts_ns"), (F.col("k") * 100).alias("source_line"), currency)
    return _records(members.unionByName(anchors).withColumns(common))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, value): a JSON object for each event, parsed as a feed's NDJSON would be."""
    e = spread(table(spark, sf_dir, "events"))
    text = F.to_json(
        F.struct(
            F.concat(F.lit("EVT"), F.col("event_id").cast("string")).alias("external_id"),
            F.col("value").cast("decimal(18,2)").cast("string").alias("amount"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
            F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("business_id"),
            F.col("event_type").alias("memo"),
            F.col("props"),
        )
    )
    return e.select(F.lit("events").alias("path"), F.col("event_id").alias("line"), F.try_parse_json(text).alias("value"), "props")
