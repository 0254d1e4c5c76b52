"""Feeds: CSV and NDJSON files to normalised records and typed row errors."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, money, timeparse
from ..schema import RECORD_COLUMNS, currency_scale, role_rank
from .csvscan import FeedError, read_csv, split_records

LOGICAL = ("external_id", "amount", "currency", "fee", "direction", "timestamp", "business_id", "counterparty", "memo")
BLANK = r"(?U)^\s+|\s+$"


@dataclass(frozen=True)
class Source:
    source_id: str
    role: str
    currency: str = "USD"
    timezone: str = "UTC"
    format: str = "csv"
    field_map: dict[str, str] = field(default_factory=dict)
    name: str = ""

    def column(self, logical: str) -> str:
        return self.field_map.get(logical) or logical


def split_csv(text: str) -> list[list[str]]:
    """The records of a CSV text, as ``csvscan.split_records`` has them. An unterminated quote raises FeedError."""
    rows, open_ = split_records(text)
    if open_:
        raise FeedError("unterminated quote")
    return rows


def scan_csv(files: DataFrame) -> DataFrame:
    """(path, line, fields) of CSV files given as (path, content): fields a map by header name, lines from 1 without the header.

    For files that are at hand as bytes; ``csvscan.read_csv`` reads large ones in parts. Short
    rows lack columns, surplus cells are left, of equal header names the last counts.
    """
    kind = pa.map_(pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = split_csv(content.decode("utf-8", "replace"))
                header, rows = (rows[0], rows[1:]) if rows else ([], [])
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    fields = [list(dict(zip(header, r)).items()) for r in part]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(at + 1, at + 1 + len(part)), pa.int64()), pa.array(fields, kind)], ["path", "line", "fields"])

    return files.select("path", "content").mapInArrow(run, "path string, line long, fields map<string,string>")


def scan_ndjson(files: DataFrame) -> DataFrame:
    """(path, line, value) of NDJSON files given as (path, content): value a variant, null where a line isn't JSON.

    Blank lines are left out and not numbered. Numbers keep the digits they have.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"[\r ]+$", "")), lambda x: x != "")
    rows = files.select("path", F.posexplode(lines).alias("line", "text"))
    return rows.select("path", (F.col("line") + 1).cast("long").alias("line"), F.try_parse_json("text").alias("value"))


def read_ndjson(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line, value) as ``scan_ndjson``, of files that Spark splits and reads line by line.

    Lines are counted within each split of a file; the counts of the splits before are added.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    text = F.regexp_replace(F.make_valid_utf8("value"), r"[\r ]+$", "")
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), text.alias("text")).where("text <> ''")
    within, before = Window.partitionBy("path", "start").orderBy("at"), Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("path", "start").agg(F.count("*").alias("n")).select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = rows.withColumn("line", F.row_number().over(within)).join(bases, ["path", "start"])
    return numbered.select("path", (F.col("line") + F.col("base")).cast("long").alias("line"), F.try_parse_json("text").alias("value"))


def _json_text(value: Column, name: str) -> Column:
    return F.try_variant_get(value, '$["%s"]' % name.replace('"', '\\"'), "string")


def logical_fields(rows: DataFrame, source: Source) -> DataFrame:
    """(path, line, decoded, one column for each logical field): absent fields are null."""
    if source.format == "csv":
        if "cells" in rows.columns:
            got = {c: F.get("cells", F.lit(i)) for i, c in enumerate(LOGICAL)}  # read in this order
        else:
            got = {c: F.try_element_at("fields", F.lit(source.column(c))) for c in LOGICAL}
        ok = F.lit(True)
    elif source.format == "ndjson":
        got = {c: _json_text(F.col("value"), source.column(c)) for c in LOGICAL}
        ok = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    else:
        raise FeedError(f"unknown format {source.format}")
    return rows.select("path", "line", ok.alias("decoded"), *[v.alias(c) for c, v in got.items()])


def normalise(rows: DataFrame, source: Source, batch_id: str | Column, batch_ord: int = 0, currencies: dict[str, int] | None = None) -> DataFrame:
    """Records of ``schema.RECORD_COLUMNS`` with error: struct(line, field, code, reason, value), null for a valid one.

    Checks run in a fixed order and the first that fails names the error. A row with an
    error becomes an isolated record of amount zero in the source's currency.
    """
    x = rows.withColumns(
        {
            "_cur": F.upper(F.when(F.coalesce("currency", F.lit("")) != "", F.col("currency")).otherwise(F.lit(source.currency))),
            "_dir": F.lower(F.regexp_replace(F.coalesce("direction", F.lit("")), BLANK, "")),
            "_ns": timeparse.parse_ns(F.col("timestamp"), source.timezone),
        }
    )
    x = x.withColumn("_scale", currency_scale(F.col("_cur"), currencies))
    x = x.withColumns({"_amount": money.parse(F.col("amount"), F.coalesce("_scale", F.lit(0))), "_fee": money.parse(F.coalesce("fee", F.lit("")), F.coalesce("_scale", F.lit(0)))})
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fee_given = ~empty("fee")

    def error(name: str, code: Column | str, reason: str, value: Column) -> Column:
        code = F.lit(code) if isinstance(code, str) else code
        return F.struct(F.col("line").alias("line"), F.lit(name).alias("field"), code.alias("code"), F.lit(reason).alias("reason"), F.coalesce(value, F.lit("")).alias("value"))

    problem = (
        F.when(~F.col("decoded"), error("_record", "decode", "the row is not a record", F.lit("")))
        .when(empty("external_id"), error("external_id", "missing", "required", F.lit("")))
        .when(empty("amount"), error("amount", "missing", "required", F.lit("")))
        .when(F.col("_scale").isNull(), error("currency", "unknown_currency", "not registered", F.col("_cur")))
        .when(F.col("_amount.code").isNotNull(), error("amount", F.col("_amount.code"), "not an amount", F.col("amount")))
        .when(fee_given & F.col("_fee.code").isNotNull(), error("fee", F.col("_fee.code"), "not an amount", F.col("fee")))
        .when((F.col("_dir") != "") & ~F.col("_dir").isin("credit", "debit"), error("direction", "invalid", "credit or debit", F.col("direction")))
        .when(empty("timestamp"), error("timestamp", "missing", "required", F.lit("")))
        .when(F.col("_ns").isNull(), error("timestamp", "invalid", "no known layout", F.col("timestamp")))
    )
    x = x.withColumn("error", problem)
    good = F.col("error").isNull()
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), BLANK, "")
    own = source.currency.upper()
    y = x.select(
        F.lit(source.source_id).alias("source_id"),
        F.lit(batch_id).alias("batch_id"),
        F.lit(batch_ord).alias("batch_ord"),
        F.col("line").alias("source_line"),
        F.lit(source.role).alias("role"),
        role_rank(F.lit(source.role)).alias("role_rank"),
        F.when(good, F.col("external_id")).otherwise("").alias("external_id"),
        F.when(good, clean("business_id")).otherwise("").alias("business_id"),
        F.when(good, F.col("_amount.minor")).otherwise(0).cast("long").alias("amount_minor"),
        F.when(good & fee_given, F.col("_fee.minor")).otherwise(0).cast("long").alias("fee_minor"),
        F.when(good, F.col("_cur")).otherwise(F.when(currency_scale(F.lit(own), currencies).isNull(), "USD").otherwise(own)).alias("currency"),
        F.when(good, F.col("_scale")).otherwise(F.coalesce(currency_scale(F.lit(own), currencies), F.lit(2))).alias("scale"),
        F.when(good, F.col("_dir")).otherwise("").alias("direction"),
        F.col("_ns").alias("ts_ns"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp_raw"),
        F.when(good, clean("counterparty")).otherwise("").alias("counterparty"),
        F.when(good, clean("memo")).otherwise("").alias("memo"),
        "error",
    )
    y = ids.with_identity(y)
    line = F.col("source_line").cast("string")
    return y.select(
        F.when(F.col("error").isNull(), F.col("record_id")).otherwise(F.concat(F.lit(f"rec_invalid_{source.source_id}_"), line)).alias("record_id"),
        *[c for c in RECORD_COLUMNS if c not in ("record_id", "content_hash", "stable_key", "isolated", "invalid_reason")],
        F.when(F.col("error").isNull(), F.col("content_hash")).otherwise("").alias("content_hash"),
        F.when(F.col("error").isNull(), F.col("stable_key")).otherwise(F.concat(F.lit(f"{source.role}|invalid|"), line)).alias("stable_key"),
        F.col("error").isNotNull().alias("isolated"),
        F.concat_ws(": ", F.col("error.field"), F.col("error.code")).alias("invalid_reason"),
        "error",
    )


def read_feed(spark: SparkSession, path: str | list[str], source: Source, batch_id: str | DataFrame, batch_ord: int = 0, currencies: dict[str, int] | None = None) -> DataFrame:
    """Scan and normalise the files at ``path``, or at several; both formats are read over splits of the files.

    ``batch_id`` names one batch for all, or is a table (path, batch_id) of a batch for each file.
    """
    if source.format not in ("csv", "ndjson"):
        raise FeedError(f"unknown format {source.format}")
    rows = read_csv(spark, path, [source.column(c) for c in LOGICAL]) if source.format == "csv" else read_ndjson(spark, path)
    fields = logical_fields(rows, source)
    if isinstance(batch_id, DataFrame):
        fields, batch_id = fields.join(batch_id, "path"), F.col("batch_id")
    return normalise(fields, source, batch_id, batch_ord, currencies)


def parse_files(files: DataFrame, source: Source, batch_id: str, batch_ord: int = 0, currencies: dict[str, int] | None = None) -> DataFrame:
    if source.format not in ("csv", "ndjson"):
        raise FeedError(f"unknown format {source.format}")
    rows = scan_csv(files) if source.format == "csv" else scan_ndjson(files)
    return normalise(logical_fields(rows, source), source, batch_id, batch_ord, currencies)


def file_digest(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def batch_summary(records: DataFrame) -> DataFrame:
    """(batch_id, record_count, valid_count, invalid_count, amount_sum_minor, amount_sum_string, content_digest): the sum runs over all currencies."""
    valid = ~F.col("isolated")
    first = F.min_by(F.when(valid, F.col("currency")), F.when(valid, F.struct("source_id", "source_line")))
    total = F.sum(F.when(valid, F.col("amount_minor")).otherwise(0).cast("decimal(38,0)"))
    return records.groupBy("batch_id").agg(
        F.count("*").alias("record_count"),
        F.count_if(valid).alias("valid_count"),
        F.count_if(~valid).alias("invalid_count"),
        total.cast("long").alias("amount_sum_minor"),
        F.concat_ws(" ", total.cast("string"), first).alias("amount_sum_string"),
        ids.batch_digest(F.when(valid, F.col("record_id"))).alias("content_digest"),
    )
