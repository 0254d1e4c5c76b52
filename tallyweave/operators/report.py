"""Reports: summaries, discrepancy rows, JSON, CSV and the content digest."""

from __future__ import annotations

import csv
import hashlib
import io
import json

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import money, timeparse
from ..functions.lineage import among
from ..plans.engine import Result


# The columns of the CSV report.
CSV_HEADER = ("discrepancy_id", "type", "currency", "note", "evidence_record_ids", "sort_key")
BLOCK_IDS = 256  # of a digest's text that travel as one row


def evidence_ids() -> Column:
    """The records whose amounts a discrepancy counts: all it names but the tied candidates."""
    return F.col("record_ids")


def evidence_rows(result: Result) -> DataFrame:
    """One row for each piece of evidence: the discrepancy's columns, place and the record's attributes."""
    rows = result.discrepancies.select("*", F.posexplode(evidence_ids()).alias("place", "record_id"))
    seen = among(result.records, rows.select("record_id").distinct())
    seen = seen.select("record_id", "role", "amount_minor", "scale", "ts_ns", "timestamp_raw", "external_id", "stable_key").dropDuplicates(["record_id"])
    return rows.join(seen, "record_id", "left")


def discrepancy_rows(result: Result) -> DataFrame:
    """(discrepancy_id, type, currency, note, evidence_record_ids, sort_key): one row a discrepancy."""
    e = evidence_rows(result)
    keys = F.array_sort(F.collect_list(F.struct("place", F.coalesce("stable_key", "record_id").alias("k"), "record_id")))
    out = e.groupBy("discrepancy_id", "type", "currency", "note").agg(keys.alias("e"))
    parts = lambda c: F.transform("e", lambda x: x[c])
    return out.select("discrepancy_id", "type", "currency", "note", F.array_join(parts("record_id"), ";").alias("evidence_record_ids"), F.concat_ws("|", "currency", "type", F.array_join(parts("k"), "|")).alias("sort_key"))


def summary_by(result: Result, *keys: str) -> DataFrame:
    """Counts and sums of discrepancy evidence by ``keys`` out of currency and type."""
    e = evidence_rows(result)
    per = e.groupBy("discrepancy_id", "type", "currency").agg(F.sum(F.coalesce("amount_minor", F.lit(0)).cast("decimal(38,0)")).alias("v"))
    return per.groupBy(*keys).agg(F.count("*").alias("discrepancy_count"), F.sum("v").cast("long").alias("discrepancy_amount_minor"))


def matched_by_currency(result: Result) -> DataFrame:
    return result.groups.groupBy("currency").agg(F.count("*").alias("matched_count"), F.sum(F.col("amount_minor").cast("decimal(38,0)")).cast("long").alias("matched_amount_minor"))


def summary_rows(result: Result) -> DataFrame:
    """Per currency: matched_count, matched_amount_minor, and maps of discrepancy counts and amounts by type (null where there are none)."""
    by = summary_by(result, "currency", "type").groupBy("currency").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "discrepancy_count")))).alias("discrepancy_counts"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "discrepancy_amount_minor")))).alias("discrepancy_amounts"))
    out = matched_by_currency(result).join(by, "currency", "full")
    return out.fillna(0, ["matched_count", "matched_amount_minor"])


def group_rows(result: Result) -> DataFrame:
    """One row a group with its members as an array of structs, in order of record ids."""
    rows = result.groups.select("*", F.posexplode("record_ids").alias("place", "record_id"))
    seen = result.records.select("record_id", "role", "external_id", money.render(F.col("amount_minor"), F.col("scale")).alias("amount"), F.col("currency").alias("member_currency"), "scale", timeparse.render_ns(F.col("ts_ns")).alias("timestamp_utc")).dropDuplicates(["record_id"])
    member = F.struct("place", "record_id", "role", "external_id", "amount", F.col("member_currency").alias("currency"), "timestamp_utc")
    out = rows.join(seen, "record_id", "left").groupBy("match_group_id", "type", "currency", "amount_minor", "score_tuple").agg(F.max("scale").alias("scale"), F.array_sort(F.collect_list(member)).alias("members"))
    return out.withColumn("amount", money.render(F.col("amount_minor"), F.coalesce("scale", F.lit(2)))).drop("scale")


def content_digest(result: Result, revision: int) -> DataFrame:
    """One row, digest: sorted group and discrepancy ids with the totals.

    The ids of a run are gathered into one text, as the format asks; it is meant for runs whose report is read whole; ``short_digest`` has its hash alone.
    """
    g = result.groups.agg(F.array_join(F.array_sort(F.collect_list("match_group_id")), ",").alias("g"), F.count("*").alias("n"), F.coalesce(F.sum("amount_minor"), F.lit(0)).alias("v"))
    d = result.discrepancies.agg(F.array_join(F.array_sort(F.collect_list("discrepancy_id")), ",").alias("d"))
    text = F.concat(F.lit("groups:"), "g", F.lit("|discs:"), "d", F.lit("|matched="), F.col("n").cast("string"), F.lit("|amt="), F.col("v").cast("string"), F.lit(f"|rule={revision}"))
    return g.crossJoin(d).select(text.alias("digest"))  # two frames of one row each


def _id_blocks(ids: DataFrame) -> DataFrame:
    """(part, seq, text) of ``ids`` (part, id): the ids of each part in order, joined by commas, ``BLOCK_IDS`` at most a row; seq is the order of a part's blocks."""

    def join(batches):
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            parts, names = batch.column("part").to_numpy(), batch.column("id").to_pylist()
            cuts = sorted({*range(0, len(names), BLOCK_IDS), int(parts.searchsorted(parts[-1])) if len(names) else 0, len(names)})
            for s, e in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_pylist([{"part": int(parts[s]), "seq": n, "text": ",".join(names[s:e])}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("text", pa.string())]))
                n += 1

    count = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.where("id is not null").repartitionByRange(count, "part", "id").sortWithinPartitions("part", "id").mapInArrow(join, "part int, seq long, text string")


def short_digest(result: Result, revision: int) -> DataFrame:
    """One row, digest: the first sixteen digits of the SHA-256 of what ``content_digest`` gives, whose text no row gathers.

    Ids are sorted range by range and joined in blocks; one task, since the hash is a chain, takes the blocks in turn, some at a time.
    """
    spark = result.groups.sparkSession
    blocks = _id_blocks(result.groups.select(F.lit(1).alias("part"), F.col("match_group_id").alias("id")).union(result.discrepancies.select(F.lit(3), "discrepancy_id")))
    fixed = lambda part, text: spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(text).alias("text"))
    total = result.groups.agg(F.count("*").cast("string").alias("n"), F.coalesce(F.sum("amount_minor"), F.lit(0)).cast("string").alias("v"))
    tail = total.select(F.lit(4), F.lit(0).cast("long"), F.concat(F.lit("|matched="), "n", F.lit("|amt="), "v", F.lit(f"|rule={revision}")))
    ordered = blocks.union(fixed(0, "groups:")).union(fixed(2, "|discs:")).union(tail).repartition(1).sortWithinPartitions("part", "seq")

    def digest(batches):
        h, last = hashlib.sha256(), None
        for batch in batches:
            for part, text in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                h.update(("," + text if part == last else text).encode())
                last = part
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()[:16]])], ["digest"])

    return ordered.mapInArrow(digest, "digest string")


def mergeable_digest(result: Result) -> DataFrame:
    """(kind, n, hash_sum): of groups and of discrepancies, their number and the sum of sixty bits of their ids' SHA-256.

    Sums of parts add up, so it needs no order and no row that gathers all ids.
    """
    ids = result.groups.select(F.lit("groups").alias("kind"), F.col("match_group_id").alias("id")).union(result.discrepancies.select(F.lit("discrepancies"), "discrepancy_id"))
    bits = F.conv(F.substring(F.sha2("id", 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return ids.groupBy("kind").agg(F.count("*").alias("n"), F.sum(bits).alias("hash_sum"))


def csv_rows(result: Result) -> DataFrame:
    """(currency, type, sort_key, line): the CSV report's lines without header and footer, a row a discrepancy."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\r\n]|^ '), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(F.col(c), F.lit("")))
    line = F.concat_ws(",", *map(quoted, CSV_HEADER))
    return discrepancy_rows(result).select("currency", "type", "sort_key", line.alias("line"))


def _ordered_text(parts: list[DataFrame], path: str) -> None:
    """Write lines of (part, o1, o2, o3, line) in order, range by range, as text files that make up one text in the order of their names. A path that exists raises."""
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    lines.orderBy("part", "o1", "o2", "o3").select("line").write.mode("errorifexists").text(path)


def _line(spark, part: int, text: str) -> DataFrame:
    return spark.range(1).select(F.lit(part).alias("part"), *[F.lit("").alias(c) for c in ("o1", "o2", "o3")], F.lit(text).alias("line"))


def _in_part(rows: DataFrame, part: int, order: tuple[str, ...], line: Column) -> DataFrame:
    names = [F.col(c).alias(n) for c, n in zip(order, ("o1", "o2", "o3"))] + [F.lit("").alias(n) for n in ("o1", "o2", "o3")[len(order) :]]
    return rows.select(F.lit(part).alias("part"), *names, line.alias("line"))


def _totals(result: Result) -> DataFrame:
    """One row: n, v of groups and d, the number of discrepancies."""
    g = result.groups.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("amount_minor").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("v"))
    return g.crossJoin(result.discrepancies.agg(F.count("*").alias("d")))  # two frames of one row each


def write_csv(result: Result, path: str, revision: int) -> None:
    """The CSV report as text files: the first begins with the header, the last ends with the summary line. Nothing passes through the driver."""
    spark = result.records.sparkSession
    footer = F.concat(F.lit("# summary matched="), F.col("n").cast("string"), F.lit(" matched_amount_minor="), "v", F.lit(" discrepancies="), F.col("d").cast("string"), F.lit(f" rule_revision={revision}"))
    last = _totals(result).select(F.lit(2).alias("part"), *[F.lit("").alias(c) for c in ("o1", "o2", "o3")], footer.alias("line"))
    _ordered_text([_line(spark, 0, ",".join(CSV_HEADER)), _in_part(csv_rows(result), 1, ("currency", "type", "sort_key"), F.col("line")), last], path)


def group_views(result: Result) -> DataFrame:
    """(match_group_id, view): each group as the JSON text of the report."""
    member = lambda m: F.struct(*[F.coalesce(m[c], F.lit("")).alias(c) for c in ("record_id", "role", "external_id", "amount", "currency", "timestamp_utc")])
    view = F.struct("match_group_id", "type", "currency", "amount_minor", "amount", F.transform("members", member).alias("members"), "score_tuple")
    return group_rows(result).select("match_group_id", F.to_json(view).alias("view"))


def discrepancy_views(result: Result) -> DataFrame:
    """(discrepancy_id, currency, type, sort_key, view): each discrepancy as the JSON text of the report; empty values and zeros of evidence are left out."""
    seen = result.records.select("record_id", "external_id", "stable_key", money.render(F.col("amount_minor"), F.coalesce("scale", F.lit(2))).alias("amount_string")).dropDuplicates(["record_id"])
    tied = result.discrepancies.where("type = 'ambiguous'").select("discrepancy_id", "score_tuple", F.posexplode("candidate_ids").alias("at", "record_id")).join(seen, "record_id")
    candidate = F.struct("record_id", "external_id", "amount_string", "score_tuple", "stable_key")
    tied = tied.groupBy("discrepancy_id").agg(F.array_sort(F.collect_list(F.struct("at", candidate.alias("c")))).alias("t")).select("discrepancy_id", F.transform("t", lambda x: x["c"]).alias("candidates"))
    some = lambda c: F.when(c.cast("string") != "", c)
    e = evidence_rows(result).join(tied, "discrepancy_id", "left")
    amount = F.when(F.col("amount_minor") != 0, F.col("amount_minor"))
    time = F.when(F.col("type") != "ambiguous", some(timeparse.render_ns(F.col("ts_ns"))))
    piece = F.struct("record_id", some(F.col("role")).alias("role"), amount.alias("amount_minor"), some(money.render(F.col("amount_minor"), F.coalesce("scale", F.lit(2)))).alias("amount_string"), some(F.col("currency")).alias("currency"), time.alias("timestamp"), some(F.col("timestamp_raw")).alias("timestamp_raw"), some(F.col("external_id")).alias("external_id"), "candidates")
    pieces = e.groupBy("discrepancy_id").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("e")))).alias("p"))
    rows = discrepancy_rows(result).join(pieces, "discrepancy_id")
    view = F.struct("discrepancy_id", "type", "currency", some(F.col("note")).alias("note"), F.transform("p", lambda x: x["e"]).alias("evidence"), "sort_key")
    return rows.select("discrepancy_id", "currency", "type", "sort_key", F.to_json(view).alias("view"))


def write_json(result: Result, path: str, run_id: str, generated_at: str, revision: int, batch_ids: list[str]) -> None:
    """The JSON report as text files, a group or a discrepancy a line; put together they are one JSON text. Only the summary, a row a currency, is made on the driver."""
    spark = result.records.sparkSession
    text = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    batch_ids = sorted(batch_ids)
    head = {"run_id": run_id, "generated_at": generated_at, "rule_revision": revision, "batch_ids": batch_ids}
    summary = _summary(result, run_id, generated_at, revision, batch_ids)

    def listed(rows: DataFrame, part: int, order: tuple[str, ...]) -> DataFrame:
        first = rows.agg(F.min(F.struct(*order)).alias("first"))  # one row
        return _in_part(rows.crossJoin(F.broadcast(first)), part, order, F.concat(F.when(F.struct(*order) == F.col("first"), F.lit("")).otherwise(F.lit(",")), F.col("view")))

    _ordered_text(
        [
            _line(spark, 0, text(head)[:-1] + ',"match_groups":['),
            listed(group_views(result), 1, ("match_group_id",)),
            _line(spark, 2, '],"discrepancies":['),
            listed(discrepancy_views(result), 3, ("currency", "type", "sort_key")),
            _line(spark, 4, f'],"summary":{text(summary)}}}'),
        ],
        path,
    )


def freeze(result: Result, path: str) -> None:
    """Write a report once: its groups, summary and CSV lines in report order, range by range; a path that exists raises."""
    group_rows(result).orderBy("match_group_id").write.mode("errorifexists").parquet(f"{path}/groups")
    summary_rows(result).orderBy("currency").write.mode("errorifexists").parquet(f"{path}/summary")
    csv_rows(result).orderBy("currency", "type", "sort_key").write.mode("errorifexists").parquet(f"{path}/discrepancies")


def _summary(result: Result, run_id: str, generated_at: str, revision: int, batch_ids: list[str]) -> dict:
    """The summary of a report, from a row a currency."""
    ordered = lambda m: dict(sorted(m.items())) if m else None
    rows = [r.asDict() for r in summary_rows(result).orderBy("currency").collect()]  # a row a currency
    totals: dict[str, dict] = {"discrepancy_counts": {}, "discrepancy_amounts": {}}
    for r in rows:
        for name, total in totals.items():
            for k, v in (r[name] or {}).items():
                total[k] = total.get(k, 0) + v
    return {
        "run_id": run_id,
        "matched_count": sum(r["matched_count"] for r in rows),
        "matched_amount_minor": sum(r["matched_amount_minor"] for r in rows),
        "discrepancy_counts": dict(sorted(totals["discrepancy_counts"].items())),
        "discrepancy_amounts": dict(sorted(totals["discrepancy_amounts"].items())),
        "by_currency": {r["currency"]: {"currency": r["currency"], "matched_count": r["matched_count"], "matched_amount_minor": r["matched_amount_minor"], "discrepancy_counts": ordered(r["discrepancy_counts"]), "discrepancy_amounts": ordered(r["discrepancy_amounts"])} for r in rows},
        "generated_at": generated_at,
        "rule_revision": revision,
        "batch_ids": batch_ids,
    }


def build(result: Result, run_id: str, generated_at: str, revision: int, batch_ids: list[str]) -> dict:
    """The report as nested Python values in output order; for runs whose report a person reads."""
    ev = evidence_rows(result).withColumns({"amount_string": money.render(F.col("amount_minor"), F.coalesce("scale", F.lit(2))), "timestamp": timeparse.render_ns(F.col("ts_ns"))})
    pieces: dict[str, list] = {}
    for r in ev.orderBy("discrepancy_id", "place").toLocalIterator():
        pieces.setdefault(r.discrepancy_id, []).append(r)
    named = {r.record_id: r for r in result.discrepancies.select(F.explode("candidate_ids").alias("record_id")).distinct().join(result.records, "record_id").select("record_id", "external_id", "stable_key", money.render(F.col("amount_minor"), F.col("scale")).alias("amount")).toLocalIterator()}
    keys = {r.discrepancy_id: r.sort_key for r in discrepancy_rows(result).toLocalIterator()}
    views = []
    for found in pieces.values():
        first = found[0]
        evidence = []
        for r in found:
            e = {"record_id": r.record_id, "role": r.role, "amount_minor": r.amount_minor, "amount_string": r.amount_string, "currency": r.currency, "timestamp": r.timestamp, "timestamp_raw": r.timestamp_raw, "external_id": r.external_id}
            if first.type == "ambiguous":
                del e["timestamp"]
                e["candidates"] = [{"record_id": c, "external_id": named[c].external_id, "amount_string": named[c].amount, "score_tuple": list(r.score_tuple), "stable_key": named[c].stable_key} for c in r.candidate_ids]
            evidence.append({k: v for k, v in e.items() if v})
        view = {"discrepancy_id": first.discrepancy_id, "type": first.type, "currency": first.currency, "note": first.note, "evidence": evidence, "sort_key": keys[first.discrepancy_id]}
        views.append({k: v for k, v in view.items() if k != "note" or v})
    views.sort(key=lambda d: (d["currency"].encode(), d["type"].encode(), d["sort_key"].encode()))
    groups = []
    for r in group_rows(result).orderBy("match_group_id").toLocalIterator():
        members = [{k: m[k] or "" for k in ("record_id", "role", "external_id", "amount", "currency", "timestamp_utc")} for m in r.members]
        groups.append({"match_group_id": r.match_group_id, "type": r.type, "currency": r.currency, "amount_minor": r.amount_minor, "amount": r.amount, "members": members, "score_tuple": list(r.score_tuple)})
    batch_ids = sorted(batch_ids)
    summary = _summary(result, run_id, generated_at, revision, batch_ids)
    return {"run_id": run_id, "generated_at": generated_at, "rule_revision": revision, "batch_ids": batch_ids, "match_groups": groups, "discrepancies": views, "summary": summary}


def to_json(report: dict) -> str:
    """Compact JSON with a line feed; <, > and & are escaped."""
    text = json.dumps(report, ensure_ascii=False, separators=(",", ":"))
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text + "\n"


def to_csv(report: dict) -> str:
    """A row a discrepancy under a fixed header, then the summary line."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(CSV_HEADER)
    for d in report["discrepancies"]:
        w.writerow([d["discrepancy_id"], d["type"], d["currency"], d.get("note", ""), ";".join(e["record_id"] for e in d["evidence"]), d["sort_key"]])
    s = report["summary"]
    out.write(f"# summary matched={s['matched_count']} matched_amount_minor={s['matched_amount_minor']} discrepancies={len(report['discrepancies'])} rule_revision={report['rule_revision']}\n")
    return out.getvalue()
