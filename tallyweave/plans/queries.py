"""Registered queries of the reconciliation engine and, where SQL can say it, their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, money, timeparse
from ..functions.lineage import cut, shared_path
from ..operators import dedup, matching, merkle, report
from ..operators.rangejoin import islands
from ..sources import feeds, payments
from ..streaming import arrivals
from . import engine
from . import late as late_run
from .rules import DEFAULT_RULE, OneToMany, Rule, Tolerance

WINDOW = DEFAULT_RULE.window_ns
LINES_RULE = Rule("lines", ("bank", "processor"), Tolerance(1), Tolerance(), 600_000_000_000, {}, OneToMany("bank", "processor", 3))
FILE_ROWS = 250_000  # of a feed's file, since its digest needs the content in one row
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


# Records


@query
def normalize_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of line prices in many spellings, parsed as USD."""
    li = payments.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("m"), (F.col("l_partkey") % 8).alias("kind"))
    plain = F.concat(F.expr("m div 100").cast("string"), F.lit("."), F.lpad((F.col("m") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("kind") == 1, F.concat(F.lit("+"), plain)).when(F.col("kind") == 2, F.concat(F.lit("-"), plain)).when(F.col("kind") == 3, F.concat(F.lit("  "), plain, F.lit(" "))).when(F.col("kind") == 4, F.concat(plain, F.lit("5"))).when(F.col("kind") == 5, F.concat(plain, F.lit("0"))).when(F.col("kind") == 6, F.concat(plain, F.lit("e3"))).when(F.col("kind") == 7, F.concat(F.expr("m div 100").cast("string"), F.lit("."))).otherwise(plain)
    got = li.withColumn("p", money.parse(text, F.lit(2)))
    return got.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("p.minor").alias("minor"), F.col("p.code").alias("code"), money.render(F.col("p.minor"), F.lit(2)).alias("rendered"))


@query
def rounding_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three digits after the point, brought to two by each mode."""
    o = payments.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("m"))
    text = F.concat(F.expr("m div 1000").cast("string"), F.lit("."), F.lpad((F.col("m") % 1000).cast("string"), 3, "0"))
    return o.select("o_orderkey", *[money.parse(text, F.lit(2), mode)["minor"].alias(mode) for mode in ("trunc", "half_up", "half_even")])


@query
def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.payments(spark, sf_dir).select("role", "external_id", "source_line", "content_hash", "record_id", "stable_key")


@query
def currency_partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments.payments(spark, sf_dir).groupBy("role", "currency").agg(F.count("*").alias("n_records"), F.sum("amount_minor").alias("amount_minor"), F.sum("fee_minor").alias("fee_minor"), F.countDistinct("business_id").alias("n_business_ids"))


@query
def batch_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, sum and digest of each batch; batches are one day's feed of a role."""
    p = payments.payments(spark, sf_dir).withColumn("batch_id", F.concat_ws("-", F.lit("b"), "role", F.expr("ts_ns div 86400000000000").cast("string")))
    return feeds.batch_summary(p).select("batch_id", "record_count", "valid_count", "amount_sum_minor", "content_digest")


@query
def events_ndjson_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as NDJSON lines through field mapping and normalisation."""
    rows = payments.event_lines(spark, sf_dir)
    source = feeds.Source("events", "internal", format="ndjson")
    records = feeds.normalise(feeds.logical_fields(rows, source), source, "b-events")
    return records.select("source_line", "external_id", "business_id", "amount_minor", "ts_ns", "memo", "isolated")


@query
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested number of the events' properties as text, its digits kept."""
    e = payments.table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "string").alias("k"))


# Duplicates


def _layer(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return dedup.layer(payments.resent(spark, sf_dir), kind).select("relation_id", "canonical_id", "duplicate_id", "duplicate_batch", "source_id")

    run.__name__ = f"dedup_{kind}"
    return query(run)


for _kind in dedup.KEYS:
    _layer(_kind)


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cut(payments.payments(spark, sf_dir))
    return dedup.without_excluded(p, dedup.detect(p, DEFAULT_RULE))


@query
def excluded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payments.resent(spark, sf_dir)
    kept = dedup.without_excluded(p, dedup.detect(p, DEFAULT_RULE))
    return kept.groupBy("role", "batch_id").agg(F.count("*").alias("n_kept"), F.sum("amount_minor").alias("amount_minor"))


# Matching


@query
def match_exact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matching.exact_id_groups(_active(spark, sf_dir))
    return g.select("match_group_id", "currency", "amount_minor", _joined("record_ids"))


@query
def exact_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = matching.exact_id_groups(payments.payments(spark, sf_dir))
    return g.groupBy("currency").agg(F.count("*").alias("n_groups"), F.sum("amount_minor").alias("amount_minor"), F.sum(F.size("record_ids")).alias("n_records"))


def _free(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = _active(spark, sf_dir)
    groups, left = matching.exact_id_phase(active)
    return matching.without_exact(active, groups.select(F.explode("record_ids").alias("record_id")), left=left)


@query
def tolerance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = matching.tolerance_candidates(_free(spark, sf_dir), DEFAULT_RULE)
    return e.select("a_record_id", "b_record_id", "currency", *[F.col("score_tuple")[i].alias(c) for i, c in ((1, "amount_diff"), (2, "time_diff_ns"), (3, "fee_diff"))])


@query
def tolerance_candidates_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with a bound in basis points alone."""
    rule = replace(DEFAULT_RULE, amount=Tolerance(None, 1), fee=Tolerance())
    e = matching.tolerance_candidates(_free(spark, sf_dir), rule)
    return e.select("a_record_id", "b_record_id", "currency", F.col("score_tuple")[1].alias("amount_diff"))


@query
def ambiguous_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = matching.ambiguous(matching.tolerance_candidates(_free(spark, sf_dir), DEFAULT_RULE))
    return a.select("record_id", "currency", _joined("score_tuple"), _joined("candidate_ids"))


@query
def tolerance_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = matching.tolerance_phase(_free(spark, sf_dir), DEFAULT_RULE)
    return g.select("match_group_id", "currency", "amount_minor", _joined("record_ids"), _joined("score_tuple"))


@query
def one_to_many_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, _ = matching.one_to_many(payments.settlements(spark, sf_dir), LINES_RULE)
    return g.select("match_group_id", "anchor_role", "amount_minor", _joined("record_ids"), F.col("score_tuple")[1].alias("amount_diff"))


@query
def search_limit_discrepancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search cut at five combinations an anchor."""
    _, d = matching.one_to_many(payments.settlements(spark, sf_dir), replace(LINES_RULE, search_limit=5))
    return d.select("discrepancy_id", "type", _joined("record_ids"), "note")


@query
def shared_anchor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-many groups of a run of two rules, where each order's two anchors want members that the first may have taken."""
    g = engine.matched_groups(payments.settlements(spark, sf_dir, shared=True), [LINES_RULE, DEFAULT_RULE]).where("type = 'one_to_many'")
    return g.select("match_group_id", "amount_minor", _joined("record_ids"))


@query
def time_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time line of each currency cut at gaps of over two minutes."""
    x = islands(payments.payments(spark, sf_dir).select("currency", "ts_ns", "amount_minor"), ["currency"], WINDOW)
    return x.groupBy("currency", "island").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count("*").alias("n_records")).drop("island")


# Whole runs


def _run(spark: SparkSession, sf_dir: str) -> engine.Result:
    return engine.reconcile(payments.payments(spark, sf_dir), [DEFAULT_RULE])


@query
def classify_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _run(spark, sf_dir).discrepancies
    return d.where("type <> 'ambiguous'").select("discrepancy_id", "type", "currency", _joined("record_ids"))


@query
def missing_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _run(spark, sf_dir).discrepancies.where("type like 'missing%'")
    return d.groupBy("type", "currency").agg(F.count("*").alias("n"))


@query
def report_summary_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _run(spark, sf_dir)
    d = report.summary_by(r, "currency")
    return report.matched_by_currency(r).join(d, "currency", "full")


@query
def report_summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary_by(_run(spark, sf_dir), "type")


@query
def report_discrepancy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.discrepancy_rows(_run(spark, sf_dir)).select("discrepancy_id", "type", "currency", "evidence_record_ids", "sort_key")


@query
def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.short_digest(_run(spark, sf_dir), 1)


# SQL. Each constant is a chain of common table expressions that the next one goes on from.

_SQL_PAY = """
with base as (
  select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as m,
    (['USD','EUR','GBP','CNY','JPY'])[o_custkey % 5 + 1] as currency,
    epoch_us(o_orderdate) * 1000 + (o_orderkey * 37 % 86400) * 1000000000 as ns,
    case when o_orderkey % 4 <> 0 then 'BIZ' || o_orderkey else '' end as bid
  from orders),
raw as (
  select 'internal' as role, 0 as role_rank, 'INT' || k as external_id, bid as business_id, m as amount_minor, 0 as fee_minor, currency, ns as ts_ns, 1 + 4 * k as source_line from base where k % 29 <> 0
  union all select 'internal', 0, 'INT' || k, bid, m, 0, currency, ns, 2 + 4 * k from base where k % 101 = 0 and k % 29 <> 0
  union all select 'processor', 1, 'PRC' || k, bid, m + case when k % 4 = 0 then k % 13 - 6 else 0 end, case when k % 31 = 0 then 7 else 0 end, currency, ns + (k % 150) * 1000000000, 1 + 4 * k from base where k % 23 <> 0
  union all select 'processor', 1, 'PRC' || k || 'b', '', m + k % 13 - 6, case when k % 31 = 0 then 7 else 0 end, currency, ns + (k % 150) * 1000000000, 2 + 4 * k from base where k % 44 = 0 and k % 23 <> 0
  union all select 'bank', 2, 'BNK' || k, bid, m, 0, currency, ns + (k % 60) * 1000000000, 1 + 4 * k from base where k % 3 <> 0),
hashed as (
  select *, role as source_id, substr(sha256(role || '|' || currency || '|' || amount_minor || '|credit|' || ts_ns || '||' || business_id), 1, 16) as content_hash from raw),
pay as materialized (
  select *, 'b-' || role as batch_id, 0 as batch_ord, 'rec_' || substr(sha256(source_id || '|' || source_line || '|' || content_hash), 1, 16) as record_id,
    role || '|' || external_id || '|' || content_hash as stable_key
  from hashed)"""

_SQL_RESENT = (
    _SQL_PAY
    + """,
resent as (
  select * from pay union all
  select * replace ('b-resend' as batch_id, 1 as batch_ord) from pay where role = 'processor' and source_line // 4 % 50 = 0)"""
)


def _sql_layer(kind: str, source: str) -> str:
    keys = ", ".join(dedup.KEYS[kind])
    other = {"exact_key": "true", "content_fingerprint": "external_id <> c_ext", "retransmit": "batch_id <> c_batch"}[kind]
    w = f"(partition by {keys} order by stable_key, source_line, batch_ord, record_id, external_id, batch_id)"
    return f"""
select 'dup_' || substr(sha256('{kind}|' || least(c_id, record_id) || '|' || greatest(c_id, record_id)), 1, 16) as relation_id,
  c_id as canonical_id, record_id as duplicate_id, batch_id as duplicate_batch, source_id
from (select *, row_number() over {w} as rn, first_value(record_id) over {w} as c_id, first_value(external_id) over {w} as c_ext, first_value(batch_id) over {w} as c_batch from {source})
where rn > 1 and {other}"""


def _sql_active(source: str) -> str:
    return f""",
gone as (select duplicate_id, duplicate_batch from ({_sql_layer("exact_key", source)})),
active as materialized (select * from {source} p where not exists (select 1 from gone g where g.duplicate_id = p.record_id and g.duplicate_batch = p.batch_id))"""


_SQL_ACTIVE = _SQL_PAY + _sql_active("pay")

_SQL_EXACT = """,
firsts as (
  select *, row_number() over (partition by currency, business_id, role order by stable_key, source_line, batch_ord, record_id) as rn
  from {source} where business_id <> ''),
exact as materialized (
  select currency, business_id, string_agg(record_id, ',' order by record_id) as record_ids, min_by(amount_minor, role_rank) as amount_minor,
    'mg_' || substr(sha256(string_agg(record_id, chr(10) order by record_id) || chr(10)), 1, 16) as match_group_id, count(*) as n
  from firsts where rn = 1 group by 1, 2 having count(*) >= 2)"""

_SQL_FREE = (
    _SQL_ACTIVE
    + _SQL_EXACT.format(source="active")
    + """,
used as (select unnest(string_split(record_ids, ',')) as record_id from exact),
free as materialized (select * from active where record_id not in (select record_id from used))"""
)

_PAIR = "b.ts_ns between a.ts_ns - 120000000000 and a.ts_ns + 120000000000"
_SQL_EDGES = (
    _SQL_FREE
    + f""",
edges as materialized (
  select a.record_id as a_record_id, b.record_id as b_record_id, a.stable_key as a_key, b.stable_key as b_key, a.source_line as a_line, b.source_line as b_line, a.amount_minor as a_amount, a.currency,
    abs(a.amount_minor - b.amount_minor) as amount_diff, abs(a.ts_ns - b.ts_ns) as time_diff_ns, abs(a.fee_minor - b.fee_minor) as fee_diff
  from free a join free b on a.currency = b.currency and a.role_rank < b.role_rank and {_PAIR}
  where abs(a.amount_minor - b.amount_minor) <= 5 and abs(a.fee_minor - b.fee_minor) <= 0)"""
)

_SQL_TIED = (
    _SQL_EDGES
    + """,
ends as (
  select a_record_id as record_id, currency, b_record_id as other, b_key as other_key, b_line as other_line, amount_diff, time_diff_ns, fee_diff from edges
  union all select b_record_id, currency, a_record_id, a_key, a_line, amount_diff, time_diff_ns, fee_diff from edges),
placed as (select *, rank() over (partition by record_id order by amount_diff, time_diff_ns, fee_diff) as r from ends),
tied as materialized (
  select record_id, currency, '1,' || any_value(amount_diff) || ',' || any_value(time_diff_ns) || ',' || any_value(fee_diff) as score_tuple, string_agg(other, ',' order by other_key, other_line, other) as candidate_ids
  from placed where r = 1 group by 1, 2 having count(*) >= 2)"""
)

ROUNDS = 6


def _sql_won() -> str:
    order = "amount_diff, time_diff_ns, fee_diff, a_key, b_key, a_line, b_line, a_record_id, b_record_id"
    out = f""",
left0 as materialized (select *, row_number() over (order by {order}) as o from edges where a_record_id not in (select record_id from tied) and b_record_id not in (select record_id from tied))"""
    for i in range(ROUNDS):
        out += f""",
best{i} as (select n, min(o) as m from (select a_record_id as n, o from left{i} union all select b_record_id, o from left{i}) group by 1),
won{i} as materialized (select e.* from left{i} e join best{i} x on x.n = e.a_record_id join best{i} y on y.n = e.b_record_id where x.m = o and y.m = o),
left{i + 1} as materialized (select * from left{i} where a_record_id not in (select a_record_id from won{i} union all select b_record_id from won{i}) and b_record_id not in (select a_record_id from won{i} union all select b_record_id from won{i}))"""
    return out + ",\nwon as materialized (" + " union all ".join(f"select * from won{i}" for i in range(ROUNDS)) + ")"


_SQL_WON = _SQL_TIED + _sql_won()

_SQL_DISC = (
    _SQL_WON
    + f""",
rest as materialized (
  select * from free where record_id not in (select a_record_id from won union all select b_record_id from won union all select record_id from tied)),
near as (
  select a.record_id as l, b.record_id as r, abs(a.amount_minor - b.amount_minor) as ad, abs(a.fee_minor - b.fee_minor) as fd,
    row_number() over (partition by a.record_id order by abs(a.amount_minor - b.amount_minor), b.source_id, b.source_line, b.batch_ord, b.record_id) as rn
  from rest a join active b on a.currency = b.currency and a.role <> b.role and {_PAIR}),
t as materialized (select * from near where rn = 1),
far as (
  select a.record_id as l, b.record_id as r,
    row_number() over (partition by a.record_id order by abs(a.ts_ns - b.ts_ns), b.source_id, b.source_line, b.batch_ord, b.record_id) as rn
  from rest a join active b on a.currency = b.currency and a.role <> b.role and b.amount_minor between a.amount_minor - 5 and a.amount_minor + 5 and a.fee_minor = b.fee_minor
  where a.record_id not in (select l from t)),
judged as (
  select p.record_id, p.currency, p.role,
    case when t.r is not null and t.ad > 5 then 'amount_mismatch' when t.r is not null and t.fd > 0 then 'fee_mismatch' when t.r is null and f.r is not null then 'time_mismatch'
      when p.role = 'processor' then 'missing_internal' else 'missing_processor' end as type, t.r as tr, f.r as fr
  from rest p left join t on t.l = p.record_id left join (select * from far where rn = 1) f on f.l = p.record_id),
named as (select type, currency, record_id, case when type in ('amount_mismatch', 'fee_mismatch') then tr when type = 'time_mismatch' then fr end as other, null as cands from judged),
disc as materialized (
  select 'disc_' || substr(sha256(type || chr(10) || record_id || chr(10) || case when other is null then '' else other || chr(10) end), 1, 16) as discrepancy_id,
    type, currency, record_id || case when other is null then '' else ',' || other end as record_ids from named
  union all
  select 'disc_' || substr(sha256('ambiguous' || chr(10) || record_id || chr(10) || replace(candidate_ids, ',', chr(10)) || chr(10)), 1, 16), 'ambiguous', currency, record_id from tied),
pieces as (select *, unnest(string_split(record_ids, ',')) as record_id, generate_subscripts(string_split(record_ids, ','), 1) as place from disc),
evidence as materialized (select d.*, p.amount_minor, p.stable_key from pieces d join active p using (record_id)),
matched as (select currency, amount_minor, match_group_id from exact union all select currency, a_amount, 'mg_' || substr(sha256(least(a_record_id, b_record_id) || chr(10) || greatest(a_record_id, b_record_id) || chr(10)), 1, 16) from won)"""
)

_SQL_LINES = """
with lines as (
  select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) as rn,
    cast(round(l_extendedprice * 100) as bigint) as v from lineitem),
raw as (
  select 'processor' as role, k, rn, 'LIN' || k || '-' || lpad(rn::varchar, 2, '0') as external_id, v as amount_minor, k * 3600000000000 + rn * 1000000000 as ts_ns, k * 100 + rn as source_line from lines
  union all select 'bank', k, 0, 'SET' || k, sum(v) filter (rn <= 3), k * 3600000000000, k * 100 from lines group by k),
recs as materialized (
  select *, 'rec_' || substr(sha256(role || '|' || source_line || '|' || substr(sha256(role || '|USD|' || amount_minor || '|credit|' || ts_ns || '||'), 1, 16)), 1, 16) as record_id from raw),
m as (select * from recs where role = 'processor'),
a as (select * from recs where role = 'bank'),
sizes as (select k, count(*) as n from m group by k),
subsets as materialized (
  select x.k, 2 as size, x.rn as r1, y.rn as r2, 0 as r3, x.amount_minor + y.amount_minor as total, [x.record_id, y.record_id] as members from m x join m y on x.k = y.k and x.rn < y.rn
  union all
  select x.k, 3, x.rn, y.rn, z.rn, x.amount_minor + y.amount_minor + z.amount_minor, [x.record_id, y.record_id, z.record_id] from m x join m y on x.k = y.k and x.rn < y.rn join m z on y.k = z.k and y.rn < z.rn),
numbered as (select *, row_number() over (partition by k order by size, r1, r2, r3) as place from subsets),
valid as (select s.*, a.record_id as anchor, a.amount_minor as want, row_number() over (partition by s.k order by place) as rn from numbered s join a on a.k = s.k where abs(a.amount_minor - s.total) <= 1)"""

ORACLE_SQL = {
    "normalize_amounts": """
with x as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) as m, l_partkey % 8 as kind from lineitem),
y as (select *, case kind when 2 then -m when 4 then null when 6 then null when 7 then m // 100 * 100 else m end as minor, case kind when 4 then 'too_many_digits' when 6 then 'bad_format' end as code from x)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, minor, code, case when minor < 0 then '-' else '' end || (abs(minor) // 100) || '.' || lpad((abs(minor) % 100)::varchar, 2, '0') as rendered from y""",
    "rounding_modes": """
with x as (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as m from orders)
select o_orderkey, m // 10 as trunc, m // 10 + case when m % 10 >= 5 then 1 else 0 end as half_up,
  m // 10 + case when m % 10 > 5 or (m % 10 = 5 and (m // 10) % 2 = 1) then 1 else 0 end as half_even from x""",
    "record_identity": _SQL_PAY + " select role, external_id, source_line, content_hash, record_id, stable_key from pay",
    "currency_partition_summary": _SQL_PAY + " select role, currency, count(*) as n_records, sum(amount_minor)::bigint as amount_minor, sum(fee_minor)::bigint as fee_minor, count(distinct business_id) as n_business_ids from pay group by 1, 2",
    "batch_content_digest": _SQL_PAY + " select 'b-' || role || '-' || (ts_ns // 86400000000000) as batch_id, count(*) as record_count, count(*) as valid_count, sum(amount_minor)::bigint as amount_sum_minor, substr(sha256(string_agg(record_id, chr(10) order by record_id) || chr(10)), 1, 16) as content_digest from pay group by 1",
    "events_ndjson_normalize": """
select event_id as source_line, 'EVT' || event_id as external_id, 'U' || user_id as business_id, cast(cast(value as decimal(18,2)) * 100 as bigint) as amount_minor, epoch_us(ts) * 1000 as ts_ns, event_type as memo, false as isolated from events""",
    "json_projection": "select event_id, json_extract_string(props, '$.k') as k from events",
    **{f"dedup_{k}": _SQL_RESENT + _sql_layer(k, "resent") for k in dedup.KEYS},
    "excluded_records": _SQL_RESENT + _sql_active("resent") + " select role, batch_id, count(*) as n_kept, sum(amount_minor)::bigint as amount_minor from active group by 1, 2",
    "match_exact_id": _SQL_ACTIVE + _SQL_EXACT.format(source="active") + " select match_group_id, currency, amount_minor, record_ids from exact",
    "exact_match_summary": _SQL_PAY + _SQL_EXACT.format(source="pay") + " select currency, count(*) as n_groups, sum(amount_minor)::bigint as amount_minor, sum(n)::bigint as n_records from exact group by 1",
    "tolerance_candidates": _SQL_EDGES + " select a_record_id, b_record_id, currency, amount_diff, time_diff_ns, fee_diff from edges",
    "tolerance_candidates_percent": _SQL_FREE + f" select a.record_id as a_record_id, b.record_id as b_record_id, a.currency, abs(a.amount_minor - b.amount_minor) as amount_diff from free a join free b on a.currency = b.currency and a.role_rank < b.role_rank and {_PAIR} where abs(a.amount_minor - b.amount_minor)::hugeint * 10000 <= abs(greatest(a.amount_minor, b.amount_minor))",
    "ambiguous_records": _SQL_TIED + " select record_id, currency, score_tuple, candidate_ids from tied",
    "tolerance_matches": _SQL_WON + " select 'mg_' || substr(sha256(least(a_record_id, b_record_id) || chr(10) || greatest(a_record_id, b_record_id) || chr(10)), 1, 16) as match_group_id, currency, a_amount as amount_minor, least(a_record_id, b_record_id) || ',' || greatest(a_record_id, b_record_id) as record_ids, '1,' || amount_diff || ',' || time_diff_ns || ',' || fee_diff as score_tuple from won",
    "one_to_many_matches": _SQL_LINES + ", won as (select *, list_sort(list_append(members, anchor)) as ids from valid where rn = 1) select 'mg_' || substr(sha256(array_to_string(ids, chr(10)) || chr(10)), 1, 16) as match_group_id, 'bank' as anchor_role, want::bigint as amount_minor, array_to_string(ids, ',') as record_ids, abs(want - total)::bigint as amount_diff from won",
    "search_limit_discrepancies": _SQL_LINES + ", found as (select k, min(place) as place from valid group by k), total as (select k, count(*) as n from subsets group by k), stopped as (select t.k from total t left join found f using (k) where t.n > 5 and coalesce(f.place, 6) > 5), ids as (select s.k, any_value(a.record_id) as anchor, string_agg(m.record_id, ',' order by m.record_id) as others from stopped s join a on a.k = s.k join m on m.k = s.k group by s.k) select 'disc_' || substr(sha256('search_limit' || chr(10) || anchor || chr(10) || replace(others, ',', chr(10)) || chr(10)), 1, 16) as discrepancy_id, 'search_limit' as type, anchor || ',' || others as record_ids, 'combination search limit exceeded' as note from ids",
    "time_islands": _SQL_PAY + ", cuts as (select currency, ts_ns, case when ts_ns - lag(ts_ns) over (partition by currency order by ts_ns) > 120000000000 then 1 else 0 end as c from pay), numbered as (select *, sum(c) over (partition by currency order by ts_ns range unbounded preceding) as island from cuts) select currency, min(ts_ns) as first_ns, max(ts_ns) as last_ns, count(*) as n_records from numbered group by currency, island",
    "classify_leftovers": _SQL_DISC + " select discrepancy_id, type, currency, record_ids from disc where type <> 'ambiguous'",
    "missing_by_role": _SQL_DISC + " select type, currency, count(*) as n from disc where type like 'missing%' group by 1, 2",
    "report_summary_by_currency": _SQL_DISC + " select * from (select currency, count(*) as matched_count, sum(amount_minor)::bigint as matched_amount_minor from matched group by 1) full join (select currency, count(distinct discrepancy_id) as discrepancy_count, sum(amount_minor)::bigint as discrepancy_amount_minor from evidence group by 1) using (currency)",
    "report_summary_by_type": _SQL_DISC + " select type, count(distinct discrepancy_id) as discrepancy_count, sum(amount_minor)::bigint as discrepancy_amount_minor from evidence group by 1",
    "report_discrepancy_rows": _SQL_DISC + " select discrepancy_id, type, currency, string_agg(record_id, ';' order by place) as evidence_record_ids, currency || '|' || type || '|' || string_agg(stable_key, '|' order by place) as sort_key from evidence group by 1, 2, 3",
    "report_digest": _SQL_DISC + " select substr(sha256('groups:' || (select string_agg(match_group_id, ',' order by match_group_id) from matched) || '|discs:' || (select string_agg(discrepancy_id, ',' order by discrepancy_id) from disc) || '|matched=' || (select count(*) from matched) || '|amt=' || (select sum(amount_minor) from matched) || '|rule=1'), 1, 16) as digest",
}


# Feeds as texts in the shared folder, read back as any feed would be


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """The orders as a CSV feed with quotes, breaks and bad cells at fixed strides."""
    k, m = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    plain = F.concat(F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string"), F.lit("."), F.lpad((m % 100).cast("string"), 2, "0"))
    rows = payments.spread(payments.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")).select(
        F.when(k % 37 == 0, "").otherwise(F.concat(F.lit("EXT"), k.cast("string"))).alias("external_id"),
        F.when(k % 41 == 0, "abc").when(k % 43 == 0, F.concat(plain, F.lit("5"))).otherwise(plain).alias("amount"),
        F.when(k % 47 == 0, "XXX").when(k % 3 == 0, "eur").otherwise("").alias("currency"),
        F.when(k % 53 == 0, "sideways").when(k % 2 == 0, " Credit").otherwise("debit").alias("direction"),
        F.when(k % 59 == 0, "").when(k % 61 == 0, "nope").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'03:04:05'Z'")).alias("timestamp"),
        F.when(k % 5 == 0, F.concat(F.lit('say "hi", '), k.cast("string"), F.lit("\nsecond line"))).otherwise(F.concat(F.lit(" plain "), k.cast("string"), F.lit(" "))).alias("memo"),
        F.concat(F.lit("BIZ"), k.cast("string")).alias("business_id"),
    )
    path = shared_path(spark)
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.options(**options).option("maxRecordsPerFile", FILE_ROWS).csv(path)
    return path


_CSV_SOURCE = feeds.Source("orders", "internal")
_NAMED_SOURCE = feeds.Source("named", "bank", "EUR", "Asia/Shanghai", field_map={"external_id": "Ref, No", "amount": "Gross", "timestamp": "Booked at", "memo": "Text", "business_id": "Key"})
_RECORD = ("external_id", "business_id", "amount_minor", "currency", "direction", "ts_ns", "memo")


@query
def csv_feed_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records of a CSV feed."""
    return feeds.read_feed(spark, _csv_folder(spark, sf_dir), _CSV_SOURCE, "b").where("error is null").select(*_RECORD)


@query
def csv_feed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed errors of a CSV feed, counted by field and code."""
    bad = feeds.read_feed(spark, _csv_folder(spark, sf_dir), _CSV_SOURCE, "b").where("error is not null")
    return bad.groupBy(F.col("error.field").alias("field"), F.col("error.code").alias("code")).agg(F.count("*").alias("n"), F.sum(F.length("error.value")).alias("value_chars"))


@query
def csv_feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of orders under other column names, with the line of every record: cells hold line breaks, so lines are counted over the splits of a file."""
    k = F.col("o_orderkey")
    amount = F.concat(F.expr("cast(round(o_totalprice * 100) as bigint) div 100").cast("string"), F.lit("."), F.lpad((F.round(F.col("o_totalprice") * 100).cast("long") % 100).cast("string"), 2, "0"))
    # what is sorted are keys and numbers; texts are made of them afterwards
    sorted_ = payments.table(spark, sf_dir, "orders").select((k % 8).alias("file"), "o_orderkey", "o_totalprice", "o_orderdate").repartition(8, "file").sortWithinPartitions("file", "o_orderkey")
    rows = sorted_.select(
        "file",
        F.concat(F.lit("REF"), k.cast("string")).alias("Ref, No"),
        F.when(k % 3 == 0, F.concat(F.lit('one "'), k.cast("string"), F.lit('",\r\ntwo\n\nthree'))).otherwise("plain").alias("Text"),
        F.when(k % 11 == 0, "").otherwise(amount).alias("Gross"),
        F.lit("unused").alias("amount"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Booked at"),
        F.concat(F.lit(" BIZ"), k.cast("string")).alias("Key"),
    )
    path = shared_path(spark)
    options = {"header": True, "quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    rows.write.partitionBy("file").options(**options).csv(path)
    read = feeds.read_feed(spark, path, _NAMED_SOURCE, "b")
    return read.select("source_line", "external_id", "business_id", "amount_minor", "currency", "ts_ns", "memo", F.col("error.field").alias("field"))


@query
def ndjson_feed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of an NDJSON feed with blank lines, lines that are no objects and bytes that aren't UTF-8."""
    k = F.col("event_id")
    memo = F.when(k % 31 == 0, F.concat(F.lit("caf"), F.unhex(F.lit("FF")).cast("string"))).otherwise(F.col("event_type"))
    name = F.when(k % 29 == 0, "").otherwise(F.concat(F.lit('"external_id":"EVT'), k.cast("string"), F.lit('",')))
    text = F.concat(F.lit("{"), name, F.lit('"amount":'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(',"timestamp":"2026-01-02","memo":"'), memo, F.lit('"}'))
    lines = payments.table(spark, sf_dir, "events").select(F.when(k % 17 == 0, "not json").when(k % 19 == 0, "[1]").when(k % 23 == 0, " \r").otherwise(text).alias("value"))
    path = shared_path(spark)
    lines.write.text(path)
    rows = feeds.read_feed(spark, path, feeds.Source("events", "bank", format="ndjson"), "b")
    return rows.select("external_id", "amount_minor", "memo", F.col("error.field").alias("field"), F.col("error.code").alias("code"))


@query
def stream_ingest_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV feed as files that arrive, read by a stream until none is left."""
    target, checkpoint = shared_path(spark), shared_path(spark)
    arrivals.ingest_stream(spark, _csv_folder(spark, sf_dir), _CSV_SOURCE, target, checkpoint, "*.csv", available_now=True).awaitTermination()
    return spark.read.parquet(target).where("not isolated").select(*_RECORD)


@query
def stream_arrivals_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feeds of one source that arrive by streams of their own in one target; the second stream delivers all of the first's files again."""
    target, (first, second) = shared_path(spark), (shared_path(spark) for _ in range(2))
    k = F.col("o_orderkey")
    feed = payments.table(spark, sf_dir, "orders").select(F.concat(F.lit("EXT"), k.cast("string")).alias("external_id"), F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string").alias("amount"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd").alias("timestamp"), (k % 5 == 0).alias("late"))
    feed.where("not late").drop("late").write.option("header", True).option("maxRecordsPerFile", FILE_ROWS).csv(first)
    feed.where("late").drop("late").write.option("header", True).option("maxRecordsPerFile", FILE_ROWS).csv(second)
    for folders in ((first,), (first, second)):
        for folder in folders:
            arrivals.ingest_stream(spark, folder, _CSV_SOURCE, target, shared_path(spark), "*.csv", available_now=True).awaitTermination()
    return spark.read.parquet(target).groupBy("external_id").agg(F.count("*").alias("n"), F.min("amount_minor").alias("amount_minor"), F.min("ts_ns").alias("ts_ns"))


@query
def stream_without_retransmits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a stream in which every fiftieth order's are sent again, each kept once."""
    path, target = shared_path(spark), shared_path(spark)
    payments.resent(spark, sf_dir).write.parquet(path)
    kept = arrivals.without_retransmits(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), "100000 days")
    kept.select("record_id", "source_id", "amount_minor").writeStream.option("checkpointLocation", shared_path(spark)).trigger(availableNow=True).start(target, format="parquet").awaitTermination()
    return spark.read.parquet(target)


@query
def stream_closing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-id groups out of a stream of shuffled records, closed by the watermark; one record far in the future closes all others."""
    path, target = shared_path(spark), shared_path(spark)
    p = payments.payments(spark, sf_dir).select("record_id", "role_rank", "stable_key", "source_line", "batch_ord", "currency", "business_id", "amount_minor", "ts_ns", "isolated")  # all that groups are made of
    last = p.where("business_id <> ''").orderBy("record_id").limit(1).withColumns({"ts_ns": F.lit(4_000_000_000_000_000_000).cast("long"), "business_id": F.lit("the end")})
    p.repartition(F.xxhash64("record_id")).write.parquet(path)  # in any order, which needs no sort
    last.write.mode("append").parquet(path)
    groups = arrivals.closing_groups(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path), WINDOW, "20000 days")
    with arrivals.state_on_disk(spark):  # a micro-batch writes what it changed; a state in memory is copied whole
        stream = groups.writeStream.option("checkpointLocation", shared_path(spark)).trigger(availableNow=True).start(target, format="parquet")
    stream.awaitTermination()
    return spark.read.parquet(target).select("currency", "business_id", "type", _joined("record_ids"), "amount_minor")


@query
def stream_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal and processor records as two streams, joined on business id within the window under watermarks."""
    path, target, checkpoint = (shared_path(spark) for _ in range(3))
    for role in ("internal", "processor"):  # a folder each; written by partitions, all records of a task would be sorted
        payments.payments(spark, sf_dir).where(F.col("role") == role).select("record_id", "currency", "business_id", "amount_minor", "ts_ns").write.parquet(f"{path}/role={role}")
    side = lambda role: spark.readStream.schema(spark.read.parquet(f"{path}/role={role}").schema).parquet(f"{path}/role={role}")
    pairs = arrivals.match_stream(side("internal"), side("processor"), WINDOW)
    with arrivals.state_on_disk(spark):
        stream = pairs.select("a_record_id", "b_record_id", F.abs(F.col("a_ts_ns") - F.col("b_ts_ns")).alias("time_diff_ns")).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target, format="parquet")
    stream.awaitTermination()
    return spark.read.parquet(target)


# Expressions


@query
def timestamp_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' days in all layouts, in a zone eight hours ahead, and back to text."""
    day, kind = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.col("o_orderkey") % 9
    tails = ["T03:04:05Z", "T03:04:05.123456789Z", "T11:04:05+08:00", " 09:00:00", "T09:00:00.5", "", " 03:04:05+08:00", "Tnope", "T03:04:05-05:30 "]
    text = F.concat(day, F.element_at(F.array(*map(F.lit, tails)), (kind + 1).cast("int")))
    ns = timeparse.parse_ns(text, "Asia/Shanghai")
    return payments.table(spark, sf_dir, "orders").select("o_orderkey", ns.alias("ns")).select("o_orderkey", F.col("ns").cast("string").alias("ts_ns"), timeparse.render_ns(F.col("ns")).alias("rendered"))


@query
def duration_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("long")
    ns = F.when(k % 4 == 0, k % 1000).when(k % 4 == 1, k * 7 % 1_000_000).when(k % 4 == 2, k * 1_234_567 % 60_000_000_000).otherwise(k * 1_234_567_891 % 40_000_000_000_000)
    return payments.table(spark, sf_dir, "orders").select("o_orderkey", ns.alias("ns")).withColumn("text", timeparse.render_duration(F.col("ns")))


@query
def tolerance_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences against the smaller of two bounds, against one, and against none."""
    base, diff = F.expr("cast(round(o_totalprice * 100) as bigint) div 400"), (F.col("o_orderkey") % 9).cast("long")
    kinds = {"both": (5, 1), "absolute": (5, None), "percent": (None, 1), "none": (None, None)}
    return payments.table(spark, sf_dir, "orders").select("o_orderkey", *[money.compare_tolerance(diff, base, *v).alias(c) for c, v in kinds.items()])


@query
def money_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked sums and differences of the orders' amounts with others, some of another currency or near the limits."""
    k, m = F.col("o_orderkey").cast("long"), F.round(F.col("o_totalprice") * 100).cast("long")
    other = F.when(k % 10 == 0, F.lit(2**63 - 1).cast("long")).when(k % 10 == 1, F.lit(-(2**63)).cast("long")).otherwise(k * 100)
    own, theirs = F.lit("USD"), F.when(k % 7 == 0, "EUR").otherwise("USD")
    out = payments.table(spark, sf_dir, "orders").select("o_orderkey", *[f(m, other, own, theirs).alias(n) for n, f in (("s", money.add), ("d", money.subtract), ("a", money.abs_diff))], money.compare(m, other, own, theirs).alias("order"))
    return out.select("o_orderkey", "order", *[F.col(f"{c}.minor").cast("string").alias(n) for c, n in (("s", "total"), ("d", "difference"), ("a", "distance"))], *[F.col(f"{c}.code").alias(f"{n}_code") for c, n in (("s", "total"), ("d", "difference"), ("a", "distance"))])


# More of duplicates, rules and reports


@query
def commit_retransmits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the batch that was sent again, with their twins of the batch before."""
    p = payments.resent(spark, sf_dir)
    return dedup.retransmits(p.where("batch_id = 'b-resend'"), p.where("batch_id = 'b-processor'"))


@query
def suspected_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.suspected(payments.payments(spark, sf_dir), WINDOW)


STRICT_RULE = replace(DEFAULT_RULE, rule_id="strict", allowed_roles=("internal", "bank"), amount=Tolerance(0), fee=Tolerance(), window_ns=0)


@query
def two_rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a run of two rules: equal amounts at equal times of two roles first, then the default rule on what is left."""
    g = engine.matched_groups(payments.payments(spark, sf_dir), [STRICT_RULE, DEFAULT_RULE])
    return g.select("match_group_id", "type", "currency", "amount_minor", _joined("record_ids"))


@query
def late_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and discrepancies after a late batch, out of the run before it: every fortieth order's records and some processor records of others come late."""
    p = payments.payments(spark, sf_dir).withColumn("late", F.expr("source_line div 4 % 40 = 7 or role = 'processor' and source_line div 4 % 37 = 3"))
    p = cut(p)
    early, late = (p.where(c).drop("late") for c in ("not late", "late"))
    r = late_run.late_batch(engine.reconcile(early, [DEFAULT_RULE], written=True), early, late, [DEFAULT_RULE])
    groups = r.groups.select(F.col("match_group_id").alias("id"), "type", "currency", _joined("record_ids"))
    return groups.unionByName(r.discrepancies.select(F.col("discrepancy_id").alias("id"), "type", "currency", _joined("record_ids")))


@query
def invalid_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated rows of an NDJSON feed as discrepancies with their evidence."""
    source = feeds.Source("events", "internal", format="ndjson")
    rows = feeds.logical_fields(payments.event_lines(spark, sf_dir), source)
    rows = rows.withColumn("amount", F.when(F.col("line") % 50 != 0, F.col("amount")))
    r = engine.reconcile(feeds.normalise(rows, source, "b-events").drop("error"), [DEFAULT_RULE], emit_invalid=True)
    e = report.evidence_rows(r).where("type = 'invalid_record'")
    return e.select("discrepancy_id", "currency", "note", "record_id", "role", "amount_minor", "stable_key")


@query
def report_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the CSV report, notes included."""
    return report.csv_rows(_run(spark, sf_dir)).select("line")


@query
def report_digest_mergeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = report.mergeable_digest(_run(spark, sf_dir))
    return d.select("kind", "n", F.col("hash_sum").cast("string").alias("hash_sum"))


@query
def report_csv_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CSV report written as ordered text files and read back, header and summary line included."""
    path = shared_path(spark)
    report.write_csv(_run(spark, sf_dir), path, 1)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def batch_merkle_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest for each role's batch, from a tree of digests."""
    ids_ = payments.payments(spark, sf_dir).select("batch_id", F.col("record_id").alias("id"))
    return merkle.roots(ids_, ["batch_id"], 2)


@query
def changed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a batch and the same batch with some amounts corrected and some records gone, found by digests."""
    p = payments.payments(spark, sf_dir)
    later = p.where("source_line % 997 <> 0").withColumn("amount_minor", F.when(F.col("source_line") % 499 == 0, F.col("amount_minor") + 1).otherwise(F.col("amount_minor")))
    of = lambda x: cut(x.select("batch_id", F.col("record_id").alias("id")))
    before, after = of(p), of(ids.with_identity(later))
    return merkle.differences(before, after, ["batch_id"], merkle.leaf_depth(before.count()))


_SQL_FEED = """
with base as (
  select o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as m, epoch_us(o_orderdate) * 1000 as day_ns from orders),
cells as (
  select *, case when k % 37 = 0 then 'external_id' when k % 47 = 0 then 'currency' when k % 41 = 0 or k % 43 = 0 then 'amount' when k % 53 = 0 then 'direction' when k % 59 = 0 or k % 61 = 0 then 'timestamp' end as field,
    case when k % 37 = 0 then 'missing' when k % 47 = 0 then 'unknown_currency' when k % 41 = 0 then 'bad_format' when k % 43 = 0 then 'too_many_digits' when k % 53 = 0 then 'invalid' when k % 59 = 0 then 'missing' when k % 61 = 0 then 'invalid' end as code,
    case when k % 37 = 0 then 0 when k % 47 = 0 or k % 41 = 0 then 3 when k % 43 = 0 then length((m // 100)::varchar) + 4 when k % 53 = 0 then 8 when k % 59 = 0 then 0 when k % 61 = 0 then 4 end as value_chars
  from base)"""

_SQL_FEED_RECORDS = (
    _SQL_FEED
    + """
select 'EXT' || k as external_id, 'BIZ' || k as business_id, m as amount_minor, case when k % 3 = 0 then 'EUR' else 'USD' end as currency, case when k % 2 = 0 then 'credit' else 'debit' end as direction,
  day_ns + 11045000000000 as ts_ns, case when k % 5 = 0 then 'say "hi", ' || k || chr(10) || 'second line' else 'plain ' || k end as memo
from cells where field is null"""
)


def _sql_trimmed(value: str, unit: int) -> str:
    """Decimal text of ``value`` units without trailing zeros."""
    return f"rtrim(rtrim(({value} // {unit})::varchar || '.' || lpad(({value} % {unit})::varchar, {len(str(unit)) - 1}, '0'), '0'), '.')"


def _sql_duration(ns: str) -> str:
    second, minute, hour = 1_000_000_000, 60_000_000_000, 3_600_000_000_000
    tail = f"({_sql_trimmed(f'({ns} % {minute})', second)} || 's')"
    return f"case when {ns} = 0 then '0s' when {ns} < 1000 then {ns}::varchar || 'ns' when {ns} < 1000000 then {_sql_trimmed(ns, 1000)} || 'µs' when {ns} < {second} then {_sql_trimmed(ns, 1000000)} || 'ms' when {ns} < {minute} then {tail} when {ns} < {hour} then ({ns} // {minute})::varchar || 'm' || {tail} else ({ns} // {hour})::varchar || 'h' || ({ns} // {minute} % 60)::varchar || 'm' || {tail} end"


def _sql_amount(minor: str, currency: str) -> str:
    return f"case when {currency} = 'JPY' then {minor}::varchar else case when {minor} < 0 then '-' else '' end || (abs({minor}) // 100)::varchar || '.' || lpad((abs({minor}) % 100)::varchar, 2, '0') end"


_SQL_CHECKED = """
with x as (select o_orderkey, cast(round(o_totalprice * 100) as bigint)::hugeint as m, o_orderkey as k,
    case when o_orderkey % 10 = 0 then 9223372036854775807 when o_orderkey % 10 = 1 then -9223372036854775808 else o_orderkey * 100 end::hugeint as b from orders),
y as (select *, m + b as s, m - b as d, abs(m - b) as a from x)"""


def _sql_checked(v: str, name: str) -> str:
    good = f"{v} between -9223372036854775808::hugeint and 9223372036854775807::hugeint"
    return f"case when k % 7 <> 0 and {good} then {v}::varchar end as {name}, case when k % 7 = 0 then 'currency_mismatch' when not ({good}) then 'overflow' end as {name}_code"


_SQL_STRICT = (
    _SQL_ACTIVE
    + """,
firsts_a as (
  select *, row_number() over (partition by currency, business_id, role order by stable_key, source_line, batch_ord, record_id) as rn
  from active where business_id <> '' and role in ('internal', 'bank')),
exact_a as materialized (
  select currency, string_agg(record_id, ',' order by record_id) as record_ids, min_by(amount_minor, role_rank) as amount_minor from firsts_a where rn = 1 group by currency, business_id having count(*) >= 2),
free_a as materialized (select * from active where record_id not in (select unnest(string_split(record_ids, ',')) from exact_a)),
edges_a as materialized (
  select a.record_id as x, b.record_id as y, a.amount_minor, a.currency from free_a a join free_a b on a.role = 'internal' and b.role = 'bank' and a.currency = b.currency and a.ts_ns = b.ts_ns and a.amount_minor = b.amount_minor),
tied_a as (select n from (select x as n from edges_a union all select y from edges_a) group by n having count(*) >= 2),
won_a as materialized (select * from edges_a where x not in (select n from tied_a) and y not in (select n from tied_a)),
rest_a as materialized (select * from free_a where record_id not in (select x from won_a union all select y from won_a union all select n from tied_a))"""
    + _SQL_WON[len(_SQL_ACTIVE) :].replace("from active", "from rest_a")
)


def _sql_group(ids: str) -> str:
    return f"'mg_' || substr(sha256(replace({ids}, ',', chr(10)) || chr(10)), 1, 16)"


_SQL_PAIR_IDS = "least({0}, {1}) || ',' || greatest({0}, {1})"

ORACLE_SQL |= {
    "csv_feed_normalize": _SQL_FEED_RECORDS,
    "stream_ingest_feed": _SQL_FEED_RECORDS,
    "csv_feed_lines": """
with x as (select *, cast(round(o_totalprice * 100) as bigint) as m, row_number() over (partition by o_orderkey % 8 order by o_orderkey) as source_line from orders)
select source_line, case when o_orderkey % 11 = 0 then '' else 'REF' || o_orderkey end as external_id, case when o_orderkey % 11 = 0 then '' else 'BIZ' || o_orderkey end as business_id, case when o_orderkey % 11 = 0 then 0 else m end as amount_minor, 'EUR' as currency, epoch_us(o_orderdate) * 1000 as ts_ns,
  case when o_orderkey % 11 = 0 then '' when o_orderkey % 3 = 0 then 'one "' || o_orderkey || '",' || chr(13) || chr(10) || 'two' || chr(10) || chr(10) || 'three' else 'plain' end as memo, case when o_orderkey % 11 = 0 then 'amount' end as field from x""",
    "stream_closing_groups": _SQL_PAY
    + """,
firsts as (select *, row_number() over (partition by currency, business_id, role order by stable_key, source_line, batch_ord, record_id) as rn from pay where business_id <> '')
select currency, business_id, case when count(*) > 1 then 'exact_id' when min(role) = 'processor' then 'missing_internal' else 'missing_processor' end as type, string_agg(record_id, ',' order by record_id) as record_ids, min_by(amount_minor, role_rank) as amount_minor
from firsts where rn = 1 group by 1, 2""",
    "stream_arrivals_twice": "select 'EXT' || o_orderkey as external_id, 1::bigint as n, cast(round(o_totalprice * 100) as bigint) as amount_minor, epoch_us(o_orderdate) * 1000 as ts_ns from orders",
    "stream_without_retransmits": _SQL_PAY + " select record_id, source_id, amount_minor from (select *, row_number() over (partition by source_id, external_id, content_hash order by source_line) as rn from pay) where rn = 1",
    "csv_feed_errors": _SQL_FEED + " select field, code, count(*) as n, sum(value_chars)::bigint as value_chars from cells where field is not null group by 1, 2",
    "ndjson_feed_errors": """
with x as (select *, event_id % 17 = 0 or event_id % 19 = 0 as broken, event_id % 29 = 0 as nameless from events where event_id % 17 = 0 or event_id % 19 = 0 or event_id % 23 <> 0)
select case when broken or nameless then '' else 'EVT' || event_id end as external_id, case when broken or nameless then 0 else cast(cast(value as decimal(18,2)) * 100 as bigint) end as amount_minor,
  case when broken or nameless then '' when event_id % 31 = 0 then 'caf' || chr(65533) else event_type end as memo, case when broken then '_record' when nameless then 'external_id' end as field, case when broken then 'decode' when nameless then 'missing' end as code from x""",
    "stream_match": _SQL_PAY + " select a.record_id as a_record_id, b.record_id as b_record_id, abs(a.ts_ns - b.ts_ns) as time_diff_ns from pay a join pay b on a.role = 'internal' and b.role = 'processor' and a.business_id <> '' and a.business_id = b.business_id and a.currency = b.currency and abs(a.ts_ns - b.ts_ns) <= 120000000000",
    "timestamp_layouts": """
with x as (select o_orderkey, o_orderkey % 9 as kind, epoch_us(o_orderdate) as us from orders),
y as (select *, case kind when 0 then 11045000000 when 1 then 11045000000 when 2 then 11045000000 when 3 then 3600000000 when 4 then 3600500000 when 5 then -28800000000 when 8 then 30845000000 end as plus from x)
select o_orderkey, ((us + plus) * 1000 + case when kind = 1 then 123456789 else 0 end)::varchar as ts_ns,
  strftime(make_timestamp(us + plus), '%Y-%m-%dT%H:%M:%S') || case kind when 1 then '.123456789' when 4 then '.5' else '' end || 'Z' as rendered from y""",
    "duration_texts": f"with x as (select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey % 1000 when 1 then o_orderkey * 7 % 1000000 when 2 then o_orderkey * 1234567 % 60000000000 else o_orderkey * 1234567891 % 40000000000000 end as ns from orders) select o_orderkey, ns, {_sql_duration('ns')} as text from x",
    "tolerance_comparison": """
with x as (select o_orderkey, o_orderkey % 9 as d, cast(round(o_totalprice * 100) as bigint) // 400 // 10000 as p from orders)
select o_orderkey, sign(d - least(5, p))::int as both, sign(d - 5)::int as absolute, sign(d - p)::int as percent, sign(d)::int as none from x""",
    "money_arithmetic": _SQL_CHECKED + f" select o_orderkey, case when k % 7 <> 0 then sign(d)::int end as order, {_sql_checked('s', 'total')}, {_sql_checked('d', 'difference')}, {_sql_checked('a', 'distance')} from y".replace(" as order,", ' as "order",'),
    "commit_retransmits": _SQL_RESENT + " select a.record_id, b.record_id as earlier_id, b.batch_id as earlier_batch from resent a join resent b on a.batch_id = 'b-resend' and b.batch_id = 'b-processor' and a.source_id = b.source_id and a.external_id = b.external_id and a.content_hash = b.content_hash",
    "suspected_duplicates": _SQL_PAY + ", x as (select *, lag(record_id) over w as previous_id, lag(ts_ns) over w as t from pay window w as (partition by source_id, currency, amount_minor order by ts_ns, stable_key, source_line, batch_ord, record_id)) select record_id, previous_id from x where ts_ns - t <= 120000000000",
    "two_rule_groups": _SQL_STRICT
    + f" select {_sql_group('record_ids')} as match_group_id, 'exact_id' as type, currency, amount_minor, record_ids from (select currency, amount_minor, record_ids from exact_a union all select currency, amount_minor, record_ids from exact)"
    + f" union all select {_sql_group(_SQL_PAIR_IDS.format('x', 'y'))}, 'tolerance', currency, amount_minor, {_SQL_PAIR_IDS.format('x', 'y')} from won_a"
    + f" union all select {_sql_group(_SQL_PAIR_IDS.format('a_record_id', 'b_record_id'))}, 'tolerance', currency, a_amount, {_SQL_PAIR_IDS.format('a_record_id', 'b_record_id')} from won",
    "invalid_record_rows": "with x as (select 'rec_invalid_events_' || event_id as record_id, event_id from events where event_id % 50 = 0) select 'disc_' || substr(sha256('invalid_record' || chr(10) || record_id || chr(10)), 1, 16) as discrepancy_id, 'USD' as currency, 'amount: missing' as note, record_id, 'internal' as role, 0::bigint as amount_minor, 'internal|invalid|' || event_id as stable_key from x",
    "report_csv_lines": _SQL_DISC
    + f""",
keys as (select discrepancy_id, string_agg(stable_key, '|' order by place) as k from evidence group by 1),
noted as (
  select d.*, case d.type
    when 'amount_mismatch' then 'amounts differ by ' || abs(p.amount_minor - c.amount_minor) || ' minor units: ' || p.role || '=' || {_sql_amount('p.amount_minor', 'p.currency')} || ' ' || c.role || '=' || {_sql_amount('c.amount_minor', 'c.currency')}
    when 'fee_mismatch' then 'fees differ by ' || abs(p.fee_minor - c.fee_minor) || ' minor units: ' || p.role || '=' || {_sql_amount('p.fee_minor', 'p.currency')} || ' ' || c.role || '=' || {_sql_amount('c.fee_minor', 'c.currency')}
    when 'time_mismatch' then 'timestamps differ by ' || {_sql_duration('abs(p.ts_ns - c.ts_ns)')} || ': ' || p.role || '=' || p.ts_ns || ' ' || c.role || '=' || c.ts_ns
    when 'ambiguous' then 'two or more candidates tied at the best score; cannot auto-resolve'
    else 'no counterpart found for ' || p.role || ' record ' || p.external_id end as note
  from disc d join active p on p.record_id = split_part(d.record_ids, ',', 1) left join active c on c.record_id = split_part(d.record_ids, ',', 2))
select discrepancy_id || ',' || type || ',' || currency || ',' || note || ',' || replace(record_ids, ',', ';') || ',' || currency || '|' || type || '|' || k as line from noted join keys using (discrepancy_id)""",
    "batch_merkle_roots": _SQL_PAY
    + """,
leaves as (select batch_id, substr(sha256(record_id), 1, 2) as prefix, count(*) as n, sha256(string_agg(record_id, chr(10) order by record_id)) as digest from pay group by 1, 2),
middle as (select batch_id, substr(prefix, 1, 1) as prefix, sum(n) as n, sha256(string_agg(prefix || ':' || digest, chr(10) order by prefix)) as digest from leaves group by 1, 2)
select batch_id, sum(n)::bigint as n, sha256(string_agg(prefix || ':' || digest, chr(10) order by prefix)) as digest from middle group by 1""",
    "changed_records": _SQL_PAY
    + """,
later as (select batch_id, source_id, source_line, case when source_line % 499 = 0 then 'rec_' || substr(sha256(source_id || '|' || source_line || '|' || substr(sha256(role || '|' || currency || '|' || (amount_minor + 1) || '|credit|' || ts_ns || '||' || business_id), 1, 16)), 1, 16) else record_id end as id from pay where source_line % 997 <> 0)
select batch_id, record_id as id, 'a' as side from pay where record_id not in (select id from later) union all select batch_id, id, 'b' from later where id not in (select record_id from pay)""",
    "report_digest_mergeable": _SQL_DISC
    + ", ids as (select 'groups' as kind, match_group_id as id from matched union all select 'discrepancies', discrepancy_id from disc) select kind, count(*) as n, sum(('0x' || substr(sha256(id), 1, 15))::bigint::hugeint)::varchar as hash_sum from ids group by 1",
}

ORACLE_SQL["report_csv_file"] = (
    ORACLE_SQL["report_csv_lines"]
    + " union all select 'discrepancy_id,type,currency,note,evidence_record_ids,sort_key'"
    + " union all select '# summary matched=' || (select count(*) from matched) || ' matched_amount_minor=' || (select sum(amount_minor) from matched) || ' discrepancies=' || (select count(*) from disc) || ' rule_revision=1'"
)

ORACLE_SQL["late_batch_results"] = (
    _SQL_DISC
    + " select match_group_id as id, 'exact_id' as type, currency, record_ids from exact"
    + f" union all select {_sql_group(_SQL_PAIR_IDS.format('a_record_id', 'b_record_id'))}, 'tolerance', currency, {_SQL_PAIR_IDS.format('a_record_id', 'b_record_id')} from won"
    + " union all select discrepancy_id, type, currency, record_ids from disc"
)

ORACLE_SQL["shared_anchor_groups"] = (
    _SQL_LINES[: _SQL_LINES.index("raw as (")]
    + """raw as (
  select 'processor' as role, k, rn, 'LIN' || k || '-' || lpad(rn::varchar, 2, '0') as external_id, v as amount_minor, k * 3600000000000 + rn * 1000000000 as ts_ns, k * 100 + rn as source_line from lines
  union all select 'bank', k, 0, 'SETA' || k, sum(v) filter (rn <= 2), k * 3600000000000, k * 100 from lines group by k
  union all select 'bank', k, 99, 'SETB' || k, coalesce(sum(v) filter (rn between 3 - k % 2 and 4 - k % 2), 0), k * 3600000000000, k * 100 + 99 from lines group by k),
"""
    + _SQL_LINES[_SQL_LINES.index("recs as materialized") : _SQL_LINES.index("a as (select")]
    + """sizes as (select k, count(*) as n from m group by k),
"""
    + _SQL_LINES[_SQL_LINES.index("subsets as materialized") : _SQL_LINES.index("valid as (")].rstrip().rstrip(",")
    + """,
anchors as (select k, rn, record_id, amount_minor as want from recs where role = 'bank'),
one as (select s.k, s.members, a.record_id, a.want, row_number() over (partition by s.k order by place) as r from numbered s join anchors a on a.k = s.k and a.rn = 0 where abs(a.want - s.total) <= 1),
two as (select s.k, s.members, a.record_id, a.want, row_number() over (partition by s.k order by place) as r from numbered s join anchors a on a.k = s.k and a.rn = 99 left join one o on o.k = s.k and o.r = 1 where abs(a.want - s.total) <= 1 and not list_has_any(s.members, coalesce(o.members, []))),
won as (select list_sort(list_append(members, record_id)) as ids, want from one where r = 1 union all select list_sort(list_append(members, record_id)), want from two where r = 1)
select 'mg_' || substr(sha256(array_to_string(ids, chr(10)) || chr(10)), 1, 16) as match_group_id, want::bigint as amount_minor, array_to_string(ids, ',') as record_ids from won"""
)
