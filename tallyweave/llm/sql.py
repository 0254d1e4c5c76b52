"""DuckDB SQL for the corpus queries that SQL can express, written from their definitions and not from the operators."""

from __future__ import annotations

OP2_WARC = r"""
with sized as (
  select page_id::bigint as page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
firsts as (
  select payload_digest, min(page_id) as first_id from sized where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to
from sized left join firsts using (payload_digest)
"""

# A word: lower-cased ASCII letters, digits, and all beyond ASCII. Windows are 10 words, near is within 30.
OP5_DECONTAMINATION = r"""
with docs as (
  select row_number() over () as r, doc_id::bigint as doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words
  from documents),
items as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark where text is not null),
windows as (
  select row_number() over () as w, item, words[i:i + 9] as words
  from (select item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from items where len(words) > 0)),
-- phrase matches: windows of documents as long as some window of an item
lengths as (select distinct len(words) as n from windows),
places as (
  select r, n, i, words[i:i + n - 1] as words
  from (select r, words, n, unnest(range(1, len(words) - n + 2)) as i from docs, lengths where len(words) >= n)),
found as (select distinct r, item, i, n from places join windows using (words)),
hit as (select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + n)) as word from found) group by r),
held as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from found group by r),
-- proximity: all distinct words of a window within thirty words of a document
terms as (select distinct w, unnest(words) as word from windows),
sizes as (select w, count(*) as k from terms group by w),
tokens as (
  select r, word, p from (select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as p from docs)
  where word in (select word from terms)),
-- per document and window that hold all words in common: places of its rarest word there, then every word around them
df as (select r, word, count(*) as n from tokens group by r, word),
whole as (
  select r, w, arg_min(word, (n, word)) as rarest from df join terms using (word) join sizes using (w)
  group by r, w having count(*) = any_value(k)),
around as (
  select t.r, whole.w, t.p as place, u.word, u.p
  from whole join tokens t on t.r = whole.r and t.word = whole.rarest
  join terms x on x.w = whole.w
  join tokens u on u.r = t.r and u.word = x.word and u.p between t.p - 29 and t.p + 29),
full_places as (
  select r, w, place from around join sizes using (w) group by r, w, place having count(distinct word) = any_value(k)),
near as (
  select distinct a.r, a.w from around a join full_places using (r, w, place) join sizes using (w)
  join around b on b.r = a.r and b.w = a.w and b.place = a.place and b.p between a.p and a.p + 29
  group by a.r, a.w, a.place, a.p having count(distinct b.word) = any_value(k)),
near_items as (select r, count(distinct item) as n_near from near join windows using (w) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from docs left join hit using (r) left join held using (r) left join near_items using (r)
"""

# Kinds in their order. Patterns are those of the contract, then public formats; a test on the match's length follows where there is one.
_SECRETS = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{}', 2)) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", r"[0-9a-f]+", "length(m) >= 24"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[0-9A-Za-z_-]{35}", None),
    ("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", None),
)


def _matches(ordinal: int, kind: str, pattern: str, test: str | None) -> str:
    """(r, ordinal, kind, first, past) of a pattern's matches: each stands after the texts between the matches and the matches before it."""
    return f"""
  select r, {ordinal} as ordinal, '{kind}' as kind, past - length(m) as first, past from (
    select r, m, sum(length(gap) + length(m)) over (partition by r order by i) as past from (
      select r, unnest(range(1, len(ms) + 1)) as i, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap from (
        select r, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as gaps from docs)))
  {"where " + test.replace("{}", pattern) if test else ""}"""


OP9_SECRETS = f"""
with docs as (select row_number() over () as r, doc_id::bigint as doc_id, coalesce(text, '') as text from documents),
spans as ({" union all ".join(_matches(i, *rule) for i, rule in enumerate(_SECRETS))}),
joined as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || first || ':' || past, ',' order by first, ordinal) filter (ordinal < 3) as base,
    string_agg(kind || ':' || first || ':' || past, ',' order by first, ordinal) as spans
  from spans group by r)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (r)
"""

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (f"{p}::uhugeint" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_SEED = "42::uhugeint"


def _low(x: str) -> str:
    """``x`` modulo 2^64, in 128 bits without sign."""
    return f"(({x}) & 18446744073709551615::uhugeint)"


def _left(x: str, bits: int) -> str:
    """The 64 bits of ``x`` rotated to the left."""
    return f"({_low(f'{x} << {bits}')} | ({x} >> {64 - bits}))"


def _round(x: str) -> str:
    return _low(f"{_left(x, 31)} * {_P1}")


def _little_endian(start: str, size: int) -> str:
    """The number that ``size`` bytes from a byte (counted from 0) of the hexadecimal text ``hx`` are."""
    return "('0x' || " + " || ".join(f"hx[2 * ({start} + {i}) + 1 : 2 * ({start} + {i}) + 2]" for i in reversed(range(size))) + ")::ubigint::uhugeint"


_STARTS = (f"({_SEED} + {_P1} + {_P2})", f"({_SEED} + {_P2})", _SEED, f"({_SEED} + 18446744073709551616::uhugeint - {_P1})")
_STRIPES = ", ".join(f"list_reduce(list_prepend({_low(start)}, [lanes[4 * k + {i + 1}] for k in range(n // 32)]), lambda a, x: {_round(_low('a + x'))}) as v{i}" for i, start in enumerate(_STARTS))
_MERGED = _low(" + ".join(_left(f"v{i}", bits) for i, bits in enumerate((1, 7, 12, 18))))
for _i in range(4):
    _MERGED = f"[{_low(f'xor(x, {_round(_low(f"v{_i} * {_P2}"))}) * {_P1} + {_P4}')} for x in [{_MERGED}]][1]"

OP7_SIMHASH = f"""
with recursive docs as (
  select row_number() over () as r, doc_id::bigint as doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as words
  from documents),
shingles as (
  select r, array_to_string(words[i:i + 2], ' ') as s
  from (select r, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) as i from docs where len(words) > 0)),
-- XXH64 of each shingle, on numbers of 128 bits cut to 64
bytes as (select s, strlen(s)::bigint as n, hex(encode(s)) as hx from (select distinct s from shingles)),
lanes as (select s, n, hx, [{_low(f"{_little_endian('8 * k', 8)} * {_P2}")} for k in range(n // 8)] as lanes from bytes),
stripes as (select *, {_STRIPES} from lanes),
merged as (
  select s, n, hx, lanes, {_low(f"case when n >= 32 then {_MERGED} else {_SEED} + {_P5} end + n::uhugeint")} as h
  from stripes),
eights as (
  select s, n, hx, list_reduce(list_prepend(h, [{_round("x")} for x in lanes[n // 32 * 4 + 1:]]), lambda h, x: {_low(f"{_left('xor(h, x)', 27)} * {_P1} + {_P4}")}) as h
  from merged),
fours as (
  select s, n, hx, case when n % 8 >= 4 then {_low(f"{_left(f'xor(h, {_low(f"{_little_endian('n // 8 * 8', 4)} * {_P1}")})', 23)} * {_P2} + {_P3}")} else h end as h
  from eights),
ones as (
  select s, list_reduce(list_prepend(h, [{_low(f"{_little_endian('k', 1)} * {_P5}")} for k in range(n // 4 * 4, n)]), lambda h, x: {_low(f"{_left('xor(h, x)', 11)} * {_P1}")}) as h
  from fours),
first_mix as (select s, {_low(f"xor(h, h >> 33) * {_P2}")} as h from ones),
second_mix as (select s, {_low(f"xor(h, h >> 29) * {_P3}")} as h from first_mix),
hashes as (select s, xor(h, h >> 32)::ubigint as h from second_mix),
-- a bit is set if over half of a document's shingles set it
fingerprints as (
  select r, {" + ".join(f"case when 2 * sum((h >> {i}) & 1) > count(*) then {1 << i}::ubigint else 0::ubigint end" for i in range(64))} as fp
  from shingles join hashes using (s) group by r),
marked as (select doc_id, coalesce(fp, 0::ubigint) as fp from docs left join fingerprints using (r)),
nodes as (select fp, min(doc_id) as low from marked group by fp),
links as (select a.fp as a, b.fp as b from nodes a join nodes b on bit_count(xor(a.fp, b.fp)::uhugeint::bit) <= 3),
reached as (select fp, fp as other from nodes union select reached.fp, b from reached join links on other = a),
components as (select reached.fp, min(low) as component_id from reached join nodes on nodes.fp = other group by reached.fp)
select doc_id, lpad(lower(to_hex(fp)), 16, '0') as fingerprint, component_id from marked join components using (fp)
"""

def _flow(name: str, seeds: str, moves: str) -> str:
    """Personalised PageRank by rounds, 0.85 passed on: (host, flow, k). A hundred rounds leave less than a ten-millionth of the mass."""
    return f"""
{name} as (
  select host, 0.15::double * {seeds} as flow, 0 as k from counts where {seeds} > 0
  union all
  select dst, sum(0.85::double * flow * share), k + 1 from {name} join {moves} using (host) where k < 100 group by dst, k)"""


_SHARES = "select {0} as host, {1} as dst, n / sum(n) over (partition by {0}) as share from edges"

OP10_URL_FILTER = rf"""
with recursive parts as (
  select page_id, html, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') as raw_host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
split as (select page_id, html, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host from parts),
ruled as (
  select *, case
    when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
    when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
    when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
    when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
    when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule
  from split),
known as (select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as rule_verdict from ruled),
counts as (
  select host, (count(*) filter (rule_verdict = 'allow'))::double as good, (count(*) filter (rule_verdict = 'block'))::double as bad
  from known where host <> '' group by host),
-- links between hosts, and one both ways between a crawled host and the crawled host it is one label below
links as (
  select host as src, translate(regexp_extract(link, '^[^/]*//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
  from (select host, unnest(regexp_extract_all(html, '\b(?:[hH][rR][eE][fF]|[sS][rR][cC])\s*=\s*["'']?((?:[hH][tT][tT][pP][sS]?:)?//[^"''\s>]+)', 1)) as link from known)),
sites as (
  select c.host as child, p.host as parent from counts c join counts p on p.host = regexp_extract(c.host, '^[^.]+\.(.+)$', 1)),
edges as (
  select src, dst, count(*)::double as n from (
    select src, dst from links where src <> '' and dst <> '' and src <> dst
    union all select child, parent from sites union all select parent, child from sites)
  group by src, dst),
forward as ({_SHARES.format("src", "dst")}),
backward as ({_SHARES.format("dst", "src")}),
{_flow("trust", "good", "forward")},
{_flow("distrust", "bad", "backward")},
scores as (
  select host, sum(good) as trust, sum(bad) as distrust
  from (select host, flow as good, 0 as bad from trust union all select host, 0, flow from distrust) group by host)
select page_id, host, path, rule, coalesce(rule_verdict, case when distrust > trust then 'block' else 'allow' end) as verdict
from known left join scores using (host)
"""

# CRC-32 of an id's decimal text, a bit at a time
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, z: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"

OP12_PREFIX_TRIE = f"""
with own as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as place
  from conversations where conv_id is not null),
heads as (select conv_id, {_CRC} % 6 as h from (select distinct conv_id from own)),
taken as (select c.conv_id, o.place as depth, o.role, o.text from heads c join own o on o.conv_id = c.conv_id - c.conv_id % 100 and o.place <= c.h),
sizes as (select c.conv_id, c.h, count(t.depth) as m from heads c left join taken t using (conv_id) group by 1, 2),
turns as (
  select * from taken
  union all select o.conv_id, o.place - s.h + s.m, o.role, o.text from own o join sizes s using (conv_id) where o.place > s.h),
-- a node is known by the hash of the hashes of its turns
hashed as (select conv_id, depth, length(text) as chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by depth rows unbounded preceding)) as node from turns),
members as materialized (
  select conv_id, 0 as depth, 'root' as node, null as parent, 0 as chars from heads
  union all select conv_id, depth, node, coalesce(lag(node) over (partition by conv_id order by depth), 'root'), chars from hashed),
nodes as materialized (select node, min(depth) as depth, min(parent) as parent, min(conv_id) as owner, count(*) as n_convs, min(chars) as chars from members group by node),
kids as (select parent as node, count(*) as n_children from nodes where parent is not null group by 1),
weighed as (select n.*, coalesce(n_children, 0) as n_children, case when n_children is null then 1 else 0 end as leaf, (n_convs - 1) * chars as saved from nodes n left join kids using (node)),
-- a node's owner passes all nodes above it
sums as (select p.node, sum(w.leaf) as n_leaves, sum(w.saved) as saved_tokens from weighed w join members p on p.conv_id = w.owner and p.depth <= w.depth group by p.node),
ends as (select node, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends_sha256 from (select conv_id, arg_max(node, depth) as node from members group by 1) group by 1)
select w.owner as conv_id, w.depth::bigint as depth, u.owner as parent_conv_id, w.n_convs, w.n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, coalesce(e.ends_sha256, sha256('')) as ends_sha256
from weighed w join sums s using (node) left join ends e using (node) left join nodes u on u.node = w.parent
"""

ORACLE_SQL = {"op2_warc": OP2_WARC, "op5_decontamination": OP5_DECONTAMINATION, "op7_simhash": OP7_SIMHASH, "op9_secrets": OP9_SECRETS, "op10_url_filter": OP10_URL_FILTER, "op12_prefix_trie": OP12_PREFIX_TRIE}
