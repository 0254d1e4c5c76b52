"""Secret scans through a trigram inverted index (operator 9).

Every regular expression yields a Boolean query over the trigrams (of ASCII-lower-cased
bytes) that any match must contain, after Cox's "Regular Expression Matching with a Trigram
Index" (2012). The index is split by documents; a segment's postings are intersected and
united within it, candidates are verified with the expression itself, and rules without a
mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, own_columns, partitions, run_bounds, sorted_runs, text_bytes, text_slices, written

SLICE_BYTES = 768 << 10  # of a scan; so that keys mostly fit 32 bits
INDEX_BYTES = 4 << 20  # of a segment of a written index
MAX_STRINGS = 64  # exact strings that a part of a query may hold before it is cut to trigrams


class Rule:
    """A kind of secret: a pattern, and a test that a match must pass. Failing matches are dropped, not retried."""

    def __init__(self, kind: str, pattern: str, flags: int = 0, keep=None, prefilter: str | None = None):
        self.kind, self.pattern, self.flags, self.keep = kind, pattern, flags | re.ASCII, keep
        self.scan = prefilter or pattern  # an equivalent of pattern with its test that a scan finds faster

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in re.finditer(self.scan, text, self.flags) if self.keep is None or self.keep(m)]


# The base rules, then public formats of well-known tokens.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, lambda m: len(m[2]) >= 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    Rule("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24, r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
BASE_KINDS = ("assign", "access", "hex")


class Query:
    """True, or a conjunction or disjunction of trigrams and queries."""

    def __init__(self, op: str, parts: tuple = ()):
        self.op, self.parts = op, parts

    def __repr__(self) -> str:
        return {"all": "*"}.get(self.op) or "(" + {"and": " ", "or": "|"}[self.op].join(p if isinstance(p, str) else repr(p) for p in self.parts) + ")"


ALL = Query("all")


def both(a: Query, b: Query) -> Query:
    if a.op == "all" or b.op == "all":
        return b if a.op == "all" else a
    parts = [p for q in (a, b) for p in (q.parts if q.op == "and" else (q,))]
    return Query("and", tuple(dict.fromkeys(parts)))


def either(queries: list[Query]) -> Query:
    if any(q.op == "all" for q in queries):
        return ALL
    return queries[0] if len(queries) == 1 else Query("or", tuple(queries))


def trigrams_of(strings: set[str]) -> Query:
    """What a text with at least one of the strings must contain."""
    if not strings or min(map(len, strings)) < 3:
        return ALL
    return either([Query("and", tuple(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))) for s in sorted(strings)])


def _low(c: int) -> str:
    return chr(c).lower()


class _Info:
    """What is known of an expression's matches: all of them (exact), or their possible starts and ends; and a query."""

    def __init__(self, exact: set[str] | None, starts: set[str], ends: set[str], query: Query):
        self.exact, self.starts, self.ends, self.query = exact, starts, ends, query


def _settle(x: _Info) -> _Info:
    """Give up exactness where there are too many strings; keep edges short."""
    if x.exact is not None and len(x.exact) <= MAX_STRINGS:
        return x
    if x.exact is not None:
        x = _Info(None, x.exact, x.exact, both(x.query, trigrams_of(x.exact)))
    starts, ends = {s[:3] for s in x.starts}, {s[-3:] for s in x.ends}
    starts, ends = (starts if len(starts) <= MAX_STRINGS else {""}), (ends if len(ends) <= MAX_STRINGS else {""})
    return _Info(None, starts, ends, x.query)


def _join(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None:
        return _settle(_Info({x + y for x in a.exact for y in b.exact}, set(), set(), both(a.query, b.query)))
    a_ends, b_starts = a.exact if a.exact is not None else a.ends, b.exact if b.exact is not None else b.starts
    middle = {x + y for x in a_ends for y in b_starts} if len(a_ends) * len(b_starts) <= MAX_STRINGS else {""}
    starts = {x + y for x in a.exact for y in b.starts} if a.exact is not None else a.starts
    ends = {x + y for x in a.ends for y in b.exact} if b.exact is not None else b.ends
    return _settle(_Info(None, starts, ends, both(both(a.query, b.query), trigrams_of(middle))))


_ANY = _Info(None, {""}, {""}, ALL)


def _analyse(nodes) -> _Info:
    out = _Info({""}, set(), set(), ALL)
    for op, arg in nodes:
        if op is sre.LITERAL and arg < 128:
            part = _Info({_low(arg)}, set(), set(), ALL)
        elif op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg):
            chars = {_low(c) for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))}
            part = _Info(chars, set(), set(), ALL) if len(chars) <= 8 and max(chars) < chr(128) else _ANY
        elif op is sre.SUBPATTERN:
            part = _analyse(arg[3])
        elif op is sre.BRANCH:
            parts = [_analyse(x) for x in arg[1]]
            if all(p.exact is not None for p in parts):
                part = _settle(_Info(set().union(*(p.exact for p in parts)), set(), set(), ALL))
            else:
                edges = [[p.exact if p.exact is not None else e for p, e in ((p, getattr(p, side)) for p in parts)] for side in ("starts", "ends")]
                part = _settle(_Info(None, set().union(*edges[0]), set().union(*edges[1]), either([both(p.query, trigrams_of(p.exact)) if p.exact is not None else p.query for p in parts])))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _analyse(inner)
            if (low, high) == (0, 1) and one.exact is not None:
                part = _Info(one.exact | {""}, set(), set(), ALL)
            elif low == 0:
                part = _ANY
            elif low == high == 1:
                part = one
            else:
                starts, ends = (one.exact, one.exact) if one.exact is not None else (one.starts, one.ends)
                part = _settle(_Info(None, starts, ends, both(one.query, trigrams_of(one.exact)) if one.exact is not None else one.query))
        elif op is sre.AT:
            continue
        else:
            part = _ANY
        out = _join(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """The Boolean query of trigrams, in lower case, that every text with a match satisfies."""
    x = _analyse(sre_parse.parse(pattern))
    return both(x.query, trigrams_of(x.exact)) if x.exact is not None else both(x.query, both(trigrams_of(x.starts), trigrams_of(x.ends)))


def _number(trigram: str) -> int:
    a, b, c = trigram.encode("latin-1")
    return a << 16 | b << 8 | c


def query_trigrams(query: Query) -> set[int]:
    return set().union(*({_number(p)} if isinstance(p, str) else query_trigrams(p) for p in query.parts)) if query.parts else set()


def evaluate(query: Query, postings: dict[int, np.ndarray]) -> np.ndarray:
    """The ascending documents of a segment that satisfy a query other than ALL."""
    none = np.zeros(0, np.int64)
    lists = [postings.get(_number(p), none) if isinstance(p, str) else evaluate(p, postings) for p in query.parts]
    if query.op == "or":
        return np.unique(np.concatenate(lists))
    lists.sort(key=len)
    out = lists[0]
    for x in lists[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, x, assume_unique=True)
    return out


def slice_trigrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, document) of a slice of texts, without repeats, ascending: its postings, one list after the other."""
    bits = max(1, (len(texts) - 1).bit_length())
    kind = np.uint32 if bits <= 8 else np.uint64
    parts = []
    for i, text in enumerate(texts):
        if text and len(text) > 2:
            w = np.frombuffer(text.lower(), np.uint8).astype(np.uint32)
            parts.append(((w[:-2] << 16 | w[1:-1] << 8 | w[2:]).astype(kind) << kind(bits)) | kind(i))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.sort(np.concatenate(parts))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64)


def build_trigram_index(docs: DataFrame) -> DataFrame:
    """A written index of all trigrams of all texts, for scans with rules to come: (segment, trigram, postings), and one row a segment with its doc_ids.

    postings are a segment's ascending document ordinals, differences in 32 bits. A null or
    empty text has no trigrams. Other columns are ignored.
    """
    kinds = pa.schema([("segment", pa.int64()), ("trigram", pa.int32()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def index(batches):
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b in text_slices(batch.column("text"), INDEX_BYTES):
                trigram, doc = slice_trigrams(text_bytes(batch.column("text").slice(a, b - a)))
                first = np.flatnonzero(np.diff(trigram, prepend=-1))
                delta = np.diff(doc, prepend=0)
                delta[first] = doc[first]
                offsets = pa.py_buffer((4 * np.concatenate([first, [len(doc)]])).astype(np.int32).tobytes())
                m = len(first)
                blobs = pa.BinaryArray.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(delta.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, segment)), pa.array(trigram[first].astype(np.int32)), blobs, pa.nulls(m, pa.list_(pa.int64()))], schema=kinds)
                yield pa.RecordBatch.from_pydict({"segment": [segment], "trigram": [None], "postings": [None], "doc_ids": [doc_ids.slice(a, b - a).to_pylist()]}, schema=kinds)
                segment += 1

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), index, "segment long, trigram int, postings binary, doc_ids array<long>")
    return written(rows)


def rule_queries(rules) -> dict[int, Query]:
    """The trigram queries of the rules that have one, by their place in ``rules``: at most 63, as masks are longs."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules a scan")
    return {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)).op != "all"}


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, mask), out of a written index: for documents that satisfy the trigram query of some rule, the bits of these rules.

    Rules without a mandatory trigram are not in the mask; every text is a candidate of theirs.
    """
    queries = rule_queries(rules)
    wanted = sorted(set().union(*map(query_trigrams, queries.values()))) if queries else []
    lists = index.where(F.col("trigram").isin(wanted) | F.col("doc_ids").isNotNull())

    def search(batches):
        for table in sorted_runs(batches, ["segment"]):
            bounds = run_bounds(table, ["segment"])
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                postings, doc_ids = {}, []
                for row in table.slice(s, e - s).to_pylist():
                    if row["doc_ids"] is not None:
                        doc_ids = row["doc_ids"]
                    else:
                        postings[row["trigram"]] = np.cumsum(np.frombuffer(row["postings"], "<u4"), dtype=np.int64)
                mask = np.zeros(len(doc_ids), np.int64)
                for i, q in queries.items():
                    mask[evaluate(q, postings)] |= 1 << i
                hit = np.flatnonzero(mask)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([doc_ids[i] for i in hit.tolist()], pa.int64()), "mask": pa.array(mask[hit])})

    found = arrow_map(lists.repartition(partitions(index.sparkSession), "segment").sortWithinPartitions("segment"), search, "doc_id long, mask long")
    return found.groupBy("doc_id").agg(F.bit_or("mask").alias("mask"))


# Bytes of a hexadecimal run become 1: a text without a long run of them has no match of the hex rule.
_HEX_TABLE = bytes(49 if b in b"0123456789abcdef" else 48 for b in range(256))


def _found(raw: bytes | None, mask: int, rules) -> list[tuple[int, int, int]]:
    """(start, rule, end) of a text's secrets, for the rules in ``mask``."""
    out, text = [], None
    for i, rule in enumerate(rules):
        if raw and mask >> i & 1 and (rule.kind != "hex" or b"1" * 24 in raw.translate(_HEX_TABLE)):
            text = raw.decode() if text is None else text
            out += [(s, i, e) for s, e in rule.spans(text)]
    out.sort()
    return out


def scan(docs: DataFrame, rules=RULES, into: str = "secrets") -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with a column ``into``: array of (kind, start, end), by start, then as rules are listed.

    A worker indexes its texts slice by slice, answers the rules' trigram queries from the
    slice's postings and verifies the candidates at once, so no text moves. Positions are
    code points, ends exclusive. A null or empty text has none; rows of equal doc_id are
    scanned each; an empty table gives none. An input column named as ``into`` is replaced.
    """
    names = [c for c in docs.columns if c != into]
    plain, text = _plain(docs.select(*[c for c, n in zip(own_columns(docs), docs.columns) if n != into]))
    return _scan(plain, text, rules).toDF(*names, into)


def _plain(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with columns c0, c1 and so on, since workers are given columns by bare names, and the name of the text."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def _scan(docs: DataFrame, text: str, rules) -> DataFrame:
    """``docs`` with the secrets of column ``text`` as a last column, found."""
    queries = rule_queries(rules)
    always = sum(1 << i for i in range(len(rules)) if i not in queries)
    wanted = np.array(sorted(set().union(*map(query_trigrams, queries.values()))) if queries else [], np.int64)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def verify(batches):
        for batch in batches:
            found = []
            for a, b in text_slices(batch.column(text), SLICE_BYTES):
                texts = text_bytes(batch.column(text).slice(a, b - a))
                trigram, doc = slice_trigrams(texts)
                low, high = np.searchsorted(trigram, wanted), np.searchsorted(trigram, wanted, side="right")
                postings = {t: doc[i:j] for t, i, j in zip(wanted.tolist(), low.tolist(), high.tolist()) if j > i}
                mask = np.full(b - a, always, np.int64)
                for i, q in queries.items():
                    mask[evaluate(q, postings)] |= 1 << i
                found += [[{"kind": rules[i].kind, "start": s, "end": e} for s, i, e in _found(t, m, rules)] for t, m in zip(texts, mask.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "found"])

    return arrow_map(docs, verify, docs.select("*", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("found")).schema)


def span_text(spans: Column, kinds=None) -> Column:
    """Spans as kind:start:end, comma-joined; with ``kinds`` only those."""
    if kinds:
        spans = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; overlapping spans are replaced together, under the first one's kind.

    n_chars, where there is such a column, is counted again; all other columns, whatever their
    names, are returned as they are. Null texts stay null; an empty table gives none.
    """
    plain, text = _plain(docs.select(*own_columns(docs)))
    count = f"c{docs.columns.index('n_chars')}" if "n_chars" in docs.columns else ""
    schema = plain.schema

    def hide(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for i, spans in enumerate(batch.column("found").to_pylist()):
                if not spans:
                    continue
                out, at, whole = [], 0, texts[i]
                for x in spans:
                    if x["start"] >= at:
                        out += [whole[at : x["start"]], f"[{x['kind']}]"]
                    at = max(at, x["end"])
                texts[i] = "".join([*out, whole[at:]])
            columns = {n: batch.column(n) for n in schema.names}
            columns[text] = pa.array(texts, batch.column(text).type)
            if count:
                columns[count] = pa.array([None if t is None else len(t) for t in texts], columns[count].type)
            yield pa.RecordBatch.from_pydict(columns)

    return arrow_map(_scan(plain, text, rules), hide, schema).toDF(*docs.columns)
