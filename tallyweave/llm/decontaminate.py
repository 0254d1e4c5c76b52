"""Benchmark decontamination through a distributed positional inverted index (operator 5).

The index is split by documents, as search clusters split theirs: a segment holds a slice of
the training documents and, per term, the ascending positions of its tokens in the slice.
Building it moves nothing between workers. A search reads the posting lists of the test
terms only, and each segment intersects them by itself: every phrase starts from the rarest
of its terms, whose postings become candidate alignments; the other terms' lists, adjusted
by their offsets, are intersected one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, ROW, arrow_map, partitions, run_bounds, sorted_runs, text_bytes, text_slices, with_row, written
from .words import WORD_TABLE, grouped_words, span_bytes, word_spans

WINDOW = 10
REACH = 30  # words within which all words of a window are near each other
SLICE_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20  # of test items' text that are searched together
CHUNK_WINDOWS = 20_000
BROADCAST_TERMS = 1_000_000


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return text.translate(WORD_TABLE).split() if text else []


def _deltas(positions: np.ndarray, starts: np.ndarray) -> np.ndarray:
    d = np.diff(positions, prepend=0)
    d[starts] = positions[starts]
    return d.astype("<u4")


class PositionalIndex:
    """The written index. postings: (segment, term, n, positions); segments: (segment, doc_ids, bases, counts), arrays by ordinal.

    positions is a binary column of ascending token positions, differences in 32 bits,
    counted over the segment with one empty position after each document, so that no phrase
    runs from one document into the next. documents are the segments' arrays as rows:
    (segment, ordinal, doc_id, base, n_words).
    """

    def __init__(self, table: DataFrame):
        self.postings = table.where("term is not null").select("segment", "term", "n", "positions")
        self.segments = table.where("doc_ids is not null").select("segment", "doc_ids", "bases", "counts")
        self.documents = self.segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "bases", "counts"))).select("segment", F.col("pos").alias("ordinal"), F.col("col.doc_ids").alias("doc_id"), F.col("col.bases").alias("base"), F.col("col.counts").alias("n_words"))


def build_index(docs: DataFrame) -> PositionalIndex:
    """Index every token of ``docs`` (doc_id, text; other columns are ignored).

    A null or empty text has no words and no postings but is among the documents; equal
    rows are documents of their own.
    """
    kinds = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("positions", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("bases", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def index(batches):
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            doc_ids = batch.column("doc_id")
            for a, b in text_slices(batch.column("text"), SLICE_BYTES):
                folded, first, last, bounds = word_spans(batch.column("text").slice(a, b - a))
                counts = np.diff(bounds)
                bases = np.cumsum(counts + 1) - counts - 1
                order, groups = grouped_words(folded, first, last)
                positions = (np.arange(len(first)) + np.repeat(np.arange(b - a), counts))[order]
                ends = np.append(groups, len(first))
                blob = pa.py_buffer(_deltas(positions, groups).tobytes())
                offsets = pa.py_buffer((4 * ends).astype(np.int32).tobytes())
                word = order[groups]
                n = len(word)
                names = pa.py_buffer(np.concatenate([[0], np.cumsum(last[word] - first[word])]).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, segment)),
                        pa.StringArray.from_buffers(n, names, pa.py_buffer(span_bytes(folded, first[word], last[word]))),
                        pa.array(np.diff(ends).astype(np.int32)),
                        pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, blob]),
                        *[pa.nulls(n, pa.list_(pa.int64()))] * 3,
                    ],
                    schema=kinds,
                )
                yield pa.RecordBatch.from_pydict({"segment": [segment], "term": [None], "n": [None], "positions": [None], "doc_ids": [doc_ids.slice(a, b - a).to_pylist()], "bases": [bases.tolist()], "counts": [counts.tolist()]}, schema=kinds)
                segment += 1

    rows = arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), index, "segment long, term string, n int, positions binary, doc_ids array<long>, bases array<long>, counts array<long>")
    return PositionalIndex(written(rows))


class Phrases:
    """Test items as windows of term numbers: what a segment needs to search."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        self.terms: dict[bytes, int] = {}
        tokens, first, item, length = [], [], [], []
        for k, (_, words) in enumerate(items):
            base = len(tokens)
            tokens += [self.terms.setdefault(w, len(self.terms)) for w in words]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                first.append(base + i)
                item.append(k)
                length.append(min(window, len(words)))
        self.tokens = np.array(tokens, np.int64)
        self.first, self.item, self.length = (np.array(x, np.int64) for x in (first, item, length))


class _Segment:
    """The posting lists of a segment: per term, and all as one sorted array of (term, position) that answers membership for all terms at once."""

    def __init__(self, lists: dict[int, np.ndarray], n_terms: int):
        self.lists = lists
        self.df = np.zeros(n_terms + 1, np.int64)
        for t, p in lists.items():
            self.df[t] = len(p)
        self.keys = np.concatenate([np.zeros(0, np.int64), *((np.int64(t) << 40) + lists[t] for t in sorted(lists))])

    def has(self, term, positions: np.ndarray) -> np.ndarray:
        key = (np.asarray(term, np.int64) << 40) + positions
        i = np.searchsorted(self.keys, key)
        return (self.keys[np.minimum(i, len(self.keys) - 1)] == key) & (positions >= 0)

    def within(self, term: np.ndarray, positions: np.ndarray, reach: int) -> np.ndarray:
        """Whether the term stands fewer than ``reach`` words from the position, on either side."""
        key = (term << 40) + positions
        i = np.searchsorted(self.keys, key)
        after = self.keys[np.minimum(i, len(self.keys) - 1)] - key
        before = key - self.keys[np.maximum(i - 1, 0)]
        return ((after >= 0) & (after < reach)) | ((before >= 0) & (before < reach))


def _windows(phrases: Phrases, segment: _Segment):
    """(windows whose terms all stand in the segment, their terms, the terms' counts), a chunk of windows at a time."""
    offs = np.arange(phrases.length.max() if len(phrases.length) else 0)
    for a in range(0, len(phrases.first), CHUNK_WINDOWS):
        own = np.arange(a, min(a + CHUNK_WINDOWS, len(phrases.first)))
        inside = offs < phrases.length[own, None]
        term = np.where(inside, phrases.tokens[np.minimum(phrases.first[own, None] + offs, len(phrases.tokens) - 1)], len(phrases.terms))
        count = np.where(inside, segment.df[term], np.iinfo(np.int64).max)
        alive = (count > 0).all(axis=1)
        if alive.any():
            yield own[alive], term[alive], count[alive]


def _intersect(phrases: Phrases, segment: _Segment, alive: np.ndarray, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every occurrence of the windows: from the rarest term's postings, the others' are intersected one after the other."""
    rarest = count.argmin(axis=1)
    # Windows of an item that share their rarest token share its alignments: test each once, with its neighbours in the item.
    anchor, member = np.unique(phrases.first[alive] + rarest, return_inverse=True)
    by_anchor = np.argsort(member, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(member, minlength=len(anchor)))])
    found_w, found_s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k, a in enumerate(anchor.tolist()):
        rows = by_anchor[bounds[k] : bounds[k + 1]]
        windows = alive[rows]
        places = segment.lists[int(phrases.tokens[a])]
        if len(windows) > 1:
            # a window of two or more tokens holds a neighbour of its anchor
            near = np.zeros(len(places), bool)
            for step in (-1, 1):
                if ((phrases.first[windows] <= a + step) & (a + step < phrases.first[windows] + phrases.length[windows])).any():
                    near |= segment.has(int(phrases.tokens[a + step]), places + step)
            places = places[near]
        for r, w in zip(rows.tolist(), windows.tolist()):
            starts = places - (a - phrases.first[w])
            for j in np.argsort(count[r], kind="stable")[1 : phrases.length[w]].tolist():
                if not len(starts):
                    break
                starts = starts[segment.has(int(term[r, j]), starts + j)]
            if len(starts):
                found_w.append(np.full(len(starts), w))
                found_s.append(starts)
    return np.concatenate(found_w), np.concatenate(found_s)


def _near(phrases: Phrases, segment: _Segment, alive: np.ndarray, term: np.ndarray, count: np.ndarray, reach: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, length) of the stretches of at most ``reach`` words that hold all words of a window, in any order.

    Each starts at an occurrence of one of the words and is the shortest from there. A
    stretch holds the rarest word, so its postings give the places to look at; those where
    some other word isn't in reach are left after one lookup for all of them. The places of
    ``known`` phrase matches (window, start) are passed over.
    """
    rarest = count.argmin(axis=1)
    word = term[np.arange(len(alive)), rarest]
    n = segment.df[word]
    row = np.repeat(np.arange(len(alive)), n)
    place = np.concatenate([np.zeros(0, np.int64), *(segment.lists[t] for t in word.tolist())])
    if known is not None:
        seen = (known[0] << 40) + known[1] + rarest[np.searchsorted(alive, known[0])]
        new = np.isin((alive[row] << 40) + place, seen, invert=True)
        row, place = row[new], place[new]
    for j in range(term.shape[1]):
        t = term[row, j]
        ok = (t == len(phrases.terms)) | segment.within(t, place, reach)
        row, place = row[ok], place[ok]
    out_w, out_s, out_n = [], [], []
    for r, p in zip(row.tolist(), place.tolist()):
        terms = {t for t in term[r].tolist() if t != len(phrases.terms)}
        lists = []
        for t in terms:
            x = segment.lists[t]
            lists.append(x[np.searchsorted(x, p - reach, side="right") : np.searchsorted(x, p + reach)])
        starts = np.unique(np.concatenate(lists))
        starts = starts[starts <= p]
        ends = starts
        for x in lists:
            i = np.searchsorted(x, starts)
            ends = np.maximum(ends, np.where(i < len(x), x[np.minimum(i, len(x) - 1)], np.iinfo(np.int64).max - 1))
        ok = (ends - starts < reach) & (ends >= p)
        out_w += [int(alive[r])] * int(ok.sum())
        out_s.append(starts[ok])
        out_n.append(ends[ok] + 1 - starts[ok])
    none = [np.zeros(0, np.int64)]
    found = np.unique(np.stack([np.array(out_w, np.int64), np.concatenate(none + out_s), np.concatenate(none + out_n)]), axis=1)
    return found[0], found[1], found[2]


MATCH = "segment long, ordinal int, doc_id long, item string, start long, length int, exact boolean"


def _with_texts(items: DataFrame) -> DataFrame:
    return items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")


def item_terms(items: DataFrame) -> DataFrame:
    """(term): the distinct words of the test items."""

    def split(batches):
        for batch in batches:
            words = set().union(*map(words_of, text_bytes(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.binary()).cast(pa.string())], ["term"])

    return written(arrow_map(_with_texts(items).select("text"), split, "term string").distinct())


def _wanted_lists(index: PositionalIndex, items: DataFrame) -> DataFrame:
    """Out of one pass over the index: the posting lists of the items' terms, and the tables of documents (term is null) of all segments."""
    terms = item_terms(items)
    # at most BROADCAST_TERMS words, a few tens of megabytes; more are joined by a shuffle
    few = terms.count() <= BROADCAST_TERMS
    none = [F.lit(None).cast("array<long>").alias(c) for c in ("doc_ids", "bases", "counts")]
    lists = index.postings.join(F.broadcast(terms) if few else terms, "term").select("segment", "term", "positions", *none)
    return lists.union(index.segments.select("segment", F.lit(None).cast("string").alias("term"), F.lit(None).cast("binary").alias("positions"), "doc_ids", "bases", "counts"))


def _segments(batches: Iterator[pa.RecordBatch], terms: dict[bytes, int]) -> Iterator[tuple[int, dict[int, np.ndarray], list[pa.Array]]]:
    """(segment, positions by term number, [doc_ids, bases, counts]) of the dealt segments; lists of other terms are left."""
    for table in sorted_runs(batches, ["segment"]):
        bounds = run_bounds(table, ["segment"])
        segment, names, blobs = table.column("segment").to_numpy(), [None if w is None else w.encode() for w in table.column("term").to_pylist()], table.column("positions")
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            lists = {terms[names[i]]: np.cumsum(np.frombuffer(blobs[i].as_buffer(), "<u4"), dtype=np.int64) for i in range(s, e) if names[i] in terms}
            own = next(i for i in range(s, e) if names[i] is None)
            yield int(segment[s]), lists, [table.column(c)[own].values for c in ("doc_ids", "bases", "counts")]


def _located(segment: int, documents: list[pa.Array], items: list[str], starts: np.ndarray, lengths: np.ndarray, exact: bool) -> pa.RecordBatch:
    """Matches in words of their documents: the last one that starts before a match holds it, unless the match runs over its end."""
    doc_ids, bases, counts = documents
    base = bases.to_numpy()
    i = np.searchsorted(base, starts, side="right") - 1
    inside = starts - base[i] + lengths <= counts.to_numpy()[i]
    columns = [pa.array(np.full(len(i), segment)), pa.array(i.astype(np.int32)), doc_ids.take(pa.array(i)), pa.array(items, pa.string()), pa.array(starts - base[i]), pa.array(lengths.astype(np.int32)), pa.array(np.full(len(i), exact))]
    return pa.RecordBatch.from_arrays(columns, ["segment", "ordinal", "doc_id", "item", "start", "length", "exact"]).filter(pa.array(inside))


def matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW, reach: int = 0, exact: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Matches of the items' windows, one row an occurrence: segment, ordinal, doc_id, item, start, length in words of the document, exact.

    A window is ``window`` consecutive words of an item; an item of fewer words is one
    window. With ``exact`` its phrase matches are found, with ``reach`` also the stretches of
    at most so many words that hold its words in any order, but for those around phrase matches that are found already. A null text or one without
    words has none. Repeated items match alike. The items are the stated query set: the
    driver holds a block of about ``block_bytes`` of them, dealt by a hash, at a time. The
    index is read once; where there are several blocks, they share a table of its lists.
    """
    spark = index.postings.sparkSession
    texts = _with_texts(items)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    lists = _wanted_lists(index, items)
    if blocks > 1:
        lists = written(lists)
        texts = written(texts.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))
    found = []
    for b in range(blocks):
        own = texts if blocks == 1 else texts.where(F.col("block") == b)
        rows = own.select("item", "text").orderBy("item", "text").collect()  # a block
        phrases = Phrases([(r.item, w) for r in rows if (w := words_of(r.text.encode()))], window)
        if not len(phrases.first):
            continue

        def search(batches, phrases=phrases):
            for number, postings, documents in _segments(batches, phrases.terms):
                if not postings:
                    continue
                segment = _Segment(postings, len(phrases.terms))
                for alive, term, count in _windows(phrases, segment):
                    if exact:
                        w, start = _intersect(phrases, segment, alive, term, count)
                        if len(w):
                            yield _located(number, documents, [phrases.names[k] for k in phrases.item[w].tolist()], start, phrases.length[w], True)
                    if reach:
                        w, start, length = _near(phrases, segment, alive, term, count, reach, (w, start) if exact and reach >= window else None)
                        if len(w):
                            yield _located(number, documents, [phrases.names[k] for k in phrases.item[w].tolist()], start, length, False)

        part = arrow_map(lists.repartition(partitions(spark), "segment").sortWithinPartitions("segment"), search, MATCH)
        found.append(part if blocks == 1 else written(part))  # written: the block can go
    if not found:
        return spark.createDataFrame([], MATCH)
    return reduce(DataFrame.union, found)


def phrase_matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact phrase matches alone: see ``matches``."""
    return matches(index, items, window).drop("exact")


def proximity_matches(index: PositionalIndex, items: DataFrame, reach: int = REACH, window: int = WINDOW) -> DataFrame:
    """Stretches of at most ``reach`` words that hold all words of a window of an item, in any order: see ``matches``.

    Each stretch starts at an occurrence of one of the words and is the shortest from there.
    Of a word that a window repeats one occurrence is enough.
    """
    return matches(index, items, window, reach, exact=False).drop("exact")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, reach: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window), items (sorted item ids); with ``reach`` also near (sorted ids of items with a window whose words stand together in so many words).

    A null text has no words. Rows of equal doc_id are judged apart.
    """
    index = build_index(docs)
    hits = matches(index, items, window, reach, block_bytes=block_bytes)
    keys = ["segment", "ordinal"]
    # Occurrences of a window of one document as intervals; neighbours are merged by a running maximum of their ends.
    # Both sets are bounded by one document's words and the items that it holds.
    span = F.struct("start", (F.col("start") + F.col("length")).alias("end"))
    is_exact = lambda c: F.when(F.col("exact"), c)
    sets = hits.groupBy(*keys).agg(F.sort_array(F.collect_set(is_exact(span))).alias("s"), F.sort_array(F.collect_set(is_exact(F.col("item")))).alias("items"), F.sort_array(F.collect_set(F.when(~F.col("exact") | (F.col("length") <= reach), F.col("item")))).alias("near"))
    covered = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")))
    found = sets.select(*keys, covered["n"].alias("n_hit"), "items", "near")
    out = index.documents.join(found, keys, "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), *[F.coalesce("near", none).alias("near")] * bool(reach))


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose own text holds a benchmark window; all columns, whatever their names, as they are."""
    rows = with_row(docs)
    bad = contamination(rows.select(F.col(ROW).alias("doc_id"), F.col(OWN)["text"].alias("text")), items, window).where("n_hit > 0").select(F.col("doc_id").alias(ROW))
    return rows.join(bad, ROW, "left_anti").select(f"{OWN}.*")
