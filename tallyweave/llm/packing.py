"""Harmonic packing of documents into sequences (operator 8).

Lengths in (C/(k+1), C/k] form class k of capacity C, and a bin of class k takes exactly k
pieces. A document is first cut to fit its class closely: full sequences, then pieces of the
slot sizes C/k until what is left wastes at most 1/64 of a slot. Every worker fills the bins
of its own documents; nothing is shuffled. The bins that are still open at a worker's end
are emptied into one stream that is cut at the capacity, and its tail into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map
from .tokens import token_slices

SMALL = 16  # shorter pieces share the last class, filled as far as they go
TIGHT = 6  # a piece may waste a slot's size >> TIGHT


def harmonic_cuts(n: int, capacity: int = 2048) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens, in order; class 0 is the last class."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        if rest <= SMALL:
            out.append((rest, 0))
            break
        k = capacity // rest
        slot = capacity // k
        if slot - rest <= slot >> TIGHT:
            out.append((rest, k))
            break
        size = capacity // (k + 1)
        out.append((size, k + 1))
        rest -= size
    return out


def tail_sizes(n: int) -> list[int]:
    """Powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Bins of one worker. ``add`` and ``finish`` yield full bins: lists of (doc_id, start, ids, ids of the document).

    What waits in an open bin is a copy of its own, so that nothing but the pieces is kept.
    """

    def __init__(self, capacity: int = 2048):
        self.capacity, self.open, self.small, self.filled = capacity, {}, [], 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list[tuple]]:
        at = 0
        for size, k in harmonic_cuts(len(ids), self.capacity):
            piece = ids[at : at + size]
            if k == 1:
                yield [(doc_id, at, piece, len(ids))]
            elif k == 0:
                if self.filled + size > self.capacity:
                    yield self.small
                    self.small, self.filled = [], 0
                self.small.append((doc_id, at, piece.copy(), len(ids)))
                self.filled += size
            else:
                bin_ = self.open.setdefault(k, [])
                bin_.append((doc_id, at, piece.copy(), len(ids)))
                if len(bin_) == k:
                    yield self.open.pop(k)
            at += size

    def finish(self) -> Iterator[list[tuple]]:
        rest = [p for k in sorted(self.open) for p in self.open[k]] + self.small
        total = sum(len(p[2]) for p in rest)
        sizes = [self.capacity] * (total // self.capacity) + tail_sizes(total % self.capacity)
        i = used = 0
        for size in sizes:
            bin_, room = [], size
            while room:
                doc_id, start, ids, n = rest[i]
                take = min(room, len(ids) - used)
                bin_.append((doc_id, start + used, ids[used : used + take], n))
                room, used = room - take, used + take
                if used == len(ids):
                    i, used = i + 1, 0
            yield bin_
        self.open, self.small, self.filled = {}, [], 0


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text; other columns are ignored) in sequences of ``capacity``.

    One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    if asked for, ids. A null or empty text is its end id alone. Sequence ids are unique over
    workers, not dense. Equal rows are packed apart. Memory: a slice of texts, and copies of
    the pieces in open bins, at most one bin of ``capacity`` ids for each of about a hundred and twenty classes.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        packer, sequence = Packer(capacity), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def place(bin_):
            nonlocal sequence
            offset = 0
            for doc_id, start, piece, total in bin_:
                rows.append((doc_id, start, len(piece), zlib.crc32(piece), total, sequence, offset, *([piece.tolist()] * with_ids)))
                offset += len(piece)
            sequence += 1

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return batch

        for doc_ids, lens, ids in token_slices(batches, vocabulary, end_id):
            ids, at = ids.astype("<u4"), 0
            for doc_id, n in zip(doc_ids, lens.tolist()):
                for bin_ in packer.add(doc_id, ids[at : at + n]):
                    place(bin_)
                at += n
            if rows:
                yield out()
        for bin_ in packer.finish():
            place(bin_)
        if rows:
            yield out()

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return arrow_map(docs.select("doc_id", "text"), run, kinds)
