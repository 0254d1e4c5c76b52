"""Tokenising with a public vocabulary, and token-id files in Simple-8b coding (operator 4).

Ids are packed into 64-bit words: four selector bits say how many ids of how many bits the
other sixty hold. Ids of sixty bits or more are escaped: a word with the escape selector is
followed by the raw id. A segment of the file is cut into blocks of ``BLOCK`` ids with the
offset of each block's first word, so blocks decode independently and all together as
vectors.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, text_slices, written

# Ids per word and bits per id of each selector; ESCAPE is the selector of a raw word.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15

BLOCK = 128
MAGIC = 0x38535754  # "TWS8"
VERSION = 1
SLICE_BYTES = 2 << 20
LEARN_WORDS = 512


class _Words(dict):
    """Numbers for chunks of text, given on first sight."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf"[{_LETTERS}]+")
_RUNS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS} \t\n\r\x0b\x0c\x85\xa0]+")


def chunks_of(text: str) -> list[str]:
    """A text in chunks that the vocabulary encodes apart.

    Its pre-tokeniser separates letters from other characters, but for an apostrophe with the
    letters after it; special tokens mix both. Texts of Latin-1 characters without either are
    cut there, in lower case as the vocabulary's own; all others at blanks and line feeds.
    """
    if "'" not in text and "<|" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            return _RUNS.findall(text.lower())
    return text.replace("\n", " ").split(" ")


class CachedEncoder:
    """Encodes whole texts with the ``tokenizers`` library; equal chunks between blanks are encoded once.

    The vocabulary in use drops white space and never merges over the bounds of
    ``chunks_of``, so a text's ids are its chunks' ids in order. At most ``max_words`` chunks are remembered; chunks of over
    ``long`` characters count for many.
    """

    def __init__(self, path: str, end_id: int = 1, max_words: int = 500_000, long: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.max_words, self.long = Tokenizer.from_file(path), end_id, max_words, long
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.words, self.weight = _Words(), 0
        self.flat = np.array([self.end_id], np.uint32)
        self.starts, self.lens = np.array([0, 0], np.int64), np.array([1, 0], np.int64)
        self.words["\n"], self.words[""] = 0, 1  # the end of a document, and nothing

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by ``end_id``, and how many belong to each text."""
        if self.weight > self.max_words:
            self._reset()
        index, firsts, parts, n = self.words, [], [], 0
        for text in texts:
            words = chunks_of(text)
            words.append("\n")
            firsts.append(n)
            n += len(words)
            parts.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self._learn()
        which = np.concatenate(parts)
        lens = self.lens[which]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[which] - (ends - lens), lens) + np.arange(ends[-1])
        return self.flat[at], np.add.reduceat(lens, firsts)

    def _learn(self) -> None:
        fresh = self.words.fresh
        if not fresh:
            return
        self.weight += sum(1 + len(w) // self.long for w in fresh)
        lens, ids = np.zeros(len(fresh), np.int64), []
        plain = [i for i, w in enumerate(fresh) if _WORD.fullmatch(w)]
        other = [i for i, w in enumerate(fresh) if not _WORD.fullmatch(w)]
        # Words of letters alone go in lines: each ends with the one token that is marked as a word's end.
        for a in range(0, len(plain), LEARN_WORDS):
            got = np.array(self.tokenizer.encode(" ".join([fresh[i] for i in plain[a : a + LEARN_WORDS]]), add_special_tokens=False).ids, np.uint32)
            lens[plain[a : a + LEARN_WORDS]] = np.diff(np.flatnonzero(self.ends_word[got]), prepend=-1)
            ids.append(got)
        for a in range(0, len(other), LEARN_WORDS):
            for i, e in zip(other[a : a + LEARN_WORDS], self.tokenizer.encode_batch([fresh[i] for i in other[a : a + LEARN_WORDS]], add_special_tokens=False)):
                lens[i] = len(e.ids)
                ids.append(np.array(e.ids, np.uint32))
        order = np.array(plain + other)
        starts = np.zeros(len(fresh), np.int64)
        starts[order] = len(self.flat) + np.cumsum(lens[order]) - lens[order]
        self.starts, self.lens = np.concatenate([self.starts, starts]), np.concatenate([self.lens, lens])
        self.flat = np.concatenate([self.flat, *ids])
        fresh.clear()


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, end_id: int) -> CachedEncoder:
    """One encoder for all tasks of a worker."""
    return CachedEncoder(path, end_id)


def _bit_width(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned value, at least 1."""
    if len(values) and values.max() < 1 << 53:
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.uint8)
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.maximum(np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low), 1).astype(np.uint8)


def simple8b_encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word and the end) of unsigned 64-bit values."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    rows, wide = -(-n // block), block + COUNTS[0]
    grid = np.zeros((rows, wide), np.uint64)
    whole = n // block
    grid[:whole, :block] = values[: whole * block].reshape(whole, block)
    grid[whole:, : n - whole * block] = values[whole * block :]
    width = np.zeros((rows, wide), np.uint8)
    width[:, :block] = _bit_width(grid[:, :block].ravel()).reshape(rows, block)
    # top[k][:, i]: the widest of k values from i on; how many selectors fit there picks the densest.
    top, fits = {1: width}, np.zeros((rows, block), np.uint8)
    for k, bits in zip(COUNTS[::-1], BITS[::-1]):
        if k not in top:
            a = max(j for j in top if j < k)
            b = min((j for j in top if j >= k - a), default=a)
            b = b if a + b == k else a  # overlapping windows cover k as well
            shift = k - b
            t = width.copy()
            t[:, : wide - shift] = np.maximum(top[a][:, : wide - shift], top[b][:, shift:])
            top[k] = t
        fits += top[k][:, :block] <= bits
    counts = np.array((0, *COUNTS[::-1]), np.int64)
    left = np.full(rows, block, np.int64)
    left[-1] = n - (rows - 1) * block
    at, alive, taken = np.zeros(rows, np.int64), np.arange(rows), []
    while len(alive):
        here = at[alive]
        fit = fits[alive, here]
        taken.append((alive, here, fit))
        at[alive] += np.maximum(counts[fit], 1)
        alive = alive[at[alive] < left[alive]]
    row = np.concatenate([r for r, _, _ in taken])
    col = np.concatenate([c for _, c, _ in taken])
    fit = np.concatenate([f for _, _, f in taken])
    order = np.argsort(row * wide + col, kind="stable")
    row, col, fit = row[order], col[order], fit[order]
    size = 1 + (fit == 0)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    flat = grid.ravel()
    for s, (k, bits) in enumerate(zip(COUNTS, BITS)):
        mine = np.flatnonzero(fit == len(COUNTS) - s)
        if len(mine):
            start, word = row[mine] * wide + col[mine], np.full(len(mine), s << 60, np.uint64)
            for j in range(k):
                word |= flat[start + j] << np.uint64(j * bits)
            words[place[mine]] = word
    mine = np.flatnonzero(fit == 0)
    words[place[mine]] = np.uint64(ESCAPE << 60)
    words[place[mine] + 1] = flat[row[mine] * wide + col[mine]]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=rows))]).astype(np.uint32)
    return words, offsets


def simple8b_decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The values back; the blocks' last words may hold padding, which their counts cut off."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # A raw word may look like any selector. Words before the first escape are certain, so escapes are found in order.
    skip = -1
    for i in np.flatnonzero(selector == ESCAPE).tolist():
        if i > skip:
            raw[i + 1], skip = True, i + 1
    selector[raw] = len(COUNTS)
    counts = np.array((*COUNTS, 1, 0), np.int64)[selector]
    block_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    ends = np.cumsum(counts)
    base = np.concatenate([[0], ends])[offsets[:-1].astype(np.int64)]
    start = ends - counts - base[block_of]
    out = np.zeros((len(offsets) - 1, block + COUNTS[0]), np.uint64)
    flat, wide = out.ravel(), block + COUNTS[0]
    for s, (k, bits) in enumerate(zip(COUNTS, BITS)):
        mine = np.flatnonzero((selector == s) & ~raw)
        if len(mine):
            to, word, mask = block_of[mine] * wide + start[mine], words[mine], np.uint64((1 << bits) - 1)
            for j in range(k):
                flat[to + j] = (word >> np.uint64(j * bits)) & mask
    mine = np.flatnonzero(raw)
    flat[block_of[mine] * wide + start[mine]] = words[mine]
    return out[:, :block].ravel()[:n]


def pack_segment(doc_ids: list[int | None], lens: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment of a token file: header, document table, block offsets, words, checksum."""
    words, offsets = simple8b_encode(ids.astype(np.uint64))
    head = np.array([MAGIC, VERSION, len(doc_ids), len(offsets) - 1, len(words), len(ids)], "<u8")
    body = b"".join(
        (
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            lens.astype("<u8").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
        )
    )
    return head.tobytes() + body + zlib.crc32(body).to_bytes(4, "little")


def unpack_segment(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids). Raises ValueError for a damaged segment."""
    if len(blob) < 52:
        raise ValueError("token segment: too short")
    magic, version, docs, blocks, n_words, n = np.frombuffer(blob, "<u8", 6).tolist()
    if magic != MAGIC or version != VERSION:
        raise ValueError("token segment: not this format")
    sizes = (docs, 8 * docs, 8 * docs, 4 * (blocks + 1), 8 * n_words)
    if len(blob) != 48 + sum(sizes) + 4 or zlib.crc32(blob[48:-4]) != int.from_bytes(blob[-4:], "little"):
        raise ValueError("token segment: length or checksum is wrong")
    at, parts = 48, []
    for size, kind in zip(sizes, ("u1", "<i8", "<u8", "<u4", "<u8")):
        parts.append(np.frombuffer(blob[at : at + size], kind))
        at += size
    there, doc_ids, lens, offsets, words = parts
    return [d if t else None for d, t in zip(doc_ids.tolist(), there.tolist())], lens.astype(np.int64), simple8b_decode(words, offsets, n)


def token_slices(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, ids per document, ids) for slices of a partition's documents; a null text is empty."""
    encoder = worker_encoder(path, end_id)
    for batch in batches:
        doc_ids, texts = batch.column("doc_id"), batch.column("text")
        for a, b in text_slices(texts, SLICE_BYTES):
            ids, lens = encoder.encode([t or "" for t in texts.slice(a, b - a).to_pylist()])
            yield doc_ids.slice(a, b - a).to_pylist(), lens, ids


def write_token_table(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order.

    The token files are a Parquet table in the shared folder: each row is one
    self-describing segment (``pack_segment``), since Spark has no writer of bare binary
    files. Columns: part and seq order the segments, start_in_part counts the ids before a
    segment in its part, n_docs, n_ids, segment. Null doc_ids come first; rows of equal
    doc_id are ordered by a hash of their text, equal rows in any order. An empty table gives none.
    """
    tie = F.xxhash64("text")

    def encode(batches):
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        for doc_ids, lens, ids in token_slices(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "start_in_part": [start], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "segment": [pack_segment(doc_ids, lens, ids)]},
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start_in_part", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("segment", pa.binary())]),
            )
            seq, start = seq + 1, start + len(ids)

    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", tie).sortWithinPartitions("doc_id", tie)
    return written(arrow_map(ranged, encode, "part int, seq int, start_in_part long, n_docs int, n_ids long, segment binary"))


def part_bases(table: DataFrame) -> DataFrame:
    """(part, base): ids in all earlier parts. One row a shuffle partition, so its size is bounded by their number."""
    sums = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, total = [], 0
    for part, n in sums:
        bases.append((part, total))
        total += n
    return table.sparkSession.createDataFrame(bases, "part int, base long")


def read_token_table(table: DataFrame, with_ids: bool = True) -> DataFrame:
    """One row a document of a token table: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""

    def decode(batches):
        for batch in batches:
            for part, start, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "start_in_part", "segment"))):
                doc_ids, lens, ids = unpack_segment(blob)
                ids = ids.astype("<u4")
                ends = np.cumsum(lens)
                out = {
                    "part": pa.array([part] * len(doc_ids), pa.int32()),
                    "doc_id": pa.array(doc_ids, pa.int64()),
                    "start_in_part": pa.array(start + ends - lens),
                    "n_tokens": pa.array(lens),
                    "ids_crc32": pa.array([zlib.crc32(ids[e - k : e]) for k, e in zip(lens.tolist(), ends.tolist())], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = arrow_map(table.select("part", "start_in_part", "segment"), decode, schema)
    rows = rows.join(F.broadcast(part_bases(table)), "part")
    return rows.select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
