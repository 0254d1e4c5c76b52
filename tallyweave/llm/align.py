"""Alignment of the tokens that two tokenizers cut one text into (operator 11).

Both token sequences are known by the byte offsets where tokens end. While the ends agree at
the present shift of indices, runs of one-to-one tokens are jumped over: slices of both end
arrays are compared whole, twice as long each time, and halved again to find where the run
stops. The irregular group there is walked through token by token until both sides end
together, which gives the next shift.
"""

from __future__ import annotations

import functools
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices, written

SLICE_BYTES = 1 << 20
MOST_CHUNKS = 1_000_000  # remembered by a worker; those of over LONG characters count for many
LONG = 64
ROW_BITS = 33  # of a row's number within its partition
ID_BITS = 32  # of the second id in a pair's code
PAIRS_AT_ONCE = 1_000_000  # pair counts that go to all executors at a time


def diagonal_runs(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Stretches (i, i2, j, j2) of two rising lists of ends that close at one offset.

    A stretch of ``i2 - i == j2 - j`` tokens whose ends all agree is a run of one-to-one
    groups; any other is one irregular group.
    """
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        start, step = i, 1
        while i + step <= n and j + step <= m and a[i : i + step] == b[j : j + step]:
            i, j, step = i + step, j + step, step * 2
        while step > 1:
            step //= 2
            if i + step <= n and j + step <= m and a[i : i + step] == b[j : j + step]:
                i, j = i + step, j + step
        if i > start:
            yield start, i, j - (i - start), j
        if i == n or j == m:
            break
        x, y = i, j
        while a[x] != b[y]:
            if a[x] < b[y]:
                x += 1
            else:
                y += 1
        yield i, x + 1, j, y + 1
        i, j = x + 1, y + 1


def overlaps(a: list[int], b: list[int], i: int, i2: int, j: int, j2: int) -> Iterator[tuple[int, int]]:
    """Index pairs of the tokens of one irregular group whose byte ranges overlap."""
    while i < i2 and j < j2:
        yield i, j
        if a[i] < b[j]:
            i += 1
        elif b[j] < a[i]:
            j += 1
        else:
            i, j = i + 1, j + 1


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}


class ByteLevel:
    """A byte-level ``.json`` vocabulary of the ``tokenizers`` library; special strings in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, table = Tokenizer.from_file(path), byte_table()
        self.tokenizer.encode_special_tokens = True
        self.bytes_of = {i: bytes(table[c] for c in t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.size = {i: len(v) for i, v in self.bytes_of.items()}

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. Words that begin with a blank go in one line, which the pattern cuts before each, and come apart by their bytes."""
        out = [[]] * len(chunks)
        words = [i for i, c in enumerate(chunks) if _WORD.fullmatch(c)]
        for at in range(0, len(words), LINE):
            part = words[at : at + LINE]
            ids = self.tokenizer.encode("".join([chunks[i] for i in part]), add_special_tokens=False).ids
            ends = list(accumulate([self.size[t] for t in ids]))
            start, total = 0, 0
            for i in part:
                total += len(chunks[i].encode())
                stop = bisect_left(ends, total, start) + 1
                out[i], start = ids[start:stop], stop
        rest = [i for i, c in enumerate(chunks) if not _WORD.fullmatch(c)]
        for i, e in zip(rest, self.tokenizer.encode_batch([chunks[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class Pieces:
    """A sentencepiece ``.model``, which puts a blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        text = lambda i: bytes([int(self.sp.id_to_piece(i)[1:-1], 16)]) if self.sp.is_byte(i) else self.sp.id_to_piece(i).replace(BLANK, " ").encode()
        self.bytes_of = {i: text(i) for i in range(self.sp.vocab_size())}
        self.size = {i: len(v) for i, v in self.bytes_of.items()}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))]
        if any("\n" in p or re.search(f"[^{BLANK}]{BLANK}", p) or re.search(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}{BLANK}][{LETTERS}]", p) and _PLAIN.fullmatch(p.replace(BLANK, "")) for p in pieces):
            raise ValueError("only vocabularies are handled whose pieces hold no line feed, no blank after another character, and no Latin letter next to another plain character")

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk as they are within a text: the line feed put first, which joins nothing, keeps the library's own blank away."""
        return [ids[2:] for ids in self.sp.encode(["\n" + c for c in chunks], num_threads=1)]


BLANK = "▁"  # stands for a blank in the pieces of a .model file
LINE = 512  # words encoded in one line
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_WORD = re.compile(rf" [{LETTERS}]+")
# Texts of these alone, without runs of blanks or a blank after a line feed, are cut between letters and others: no apostrophe, which takes letters after it along.
_PLAIN = re.compile(r"(?:[!-&(-~¡-ÿ]|\n(?! )| (?! ))*")
_FINE = re.compile(rf" ?[{LETTERS}]+|[^{LETTERS}]+?(?=\n[{LETTERS}]| ?[{LETTERS}]|\Z)|\n")
# A blank that ends a run of white space, with more of it before: the byte-level pattern takes such runs whole.
_MIXED = re.compile(r"[^\S ](?: {2,}| (?=\s)| \Z)")
_COARSE = re.compile(r" +[^ ]*")


def chunks_of(text: str) -> list[str]:
    """A text that begins with a blank, in chunks that both vocabularies encode apart.

    Byte-level patterns cut plain texts between letters and other characters, and before the
    last character of white space; no piece of the other vocabulary reaches over these. Other texts are
    cut before runs of blanks, but for those that mix blanks with other white space.
    """
    if _PLAIN.fullmatch(text):
        return _FINE.findall(text)
    return [text] if _MIXED.search(text) else _COARSE.findall(text)


class _Numbers(dict):
    """Numbers for chunks, given on first sight."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n


class PairAligner:
    """Aligned chunks, each encoded and aligned on first sight and remembered up to ``most`` chunks.

    New chunks are put in a row, encoded, and their end arrays aligned as one: a chunk ends
    on both sides at once, so no group reaches over its end. By number, a chunk has its counts
    (tokens of A and B, groups, links; all -1 if a side can't spell it), the text of its
    groups, and its linked pairs as ``a * width + b`` in one flat array.
    """

    def __init__(self, a: str, b: str, most: int = MOST_CHUNKS):
        self.a, self.b, self.most = ByteLevel(a), Pieces(b), most
        self.width = max(self.b.size) + 1
        self.span = (max(self.a.size) + 1) * self.width
        self._reset()

    def _reset(self) -> None:
        self.index, self.weight, self.texts = _Numbers(), 0, []
        self.counts, self.starts, self.links = np.zeros((0, 4), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        all_a, all_b = self.a.encode(chunks), self.b.encode(chunks)
        bad = self._misspelt(chunks, all_a, all_b)
        ids_a, ids_b = ([i for k, ids in enumerate(side) if k not in bad for i in ids] for side in (all_a, all_b))
        ends_a, ends_b = list(accumulate(map(self.a.size.__getitem__, ids_a))), list(accumulate(map(self.b.size.__getitem__, ids_b)))
        groups = align_tokens(ids_a, ids_b, ends_a, ends_b, self.width)
        counts, links, done = [], [], 0
        for k, (x, y) in enumerate(zip(all_a, all_b)):
            if k in bad:
                counts.append((-1, -1, -1, 0))
                self.texts.append("")
                continue
            done += len(x)
            texts, before, stop = [], len(links), -1
            while stop < done:
                stop, text, linked = next(groups)
                texts.append(text)
                links += linked
            counts.append((len(x), len(y), len(texts), len(links) - before))
            self.texts.append(";".join(texts))
        counts = np.array(counts, np.int64)
        self.starts = np.concatenate([self.starts, len(self.links) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.counts, self.links = np.concatenate([self.counts, counts]), np.concatenate([self.links, np.array(links, np.int64)])

    def _misspelt(self, chunks: list[str], all_a: list[list[int]], all_b: list[list[int]]) -> set[int]:
        """Places of chunks whose bytes a side doesn't give back; one look at all of them together tells that there are none."""
        want = [c.encode() for c in chunks]
        out = set()
        for side, found in ((self.a, all_a), (self.b, all_b)):
            sizes = [sum(map(side.size.__getitem__, ids)) for ids in found]
            if sizes == [*map(len, want)] and b"".join([side.bytes_of[i] for ids in found for i in ids]) == b"".join(want):
                continue
            out |= {k for k, (w, ids) in enumerate(zip(want, found)) if b"".join(map(side.bytes_of.__getitem__, ids)) != w}
        return out

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that begin with a blank, or are empty: (n_a, n_b, n_groups, n_links) of each, the text of its groups, how many
        distinct pairs it has, these pairs as ``a << 32 | b`` text by text, and their repeats. All is zero where a side doesn't spell the text."""
        if self.weight > self.most:
            self._reset()
        index, cut = self.index, []
        for t in texts:
            cut.append(list(map(index.__getitem__, chunks_of(t))) if t else [])
        fresh, index.fresh = index.fresh, []
        if fresh:
            self.weight += len(fresh) + sum(len(c) // LONG for c in fresh if len(c) >= LONG)
            self._learn(fresh)
        many = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter((i for c in cut for i in c), np.int64, int(many.sum()))
        doc = np.repeat(np.arange(len(cut)), many)
        good = np.ones(len(cut), bool)
        good[doc[self.counts[which, 0] < 0]] = False
        which, doc = which[good[doc]], doc[good[doc]]
        counts = np.zeros((len(cut), 4), np.int64)
        ends = np.searchsorted(doc, np.arange(len(cut) + 1))
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[which], axis=0)])
        counts[:] = sums[ends[1:]] - sums[ends[:-1]]
        lens = self.counts[which, 3]
        after = np.cumsum(lens)
        at = np.repeat(self.starts[which] - (after - lens), lens) + np.arange(int(lens.sum()))
        keys = np.sort(np.repeat(doc, lens) * self.span + self.links[at])
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        owner, code = np.divmod(keys[first], self.span)
        pairs = (code // self.width << ID_BITS) | code % self.width
        groups = [";".join(map(self.texts.__getitem__, c)) if ok else "" for c, ok in zip(cut, good)]
        return counts, groups, np.bincount(owner, minlength=len(cut)), pairs, np.diff(np.append(first, len(keys)))


def align_tokens(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int], width: int) -> Iterator[tuple[int, str, list[int]]]:
    """The groups in order: (index after its last token of A, its text ``a1,a2|b1``, its linked pairs as ``a * width + b``)."""
    for i, i2, j, j2 in diagonal_runs(ends_a, ends_b):
        if ends_a[i] == ends_b[j]:
            for k, (x, y) in enumerate(zip(ids_a[i:i2], ids_b[j:j2]), i + 1):
                yield k, f"{x}|{y}", [x * width + y]
        else:
            text = f"{','.join(map(str, ids_a[i:i2]))}|{','.join(map(str, ids_b[j:j2]))}"
            yield i2, text, [ids_a[x] * width + ids_b[y] for x, y in overlaps(ends_a, ends_b, i, i2, j, j2)]


@functools.lru_cache(maxsize=1)
def worker_aligner(a: str, b: str) -> PairAligner:
    """One aligner for all tasks of a worker."""
    return PairAligner(a, b)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Align the tokens of vocabulary ``a`` (byte-level ``.json``) and ``b`` (``.model``) in every text of ``docs``, a blank put before it.

    One row a document: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups
    (ids A of a group, ``|``, its ids B, groups joined by ``;``), pairs and times (the distinct
    linked id pairs as ``a << 32 | b``, and how often each is linked). A text that is null, empty,
    or that either side's bytes don't spell has no tokens: zeros, empty groups and no pairs.
    Repeated rows count each; a null doc_id stays null; other columns are left out; an empty
    table gives none. Texts are never cut off; memory is a slice of about ``SLICE_BYTES`` of texts,
    or one longer text, and what the worker remembers of chunks.
    """
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, row = worker_aligner(a, b), TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for start, stop in text_slices(texts, SLICE_BYTES):
                counts, groups, distinct, pairs, times = aligner.align([f" {t}" if t else "" for t in texts.slice(start, stop - start).to_pylist()])
                bounds = pa.array(np.concatenate([[0], np.cumsum(distinct)]), pa.int32())
                lists = [pa.ListArray.from_arrays(bounds, pa.array(v, k)) for v, k in ((pairs, pa.int64()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(groups))), ids.slice(start, stop - start), *(pa.array(c) for c in counts.T), pa.array(groups, pa.string()), *lists], names)
                row += len(groups)

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, kinds)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, n, best): in how many documents each id pair is linked, and whether no other pair of its A id is linked in more."""
    counts = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")).withColumn("a", F.shiftright("pair", ID_BITS)))
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return written(counts.join(top, "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best")))


def _ranges(counts: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges (first, last) of A ids with at most ``most`` pairs each, or of one id. The driver gets a row an A id, so the vocabulary bounds it."""
    out, room = [], 0
    for a, n in sorted((r.a, r.n) for r in counts.groupBy("a").agg(F.count("*").alias("n")).collect()):
        if not out or n > room:
            out.append((a, a))
            room = most
        out[-1] = (out[-1][0], a)
        room -= n
    return out


def link_strength(aligned: DataFrame, most: int = PAIRS_AT_ONCE) -> DataFrame:
    """(row, n_best, count_sum) of every row of ``aligned`` (written) that has links.

    n_best is the number of links whose pair is the most frequent of its A id, ties included;
    count_sum adds the document counts of all links. The counts are joined by ranges of A ids with
    at most ``most`` pairs, each range sent to all executors, so that links themselves are never
    shuffled and a pair of every document is no hot key; only a row's sums are.
    """
    counts, out = pair_counts(aligned), None
    for first, last in _ranges(counts, most):
        links = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("row", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
        here = links.where(F.shiftright("pair", ID_BITS).between(first, last))
        part = counts.where(F.col("a").between(first, last)).select("pair", "n", "best")
        sums = here.join(F.broadcast(part), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = sums if out is None else out.unionByName(sums)
    if out is None:
        return aligned.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum")).where("false")
    return out.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, a: str, b: str) -> DataFrame:
    """``align`` with n_best and count_sum of the whole corpus, without pairs: a row a document."""
    found = align(docs, a, b)
    aligned = written(found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return aligned.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(link_strength(aligned), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
