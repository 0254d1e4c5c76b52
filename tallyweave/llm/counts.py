"""Token counts without token ids (operator 13).

Byte-pair merging over a heap and a linked list: the adjacent pair of the lowest rank is
popped again and again, and its two symbols become one. A text has as many tokens as it
has symbols at first, minus the merges; a symbol that stays alone and isn't in the
vocabulary stands for its bytes. No id is ever looked up.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices

BLANK = "▁"  # stands for a blank in the pieces of a .model file
SLICE_BYTES = 2 << 20
MOST_CHUNKS = 500_000  # remembered by a worker; those of over LONG characters count for many
LONG = 64


def merge(symbols: list[str], rank: dict[str, float]) -> list[str]:
    """What ``symbols`` are once no two neighbours join to a ranked string: lowest rank first, then leftmost.

    A heap entry names a pair by its left symbol and its joint length; it is stale, and
    passed over, if the left symbol is gone or it and its right neighbour have another length by now.
    """
    n, pieces = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, len(a) + len(b)) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if (r := rank.get(a + b)) is not None]
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        j = after[i]
        if pieces[i] is None or j == n or len(pieces[i]) + len(pieces[j]) != size:
            continue
        joined = pieces[i] = pieces[i] + pieces[j]
        pieces[j] = None
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(joined + pieces[k])) is not None:
                heappush(heap, (r, i, size + len(pieces[k])))
        k = before[i]
        if k >= 0 and (r := rank.get(pieces[k] + joined)) is not None:
            heappush(heap, (r, k, len(pieces[k]) + size))
    return [p for p in pieces if p is not None]


class PieceRanks:
    """The pieces of a sentencepiece ``.model`` of the BPE kind with byte fallback.

    A text is cut where no piece reaches over: before a run of blanks that follows another
    character, and around line feeds. Both cuts are taken only if the vocabulary bears them out.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(i, sp.is_byte(i), sp.is_control(i) or sp.is_unknown(i), sp.is_unused(i)) for i in range(sp.vocab_size())]
        if not any(b for _, b, _, _ in kinds) or any(u for _, _, _, u in kinds) or sp.normalize(" a  b\tc　ﬁ ") != f"{BLANK}{BLANK}a{BLANK}{BLANK}b\tc　ﬁ{BLANK}":
            raise ValueError("only models with byte fallback, a leading blank, no unused pieces and no other normalisation are handled")
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i, byte, special, _ in kinds if not byte and not special}
        self.cut = ""
        if not any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.rank):
            self.cut = rf"{BLANK}*[^{BLANK}]+|{BLANK}+"
            if not any("\n" in p for p in self.rank):
                self.cut = rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n"
        self.find = re.compile(self.cut or r"(?s).+").findall

    def chunks(self, text: str) -> Iterable[str]:
        return self.find(BLANK + text.replace(" ", BLANK)) if text else ()

    def tokens(self, chunk: str) -> int:
        """Symbols of the chunk, minus merges; a lone character without a piece is as many tokens as it has bytes."""
        left = merge(list(chunk), self.rank)
        return len(left) + sum(len(p.encode()) - 1 for p in left if len(p) == 1 and p not in self.rank)


class ByteRanks:
    """A byte-level ``.tiktoken`` file of ranks; texts are first cut by a pattern, and special strings are plain text."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a).decode("latin-1"): int(r) for a, r in map(bytes.split, f)}
        self.chunks = regex.compile(pattern).findall

    def tokens(self, chunk: str) -> int:
        symbols = chunk.encode().decode("latin-1")
        return 1 if symbols in self.rank else len(merge(list(symbols), self.rank))


class Counter(dict):
    """Token counts of chunks, reckoned on first sight and remembered up to ``most`` chunks."""

    def __init__(self, ranks: PieceRanks | ByteRanks, most: int = MOST_CHUNKS):
        super().__init__()
        self.ranks, self.most, self.weight = ranks, most, 0

    def __missing__(self, chunk: str) -> int:
        n = self.ranks.tokens(chunk)
        self.weight += 1 + len(chunk) // LONG
        if self.weight > self.most:
            self.clear()
            self.weight = 0
        self[chunk] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.ranks.chunks(text)))


@functools.lru_cache(maxsize=1)
def worker_counter(path: str, pattern: str | None) -> Counter:
    """One counter for all tasks of a worker."""
    if path.endswith(".model"):
        return Counter(PieceRanks(path))
    if path.endswith(".tiktoken") and pattern:
        return Counter(ByteRanks(path, pattern))
    raise ValueError("a .model file, or a .tiktoken file and its pattern, is needed")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 4096, pattern: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text; other columns are left out) as (doc_id, n_bytes, n_tokens, over_limit), a row each.

    ``vocabulary`` is a ``.model`` file, or a ``.tiktoken`` file together with the ``pattern``
    that cuts texts. A null or empty text has neither bytes nor tokens; a null doc_id stays null;
    repeated rows are counted each; an empty table gives none. Texts are never cut off: a very
    long one takes memory in proportion to its longest stretch without a blank. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(vocabulary, pattern)
        for batch in batches:
            texts = batch.column("text")
            for a, b in text_slices(texts, SLICE_BYTES):
                n = [counter.count(t) if t else 0 for t in texts.slice(a, b - a).to_pylist()]
                rest = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([rest.column("doc_id"), rest.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
