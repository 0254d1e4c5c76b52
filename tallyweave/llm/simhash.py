"""SimHash near-duplicates through a positional byte index with count filtering (operator 7).

Two 64-bit fingerprints with at most three differing bits differ in at most three of their
eight bytes, so at least five positional bytes are equal. The fourteen blocks of the Steiner
system S(3,4,8) are sets of four positions such that any five positions contain one of them:
postings are keyed by the bytes at these four positions at once, and every pair that the
guarantee covers shares a posting list, while unrelated fingerprints share one with
probability 14 / 2^32. Within a list, postings of the other four positions tally what a
fingerprint shares with the others; pairs that reach five are verified bit by bit.

Only distinct fingerprints enter the index, with the smallest doc_id of each, so exact
copies never form pairs. A list of over ``BLOCK_ROWS`` fingerprints is dealt out again by
each fifth position; where even five equal bytes leave more, a fingerprint's links are
looked up one by one among the values that its other three bytes can take, so work stays
linear. A group returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, ROW, arrow_map, connected_components, partitions, run_bounds, sorted_runs, with_row, written

MAX_BITS = 3
BLOCK_ROWS = 4096


def position_blocks() -> list[int]:
    """Bit masks of the fourteen sets of four byte positions.

    They are the planes of the affine space of three bits: the four positions of a block
    have exclusive-or zero, and three positions determine the fourth.
    """
    planes = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
    return [sum(0xFF << (8 * p) for p in b) for b in planes]


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text: a bit is set if it is set in over half the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], np.uint64)
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fp long")


def _forest(n: int, neighbours) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what ``neighbours`` (of a place, among the free ones) connects."""
    free = np.ones(n, bool)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first in range(n):
        if not free[first]:
            continue
        stack, free[first] = [first], False
        while stack:
            x = stack.pop()
            near = neighbours(x, free)
            if len(near):
                a.append(np.full(len(near), x))
                b.append(near)
                stack.extend(near.tolist())
                free[near] = False
    return np.concatenate(a), np.concatenate(b)


def list_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the links among the distinct fingerprints of a posting list.

    The postings of the positions that differ within the list give each fingerprint's tally
    of shared positional bytes; those that reach the guaranteed number are verified.
    """
    columns = fps.view(np.uint8).reshape(-1, 8)
    varied = np.flatnonzero((columns != columns[0]).any(axis=0))
    need = 8 - max_bits - (8 - len(varied))  # equal bytes among the varied positions
    order = np.argsort(columns[:, varied], axis=0, kind="stable").T
    ends = [np.concatenate([[0], np.cumsum(np.bincount(columns[:, c], minlength=256))]) for c in varied]

    def neighbours(x: int, free: np.ndarray) -> np.ndarray:
        if need <= 0:
            near = np.flatnonzero(free)
        else:
            tally = np.zeros(len(fps), np.int8)
            for o, end, value in zip(order, ends, columns[x, varied].tolist()):
                tally[o[end[value] : end[value + 1]]] += 1
            near = np.flatnonzero((tally >= need) & free)
        return near[np.bitwise_count(fps[near] ^ fps[x]) <= max_bits]

    return _forest(len(fps), neighbours)


def probed_links(fps: np.ndarray, free_mask: int, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A forest that spans the links among the distinct ``fps`` that differ in bits of ``free_mask`` alone, by looking up every value in reach.

    Each pattern of bits is looked up for all of them at once; links between fingerprints that are connected already are passed over.
    """
    fps = np.sort(fps)
    bits = [np.uint64(1 << i) for i in range(64) if free_mask >> i & 1]
    top = np.arange(len(fps))
    a, b = [], []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = int(top[x])
        return x

    for n in range(1, max_bits + 1):
        for some in combinations(bits, n):
            other = fps ^ np.bitwise_or.reduce(some)
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            here = np.flatnonzero((fps[at] == other) & (other > fps))
            while (top[top] != top).any():
                top[:] = top[top]
            here = here[top[here] != top[at[here]]]
            for x, y in zip(here.tolist(), at[here].tolist()):
                p, q = find(x), find(y)
                if p != q:
                    top[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
    return fps[np.array(a, np.int64)], fps[np.array(b, np.int64)]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (a, b) that connect whatever is linked among the distinct fingerprints ``fps`` (fp).

    A task holds lists of at most ``block_rows`` fingerprints, or of five equal bytes, which are at most 2^24.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the blocks guarantee links of at most three bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = position_blocks()
    cut = lambda m: F.col("fp").bitwiseAND(F.lit(signed(m)))
    postings = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(signed(m)).alias("mask"), cut(m).alias("bytes")) for m in masks])).alias("p")).select("fp", "p.mask", "p.bytes")
    counted = postings.groupBy("mask", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    lists = postings.join(counted, ["mask", "bytes"])
    small = lists.where(F.col("n") <= block_rows).select("mask", "bytes", "fp")
    fifth = F.filter(F.array(*[F.lit(signed(0xFF << 8 * p)) for p in range(8)]), lambda m: F.col("mask").bitwiseAND(m) == 0)
    large = lists.where(F.col("n") > block_rows).select("fp", F.explode(F.transform(fifth, lambda m: F.col("mask").bitwiseOR(m))).alias("mask"))
    large = large.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bytes"), "fp").distinct()
    keys = ["mask", "bytes"]

    def link(batches):
        for table in sorted_runs(batches, keys):
            bounds = run_bounds(table, keys)
            all_fps, mask = table.column("fp").to_numpy().view(np.uint64), table.column("mask").to_numpy().view(np.uint64)
            a, b = [], []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                own = int(mask[s])
                f = np.ascontiguousarray(all_fps[s:e])
                if e - s > block_rows:
                    i, j = probed_links(f, ~own & (2**64 - 1), max_bits)
                    a.append(i)
                    b.append(j)
                else:
                    i, j = list_links(f, max_bits)
                    a.append(f[i])
                    b.append(f[j])
            if sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    dealt = small.union(large).repartition(partitions(fps.sparkSession), *keys).sortWithinPartitions(*keys)
    return arrow_map(dealt, link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; other columns are ignored): doc_id, fp, component_id.

    Fingerprints link at ``max_bits`` differing bits; component_id is the smallest doc_id
    that links reach. A null or empty text has fingerprint zero, linked like any other.
    Rows of equal doc_id are rows of their own. A null doc_id never names a component while
    its fingerprint's component has another. An empty table gives none.
    """
    fps = written(fingerprints(docs, shingle, seed))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    roots = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = roots.groupBy("component").agg(F.min("first").alias("component_id"))
    named = roots.join(firsts, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", distinct_ids: bool = False) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of equal ids the one with the smallest hash of its text.

    Every row is judged by its own text; a null id comes after all others and counts for
    itself. Every component keeps its row, so no group of texts is lost, but an id may stay in
    several rows; with ``distinct_ids`` one row of it is left, chosen by the hash. Other
    columns, whatever their names, are returned as they are; an empty table gives none.
    """
    rows = with_row(docs)
    parts = near_duplicates(rows.select(F.col(ROW).alias("doc_id"), F.col(OWN)["text"].alias("text"))).select(F.col("doc_id").alias(ROW), "component_id")
    named = rows.select(ROW, F.col(OWN)[key].alias("id"), F.xxhash64(F.col(OWN)["text"]).alias("hash")).join(parts, ROW)
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash", ROW)).alias("b")).select("b.*")
    kept = best.select(ROW)
    if distinct_ids:
        kept = best.where("not none").groupBy("id").agg(F.min(F.struct("hash", ROW)).alias("b")).select(f"b.{ROW}").union(best.where("none").select(ROW))
    return rows.join(kept, ROW, "left_semi").select(f"{OWN}.*")
