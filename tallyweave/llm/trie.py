"""Prefix trie of conversations, rolled up by centroid decomposition (operator 12).

A node is a distinct sequence of first turns. It is known by its depth and a polynomial
hash of its turns modulo the prime 2**127 - 1, the turns themselves hashed by SHA-256, so
that a conversation of any length is hashed in parts which are put together afterwards,
and the turns before and after a splice add up. The smallest member of a node owns it: what a
conversation owns is the end of its path, so (owner, depth) names a node too.

Sums over subtrees come from a centroid decomposition of the edges to the parents. All nodes
that hold over half of a component below them form its path from the top to the centroid;
the component's total below the centroid is added along that path, the centroid goes, and
what is left are its children's components and the rest above. Components of more than
``SMALL`` nodes are split in Spark, a round for all of them at once; the others, dealt out by
hash, are finished in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, partitions, run_bounds, sorted_runs, written

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"turns of a conversation").digest()[:15], "big")
BACK = pow(BASE, -1, PRIME)
MOST_HEAD = 5  # turns that a conversation takes over at most
SMALL = 2048  # nodes of a component that one task finishes
PIECE = 1 << 16  # ids in one piece of the text that a node's ends are hashed as
ROOT = bytes(16)


def _bytes(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _int(value: bytes) -> int:
    return int.from_bytes(value, "big")


# Turns of each conversation, numbered and hashed up to each


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, state, digest, n_chars): every turn with its place from 1 on and the hash of all turns up to it.

    Turns are ordered by turn (null first), role and the text's SHA-256; null roles and
    texts count as empty, rows without a conv_id belong to no conversation. The rows are dealt
    out by ranges of that order, so a long conversation is spread over tasks. Each task numbers
    and hashes its stretch of a conversation by itself; the driver adds up the stretches that
    go on over a task's end, of which there is one a task.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.sha2(text, 256).alias("order"), F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 30)).alias("digest"), F.char_length(text).cast("long").alias("n_chars")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "order"]
    ranged = rows.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "digest", "n_chars")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, state, power = TaskContext.get().partitionId(), None, 0, 0, 1
        for batch in batches:
            places, states = [], []
            for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist()):
                if conv != last:
                    last, place, state, power = conv, 0, 0, 1
                power = power * BASE % PRIME
                place, state = place + 1, (state + _int(digest) * power) % PRIME
                places.append(place)
                states.append(_bytes(state))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(states, pa.binary()), batch.column("digest"), batch.column("n_chars")], ["part", "conv_id", "place", "state", "digest", "n_chars"])

    parts = written(arrow_map(ranged, number, "part int, conv_id long, place long, state binary, digest binary, n_chars long"))
    before = _stretches_before(parts)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("part", "conv_id", "place", "state")}
            places, states = columns["place"], columns["state"]
            for i, key in enumerate(zip(columns["part"], columns["conv_id"])):
                if key in before:
                    n, state, power = before[key]
                    places[i], states[i] = places[i] + n, _bytes((state + power * _int(states[i])) % PRIME)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(states, pa.binary()), batch.column("digest"), batch.column("n_chars")], ["conv_id", "place", "state", "digest", "n_chars"])

    return arrow_map(parts, shift, "conv_id long, place long, state binary, digest binary, n_chars long")


def _stretches_before(parts: DataFrame) -> dict[tuple[int, int], tuple[int, bytes, int]]:
    """(part, conv_id) of stretches that go on from an earlier task: turns, hash and power of the base before. At most one a task."""
    edges = parts.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    first = edges.select("part", F.col("lo").alias("conv_id")).union(edges.select("part", "hi")).distinct()
    rows = parts.join(F.broadcast(first), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.max("place").alias("n"), F.max_by("state", "place").alias("state")).collect()
    out, last = {}, None
    for part, conv, n, state in sorted(map(tuple, rows)):
        if conv != last:
            last, total, sum_ = conv, 0, 0
        else:
            out[part, conv] = (total, sum_, pow(BASE, total, PRIME))
        sum_ = (sum_ + pow(BASE, total, PRIME) * _int(state)) % PRIME
        total += n
    return out


# Conversations rebuilt, as members of nodes


def members(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_chars): the nodes that each rebuilt conversation passes, the root included.

    Conversation c takes the first h turns of conversation c - c % 100 and goes on with its own
    turns after its first h; h is the CRC-32 of its decimal text modulo 6. ``turns`` is written.
    """
    head = turns.where(F.col("place") <= MOST_HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "state", "n_chars"))).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    own = head.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("origin"), h.alias("h"), "head")
    origin = head.select(F.col("conv_id").alias("origin"), F.col("head").alias("origin_head"))
    none = F.filter("head", lambda x: F.lit(False))
    known = own.join(origin, "origin", "left").withColumn("taken", F.slice(F.coalesce("origin_head", none), F.lit(1), F.col("h")))
    known = written(known.select("conv_id", "h", "taken", F.get("head", F.col("h") - 1)["state"].alias("cut")))
    root = F.lit(bytearray(ROOT))
    taken = known.select("conv_id", F.explode(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("place"), root.alias("state"), F.lit(0).cast("long").alias("n_chars"))), "taken")).alias("t"), "taken")
    before = F.when(F.col("t.place") > 1, F.get("taken", F.col("t.place").cast("int") - 2)["state"]).when(F.col("t.place") == 1, root)
    taken = taken.select("conv_id", F.col("t.place").alias("depth"), F.col("t.state").alias("node"), before.alias("parent"), F.col("t.n_chars").alias("n_chars"))
    tail = known.select("conv_id", "h", F.size("taken").alias("m"), "cut", F.get("taken", F.size("taken") - 1)["state"].alias("base"))
    joined = turns.join(tail, "conv_id").where("place > h")

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shifts = {k: pow(BASE if k > 0 else BACK, abs(k), PRIME) for k in range(-6, 7)}
        for batch in batches:
            depth, nodes, parents = [], [], []
            for place, state, digest, h, m, cut, base in zip(*(batch.column(c).to_pylist() for c in ("place", "state", "digest", "h", "m", "cut", "base"))):
                node = (_int(base or ROOT) + shifts[m - h] * (_int(state) - _int(cut or ROOT))) % PRIME
                depth.append(place - h + m)
                nodes.append(_bytes(node))
                parents.append(_bytes((node - _int(digest) * pow(BASE, depth[-1], PRIME)) % PRIME))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(depth, pa.int64()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), batch.column("n_chars")], ["conv_id", "depth", "node", "parent", "n_chars"])

    return taken.unionByName(arrow_map(joined, splice, "conv_id long, depth long, node binary, parent binary, n_chars long"))


def trie_nodes(paths: DataFrame) -> DataFrame:
    """(node, parent, depth, owner, n_convs, n_chars, n_children, size) of ``members`` (written); size counts the nodes of the subtree.

    A node's subtree holds all that its members own, but for what its owner owns above it.
    """
    nodes = written(paths.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars")))
    owned = nodes.groupBy("owner").agg(F.count("*").alias("owned"), F.min("depth").alias("since"))
    below = paths.join(owned, F.col("conv_id") == F.col("owner")).groupBy("node").agg(F.sum("owned").alias("below"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    out = nodes.join(below, "node").join(children, "node", "left").join(owned.select("owner", "since"), "owner")
    return out.select("node", "parent", "depth", "owner", "n_convs", "n_chars", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), (F.col("below") - F.col("depth") + F.col("since")).alias("size"))


# Sums over subtrees


def rollup(nodes: DataFrame, paths: DataFrame, values: dict, small: int = SMALL) -> DataFrame:
    """``nodes`` (as ``trie_nodes`` has them) as (node, one column for each of ``values``): sums of these expressions over subtrees.

    ``paths`` tells the node that an owner passes at a depth, which shows whether a centroid
    lies above what it owns. A round halves every component at least, so rounds grow with the
    logarithm of the largest; each reads only nodes of components that are still large.
    """
    names = list(values)
    sums = [F.sum(n).cast("long").alias(f"all_{n}") for n in names]
    left = nodes.select("node", "parent", "depth", "owner", F.lit(bytearray(ROOT)).alias("component"), "size", *[v.cast("long").alias(n) for n, v in values.items()], *[F.lit(0).cast("long").alias(f"sum_{n}") for n in names])
    columns, parts, done = left.columns, [], []
    left = written(left)
    while True:
        whole = left.groupBy("component").agg(F.max("size").alias("whole"))
        left = left.join(whole, "component")
        parts.append(left.where(F.col("whole") <= small).select(*columns))
        left = written(left.where(F.col("whole") > small))
        if left.isEmpty():
            break
        path = F.col("size") * 2 > F.col("whole")
        center = left.where(path).groupBy("component").agg(F.min_by(F.struct("node", "depth", "size"), "size").alias("center"))
        # the node of each owner's path one below the centroid, if its parent is the centroid
        asked = left.select("component", "owner").distinct().join(center, "component")
        steps = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") - 1).alias("at"), F.col("node").alias("child"), F.col("parent").alias("above"))
        below = asked.join(steps, (asked["owner"] == steps["owner"]) & (asked["center.depth"] == steps["at"]) & (asked["center.node"] == steps["above"])).select("component", asked["owner"], "child")
        split = left.join(center, "component").join(below, ["component", "owner"], "left").withColumn("child", F.when(F.col("depth") > F.col("center.depth"), F.col("child")))
        split = written(split)
        inside = F.col("child").isNotNull() | (F.col("node") == F.col("center.node"))
        totals = split.where(inside).groupBy("component").agg(*sums)
        split = split.join(totals, "component")
        added = {f"sum_{n}": F.col(f"sum_{n}") + F.when(path, F.col(f"all_{n}")).otherwise(0) for n in names}
        split = split.withColumns(added).withColumns({"size": F.when(path, F.col("size") - F.col("center.size")).otherwise(F.col("size")), "component": F.coalesce("child", "component")})
        done.append(split.where(F.col("node") == F.col("center.node")).select("node", *[F.col(f"sum_{n}").alias(n) for n in names]))
        left = written(split.where(F.col("node") != F.col("center.node")).select(*columns))
    for part in parts:
        done.append(_finish(part, names))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _finish(nodes: DataFrame, names: list[str]) -> DataFrame:
    """The same decomposition for components of bounded size, many at once in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, ["component"]):
            bounds = run_bounds(table, ["component"])
            where = {n: i for i, n in enumerate(table.column("node").to_pylist())}
            up = np.array([where.get(p, -1) for p in table.column("parent").to_pylist()], np.int64)
            component = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            up[(up >= 0) & (component[up] != component)] = -1
            values = np.stack([table.column(n).to_numpy() for n in names], 1)
            sums = np.stack([table.column(f"sum_{n}").to_numpy() for n in names], 1)
            sums = sums + centroid_sums(up, table.column("depth").to_numpy(), table.column("size").to_numpy(), values)
            yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["node", *names])

    dealt = nodes.repartition(partitions(nodes.sparkSession), "component").sortWithinPartitions("component", "depth")
    return arrow_map(dealt, run, "node binary, " + ", ".join(f"{n} long" for n in names))


def centroid_sums(up: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over subtrees of a forest, each component split at its centroid until none is left.

    ``up`` holds each node's parent in the forest (-1: a top), ``size`` the nodes of its subtree.
    """
    n = len(up)
    sums, size, alive, up = np.zeros_like(values), size.astype(np.int64).copy(), np.ones(n, bool), up.copy()
    levels = [np.flatnonzero(depth == d) for d in np.unique(depth)]
    top = _tops(up, levels)
    while alive.any():
        path = alive & (2 * size > size[top])
        at = np.flatnonzero(path)
        order = at[np.lexsort((size[at], top[at]))]
        center = order[np.concatenate([[True], top[order][1:] != top[order][:-1]])]
        center_of = np.full(n, -1)
        center_of[top[center]] = center
        mine = center_of[top]  # each node's centroid, read off its top
        up[alive & (up >= 0) & (up == mine)] = -1
        below = _tops(up, levels)
        inside = alive & ((below != top) | (np.arange(n) == mine))
        totals = np.zeros_like(values)
        np.add.at(totals, top[inside], values[inside])
        sums[at] += totals[top[at]]
        taken = size[mine[at]]
        size[at] -= taken
        alive[center] = False
        top = below
    return sums


def _tops(up: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The topmost node above each, level by level from the top."""
    top = np.arange(len(up))
    for level in levels:
        inner = level[up[level] >= 0]
        top[inner] = top[up[inner]]
    return top


# Ends, and all together


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): SHA-256 of the decimal ids in ascending order, joined by commas.

    Ids are dealt out by ranges of node and id and joined to pieces; the pieces of a node, a row
    for about ``PIECE`` ids, are hashed in order as they stream by, so a node of any size takes little memory.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            nodes, ids = batch.column("node"), batch.column("conv_id").to_pylist()
            bounds = run_bounds(pa.Table.from_batches([batch]), ["node"]) if batch.num_rows else []
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                for start in range(int(a), int(b), PIECE):
                    rows.append((nodes[start].as_py(), part, seq, ",".join(map(str, ids[start : min(start + PIECE, int(b))]))))
                    seq += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64(), pa.string()))], ["node", "part", "seq", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hash_ = None, None
        for batch in batches:
            out = []
            for node, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
                if node != last:
                    if hash_ is not None:
                        out.append((last, hash_.hexdigest()))
                    last, hash_ = node, hashlib.sha256(piece.encode())
                else:
                    hash_.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], ["node", "ends_sha256"])
        if hash_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([hash_.hexdigest()])], ["node", "ends_sha256"])

    count = partitions(ends.sparkSession)
    pieces = arrow_map(ends.repartitionByRange(count, "node", "conv_id").sortWithinPartitions("node", "conv_id"), join, "node binary, part int, seq long, piece string")
    return arrow_map(pieces.repartition(count, "node").sortWithinPartitions("node", "part", "seq"), digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt ``conversations`` (conv_id, turn, role, text; other columns are ignored), a row a node.

    conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children,
    n_leaves and saved_tokens (over the subtree: childless nodes, and code points of a node's last
    turn times its members but one), ends_sha256 (of the members that end there). Null roles and
    texts count as empty, and a null turn comes first; turns of one number are ordered by role,
    then by the text's SHA-256; repeated rows are turns of their own; rows without a conv_id are left out. An
    empty table has no conversation and so no node. Texts of any length are hashed where they are read and never move.
    """
    turns = written(numbered_turns(conversations))
    paths = written(members(turns))
    nodes = written(trie_nodes(paths))
    ends = paths.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    sums = rollup(nodes, paths, {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    above = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(sums, "node").join(ends_digest(ends), "node", "left").join(above, "parent", "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
