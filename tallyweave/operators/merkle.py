"""Digests of large sets of ids as trees, and the ids in which two sets differ.

A node is a prefix of the ids' SHA-256; a leaf's digest covers its ids in order, a node's
those of its at most sixteen children. Ids are gathered a leaf at a time, so with leaves
deep enough no row is large, and two trees are compared from the root down: only subtrees whose digests differ are looked into.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

LEAF_IDS = 256


def leaf_depth(count: int) -> int:
    """Digits of a leaf's prefix so that it has about ``LEAF_IDS`` ids at most."""
    depth = 0
    while count > LEAF_IDS << 4 * depth:
        depth += 1
    return depth


def tree(ids: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, level, prefix, n, digest) of ``ids`` (keys, id), written; level 0 has the root of each key. An id that occurs twice counts twice."""
    spread = ids.select(*keys, "id", F.substring(F.sha2("id", 256), 1, depth).alias("prefix"))
    leaves = spread.groupBy(*keys, "prefix").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("id")), "\n"), 256).alias("digest"))
    levels = [cut(leaves.select(*keys, F.lit(depth).alias("level"), "prefix", "n", "digest"))]
    for level in range(depth - 1, -1, -1):
        child = F.concat("prefix", F.lit(":"), "digest")
        above = levels[-1].groupBy(*keys, F.substring("prefix", 1, level).alias("up")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list(child)), "\n"), 256).alias("digest"))
        levels.append(cut(above.select(*keys, F.lit(level).alias("level"), F.col("up").alias("prefix"), "n", "digest")))
    return reduce(DataFrame.unionByName, levels)


def roots(ids: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, n, digest): one digest for all ids of each key."""
    return tree(ids, keys, depth).where("level = 0").select(*keys, "n", "digest")


def differences(a: DataFrame, b: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """(keys, id, side): ids that only the first (a) or only the second (b) of two sets has."""
    one, two = tree(a, keys, depth), tree(b, keys, depth)
    on = [*keys, "prefix"]
    open_ = None
    for level in range(depth + 1):
        x, y = one.where(F.col("level") == level).select(*on, F.col("digest").alias("x")), two.where(F.col("level") == level).select(*on, F.col("digest").alias("y"))
        if open_ is not None:
            under = open_.withColumnRenamed("prefix", "up")
            x, y = (t.withColumn("up", F.substring("prefix", 1, level - 1)).join(under, [*keys, "up"], "left_semi").drop("up") for t in (x, y))
        open_ = cut(x.join(y, on, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*on))
    within = lambda ids: ids.select(*keys, "id", F.substring(F.sha2("id", 256), 1, depth).alias("prefix")).join(open_, on, "left_semi").select(*keys, "id")
    mine, theirs = within(a), within(b)
    only = lambda x, y, side: x.join(y, [*keys, "id"], "left_anti").distinct().withColumn("side", F.lit(side))
    return only(mine, theirs, "a").unionByName(only(theirs, mine, "b"))
