"""Interval joins as bucketed equi-joins, as-of joins, and time islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


CELL_NS = 1_000_000_000  # of a time cell's width per sixty-fourth, at least
HOUR_NS = 3_600_000_000_000


def floor_div(value: Column, width: int) -> Column:
    """Integer quotient rounded down, exact for any long."""
    w = F.lit(width).cast("long")
    return F.call_function("div", value - F.pmod(value, w), w)


def time_bucket(ts: Column, window_ns: int) -> Column:
    return floor_div(ts, window_ns) if window_ns > 0 else ts


def range_join(left: DataFrame, right: DataFrame, keys: list[str], window_ns: int, ts: str = "ts_ns", how: str = "inner") -> DataFrame:
    """Pairs that agree in ``keys`` and lie at most ``window_ns`` apart.

    Columns of the sides become l_* and r_*. Each left row goes to the buckets around its
    own, so that a right row meets it in exactly one: an equi-join that shuffles and skew-joins like any other.
    """
    l_cols, r_cols = [F.col(c).alias(f"l_{c}") for c in left.columns], [F.col(c).alias(f"r_{c}") for c in right.columns]
    steps = F.array(*map(F.lit, (-1, 0, 1))) if window_ns > 0 else F.array(F.lit(0))
    a = left.select(*l_cols).withColumn("_step", F.explode(steps)).withColumn("_bucket", time_bucket(F.col(f"l_{ts}"), window_ns) + F.col("_step")).drop("_step")
    b = right.select(*r_cols).withColumn("_bucket", time_bucket(F.col(f"r_{ts}"), window_ns))
    on = [a[f"l_{k}"] == b[f"r_{k}"] for k in keys] + [a["_bucket"] == b["_bucket"], F.abs(a[f"l_{ts}"] - b[f"r_{ts}"]) <= F.lit(window_ns).cast("long")]
    return a.join(b, on, how).drop("_bucket")


def islands(rows: DataFrame, keys: list[str], window_ns: int, ts: str = "ts_ns") -> DataFrame:
    """``rows`` with island: a number within ``keys`` that rises where the time line has a gap of over ``window_ns``.

    No pair at most ``window_ns`` apart is split, and rows of equal time share an island. The
    running sum is taken in two steps, over coarse time cells and within each, so that a key
    with most of the rows is spread over tasks; only one row a cell is sorted for a whole key.
    """
    gap = F.lit(window_ns).cast("long")
    cell = floor_div(F.col(ts), max(window_ns, CELL_NS) * 64)
    # distinct times, so that ties can't come in another order in a later sort
    times = rows.select(*keys, ts).distinct().withColumn("_cell", cell)
    within = Window.partitionBy(*keys, "_cell").orderBy(ts)
    times = times.withColumn("_break", F.when(F.col(ts) - F.lag(ts).over(within) > gap, 1).otherwise(0))
    times = times.withColumn("_inner", F.sum("_break").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    edges = times.groupBy(*keys, "_cell").agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"), F.sum("_break").alias("_breaks"))
    over = Window.partitionBy(*keys).orderBy("_cell")
    new = F.when(F.col("_lo") - F.lag("_hi").over(over) > gap, 1).otherwise(0)
    edges = edges.withColumn("_base", F.sum(new + F.coalesce(F.lag("_breaks").over(over), F.lit(0))).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    numbers = times.join(edges.select(*keys, "_cell", "_base"), [*keys, "_cell"])
    numbers = numbers.select(*keys, ts, (F.col("_base") + F.col("_inner")).cast("long").alias("island"))
    return rows.join(numbers, [*keys, ts])


def last_mark(rows: DataFrame, marks: DataFrame, keys: list[str], ts: str = "ts_ns") -> DataFrame:
    """``rows`` with mark: the row of ``marks`` of the same ``keys`` with the greatest time up to their own, as a struct; null for none.

    ``marks`` have one row a key and time. Windows run over an hour of a key; from earlier
    hours comes their last mark, for which only one row an hour is sorted for a whole key.
    """
    own = rows.select(*keys, ts, F.struct(*rows.columns).alias("_row"))
    both = own.unionByName(marks.select(*keys, ts, F.struct(*marks.columns).alias("_mark")), allowMissingColumns=True).withColumn("_hour", floor_div(F.col(ts), HOUR_NS))
    hours = both.groupBy(*keys, "_hour").agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(ts))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(*keys, "_hour", F.last("_end", True).over(earlier).alias("_before"))
    upto = Window.partitionBy(*keys, "_hour").orderBy(ts).rangeBetween(Window.unboundedPreceding, 0)
    x = both.join(carried, [*keys, "_hour"]).withColumn("mark", F.coalesce(F.last("_mark", True).over(upto), "_before"))
    return x.where("_row is not null").select("_row.*", "mark")
