"""One anchor against sums of many: the first valid subset of each anchor, anchors in turn.

Anchors take members in the order of their stable keys, so anchors that can reach one member
depend on each other. Those more than two windows apart never do. The time line is laid out in
coarse ticks; ticks whose anchors are further apart than that are homes of their own, known from
the first and last anchor of each tick, and a home of few rows is a whole piece of work: its rows move once.
Rows of larger homes fall into islands, and islands of few rows are pieces of work too. Long islands are cut into cells,
and all cells are worked on at once in rounds: an anchor waits if an earlier anchor that
is still open, in its own cell or a neighbouring one, is at most two windows away. From
round to round cells are joined two by two, shifted by half a cell, so anchors that waited at an edge
are inside a cell next, and at the latest when one cell is left all are done.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..plans.rules import Rule, Tolerance
from .nearest import starts_within
from .rangejoin import floor_div, islands, last_mark

CELL_ROWS = 50_000  # of a cell, a home and a shard of them, about
TICKS = 1 << 16  # of the time line that hold anchors, at most; with their neighbours they are sent to all executors


class LimitReached(Exception):
    """A combination beyond the search limit would have to be looked at."""


def within(tolerance: Tolerance, diff: int, base: int) -> bool:
    return (tolerance.absolute is None or diff <= tolerance.absolute) and (tolerance.bps is None or diff * 10000 <= tolerance.bps * abs(base))


def sum_bounds(value: int, tolerance: Tolerance) -> tuple[float, float]:
    """Bounds that any sum within the tolerance of ``value`` keeps to; the percentage is taken of the larger of both."""
    low, high = float("-inf"), float("inf")
    if tolerance.absolute is not None:
        low, high = value - tolerance.absolute, value + tolerance.absolute
    if (bps := tolerance.bps) is not None:
        low = max(low, value - bps * abs(value) // 10000)
        if value < 0 and bps <= 10000:
            high = min(high, 10000 * value // (10000 + bps))
        elif value >= 0 and bps < 10000:
            high = min(high, 10000 * value // (10000 - bps))
    return low, high


class Search:
    """The first valid subset of one anchor's members, in order of size, then of places.

    Sums of what can still be added bound every branch; a branch that can't reach a valid
    sum is passed over, and the combinations in it count as looked at, by their number.
    ``visited`` counts the sums that were really formed.
    """

    def __init__(self, anchor: tuple[int, int], amounts: list[int], fees: list[int], rule: Rule):
        self.value, self.fee = anchor
        self.amounts, self.fees, self.rule, self.n = amounts, fees, rule, len(amounts)
        self.low, self.high = sum_bounds(self.value, rule.amount)
        self.counted = self.visited = 0
        self.least: list[list[int]] = []
        self.most: list[list[int]] = []

    def _bound(self, size: int) -> None:
        """least[k][i] and most[k][i]: the smallest and largest sum of k members from place i on."""
        n, a = self.n, self.amounts
        if not self.least:
            self.least, self.most = [[0] * (n + 1)], [[0] * (n + 1)]
        for k in range(len(self.least), size + 1):
            least, most = [0] * (n + 1), [0] * (n + 1)
            for i in range(n - k, -1, -1):
                low, high = a[i] + self.least[k - 1][i + 1], a[i] + self.most[k - 1][i + 1]
                least[i], most[i] = (low, high) if i == n - k else (min(low, least[i + 1]), max(high, most[i + 1]))
            self.least.append(least)
            self.most.append(most)

    def _count(self, combinations: int) -> None:
        self.counted += combinations
        if self.counted > self.rule.search_limit:
            raise LimitReached

    def _valid(self, total: int, fee: int) -> bool:
        r = self.rule
        return within(r.amount, abs(self.value - total), max(self.value, total)) and (not r.fee.enabled or within(r.fee, abs(self.fee - fee), max(self.fee, fee)))

    def _descend(self, start: int, need: int, total: int, fee: int) -> list[int] | None:
        if need == 1:
            stop = min(self.n, start + self.rule.search_limit - self.counted)
            low, high = self.low - total, self.high - total
            for i in range(start, stop):
                if low <= self.amounts[i] <= high and self._valid(total + self.amounts[i], fee + self.fees[i]):
                    self.visited += i - start + 1
                    return [i]
            self.visited += stop - start
            self._count(self.n - start)
            return None
        bounded = bool(self.least)
        for i in range(start, self.n - need + 1):
            here = total + self.amounts[i]
            if bounded and (here + self.least[need - 1][i + 1] > self.high or here + self.most[need - 1][i + 1] < self.low):
                self._count(comb(self.n - i - 1, need - 1))
            elif found := self._descend(i + 1, need - 1, here, fee + self.fees[i]):
                return [i, *found]
        return None

    def run(self) -> tuple[list[int] | None, bool]:
        """(places of the subset, whether the limit ended the search)."""
        try:
            for size in range(2, min(self.rule.one_to_many.max_members, self.n) + 1):
                if self.n <= self.rule.search_limit:  # else the limit falls within the first member's pairs
                    self._bound(size)
                    if self.least[size][0] > self.high or self.most[size][0] < self.low:
                        self._count(comb(self.n, size))
                        continue
                if found := self._descend(0, size, 0, 0):
                    return found, False
        except LimitReached:
            return None, True
        return None, False


def _solve(rows: pa.Table, rule: Rule) -> Iterator[tuple]:
    """(kind, anchor's id, ids of members, currency, record ids, diff, amount, note) of the open anchors of some cells.

    Rows come in order of stable keys. ``own`` rows are of the cell itself; others are near it. Kinds: group, limit, wait.
    """
    many, column = rule.one_to_many, lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    ts, cell, open_, own = (column(c) for c in ("ts_ns", "cell", "open", "own"))
    amount, fee = (column(c).tolist() for c in ("amount_minor", "fee_minor"))
    name = column("id").tolist() if "id" in rows.column_names else range(rows.num_rows)
    record, currency = column("record_id"), column("currency")
    ids = lambda at: [record[i] for i in at]
    pool = np.flatnonzero(pc.equal(rows.column("role"), many.many_role).to_numpy(zero_copy_only=False))
    pool = pool[np.lexsort((ts[pool], cell[pool]))]
    anchors = np.flatnonzero(open_)
    since, until = (starts_within(cell[pool], ts[pool], cell[anchors], ts[anchors] + d) for d in (-rule.window_ns, rule.window_ns + 1))
    waiting: list[tuple] = []
    taken: set[int] = set()
    for a, lo, hi in zip(anchors.tolist(), since.tolist(), until.tolist()):
        if own[a] and (hi - lo < 2 or a in taken):
            continue
        at = (int(cell[a]), int(ts[a]))
        if not own[a]:
            insort(waiting, at)
            continue
        k = bisect_left(waiting, (at[0], at[1] - 2 * rule.window_ns))
        if k < len(waiting) and waiting[k] <= (at[0], at[1] + 2 * rule.window_ns):
            insort(waiting, at)
            yield "wait", name[a], [], "", [], 0, 0, ""
            continue
        near = sorted(i for i in pool[lo:hi].tolist() if i not in taken and i != a)
        if len(near) < 2:
            continue
        value = amount[a]
        found, limit = Search((value, fee[a]), [amount[i] for i in near], [fee[i] for i in near], rule).run()
        if found:
            chosen = [near[i] for i in found]
            yield "group", name[a], [name[i] for i in chosen], currency[a], sorted(ids([a, *chosen])), abs(value - sum(amount[i] for i in chosen)), value, ""
            taken |= {a, *chosen}
            continue
        note = "combination search limit exceeded" if limit else ""
        if not limit and len(near) > many.max_members:
            total = sum(amount[i] for i in near)
            if within(rule.amount, abs(value - total), max(value, total)):
                note = "match requires more than max_members"
        if note:
            yield "limit", name[a], [], currency[a], [*ids([a]), *sorted(ids(near))], 0, value, note
            taken.add(a)


FOUND = pa.schema([("kind", pa.string()), ("anchor", pa.int64()), ("members", pa.list_(pa.int64())), ("currency", pa.string()), ("record_ids", pa.list_(pa.string())), ("diff", pa.int64()), ("amount_minor", pa.int64()), ("note", pa.string())])
FOUND_SQL = "kind string, anchor long, members array<long>, currency string, record_ids array<string>, diff long, amount_minor long, note string"


def _solved(dealt: DataFrame, place: list[str], rule: Rule) -> DataFrame:
    """What is found for the rows of each shard (ROW, shard and, if some are open alone or near a cell, open and own); those that agree in ``place`` make up a cell."""

    def solve(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by([(c, "ascending") for c in ("stable_key", "source_line", "batch_ord", "record_id")])
        if "own" not in shard.column_names:
            all_ = pa.array(np.ones(shard.num_rows, bool))
            shard = shard.append_column("own", all_).append_column("open", pc.equal(shard.column("role"), rule.one_to_many.anchor_role))
        cells = shard.select(place).to_pandas().groupby(place, sort=False).ngroup().to_numpy()
        found = list(_solve(shard.append_column("cell", pa.array(cells.astype(np.int64))), rule))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), FOUND)], schema=FOUND) if found else FOUND.empty_table()

    return dealt.groupBy("shard").applyInArrow(solve, FOUND_SQL)


def _cells(placed: DataFrame, window_ns: int, cell_rows: int) -> DataFrame:
    """``placed`` (with the size n of its island) with the cell of each row and those before and after it: runs of time of about ``cell_rows`` rows, none shorter than four windows."""
    width = max(4 * window_ns, 1)
    tick = floor_div(F.col("ts_ns"), width)
    long = placed.where(F.col("n") > cell_rows).withColumn("tick", tick)
    over = Window.partitionBy("currency", "island").orderBy("tick")
    ticks = long.groupBy("currency", "island", "tick").agg(F.count("*").alias("k")).withColumn("cell", floor_div(F.sum("k").over(over) - F.col("k"), cell_rows))
    ticks = ticks.withColumns({"before": F.coalesce(F.lag("cell").over(over), "cell"), "after": F.coalesce(F.lead("cell").over(over), "cell")}).drop("k")
    zero = {c: F.lit(0).cast("long") for c in ("cell", "before", "after")}
    return placed.where(F.col("n") <= cell_rows).withColumns(zero).unionByName(long.join(ticks, ["currency", "island", "tick"]).drop("tick"))


def _round(rows: DataFrame, rule: Rule, number: int, cell_rows: int) -> DataFrame:
    """One round over all cells, joined by twos ``number`` times."""
    joined = lambda c: F.shiftright(F.col(c) + ((1 << number) >> 1), number)
    near = rows.withColumn("in", joined("cell")).withColumn("seen", F.explode(F.array_distinct(F.array("in", joined("before"), joined("after")))))
    near = near.withColumn("own", F.col("in") == F.col("seen"))
    shards = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // cell_rows + 1)
    dealt = near.select("id", *ROW, "island", "open", "own", "seen", F.pmod(F.xxhash64("currency", "island", "seen"), F.lit(shards)).alias("shard"))
    return _solved(dealt, ["currency", "island", "seen"], rule)


ROW = ("record_id", "role", "currency", "ts_ns", "stable_key", "source_line", "batch_ord", "amount_minor", "fee_minor")


def _homes(anchors: DataFrame, window_ns: int) -> tuple[DataFrame, int]:
    """((currency, tick, home and, of the tick itself, the one before and the one after, what ``_home`` reads), width of a tick): a row for every tick of time that holds anchors or is beside one.

    Ticks are four windows wide, or as many times four of that as it takes for at most ``TICKS`` to hold
    anchors. Ticks whose anchors come within two windows of each other share a home.
    """
    least, gap = max(4 * window_ns, 1), F.lit(2 * window_ns).cast("long")
    widths = [least << j for j in range(0, 63, 2) if least << j < 1 << 63]
    counts = anchors.agg(*[F.approx_count_distinct(F.xxhash64("currency", floor_div(F.col("ts_ns"), w))) for w in widths]).first()
    width = next((w for w, n in zip(widths, counts) if n <= TICKS), widths[-1])
    over = Window.partitionBy("currency").orderBy("tick")
    ticks = anchors.groupBy("currency", floor_div(F.col("ts_ns"), width).alias("tick")).agg(F.min("ts_ns").alias("low"), F.max("ts_ns").alias("high"))
    begins = F.coalesce(F.col("low") - F.lag("high").over(over) > gap, F.lit(True))
    ticks = ticks.withColumn("begin", F.when(begins, F.col("tick"))).withColumn("home", F.max("begin").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    near = ticks.select("currency", "home", "low", "high", "tick", F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("step"))
    at = [F.max(F.when(F.col("step") == step, F.struct("home", "low", "high"))).alias(name) for name, step in (("here", 0), ("prior", 1), ("next", -1))]
    return cut(near.groupBy("currency", (F.col("tick") + F.col("step")).alias("tick")).agg(*at)), width


def _home(window_ns: int) -> Column:
    """The home of a record, whose anchors within the window all have; null where there is none."""
    ts, window = F.col("ts_ns"), F.lit(window_ns).cast("long")
    reach = {"here": ts.between(F.col("here.low") - window, F.col("here.high") + window), "prior": ts <= F.col("prior.high") + window, "next": ts >= F.col("next.low") - window}
    return F.coalesce(*[F.when(reached, F.col(f"{name}.home")) for name, reached in reach.items()])


def first_subsets(records: DataFrame, rule: Rule, cell_rows: int = CELL_ROWS, written: bool = False) -> DataFrame:
    """(kind, currency, record_ids, diff, amount_minor, note): groups, and anchors whose search ended at a limit. ``written`` records are read off a table as they are."""
    many = rule.one_to_many
    free = records.where(F.col("role").isin(many.anchor_role, many.many_role)).select(*ROW)
    free = free if written else cut(free)
    homes, width = _homes(free.where(F.col("role") == many.anchor_role).select("currency", "ts_ns"), rule.window_ns)
    at_home = free.withColumn("tick", floor_div(F.col("ts_ns"), width)).join(F.broadcast(homes), ["currency", "tick"]).withColumn("home", _home(rule.window_ns)).where("home is not null").select(*ROW, "home")
    sizes = cut(at_home.groupBy("currency", "home").agg(F.count_if(F.col("role") == many.many_role).alias("m"), F.count("*").alias("n")).where("m > 1").select("currency", "home", "n"))
    few, large = (F.broadcast(sizes.where(f"n {cmp} {cell_rows}").select("currency", "home")) for cmp in ("<=", ">"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(4 * int(free.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // cell_rows + 1)
    dealt = at_home.join(few, ["currency", "home"], "left_semi").withColumn("shard", F.pmod(F.xxhash64("currency", "home"), F.lit(shards)))
    out = cut(_solved(dealt, ["currency", "home"], rule).drop("anchor", "members"))
    if large.isEmpty():
        return out
    return out.unionByName(_rounds(at_home.join(large, ["currency", "home"], "left_semi").select(*ROW), rule, cell_rows))


def _rounds(free: DataFrame, rule: Rule, cell_rows: int) -> DataFrame:
    """What ``first_subsets`` gives for records (ROW), by islands and cells."""
    many = rule.one_to_many
    free = cut(free.withColumn("id", F.monotonically_increasing_id()))
    is_anchor: Column = F.col("role") == many.anchor_role
    marks = islands(free.where(is_anchor).select("currency", "ts_ns").distinct(), ["currency"], 2 * rule.window_ns)
    window = F.lit(rule.window_ns).cast("long")
    spans = marks.groupBy("currency", "island").agg((F.min("ts_ns") - window).alias("ts_ns"), (F.max("ts_ns") + window).alias("until"))
    placed = cut(last_mark(free, spans, ["currency"]).where("ts_ns <= mark.until").select("id", *ROW, F.col("mark.island").alias("island")))
    sizes = placed.groupBy("currency", "island").agg(F.count_if(F.col("role") == many.many_role).alias("m"), F.count("*").alias("n")).where("m > 1").select("currency", "island", "n")
    rows = cut(_cells(placed.join(sizes, ["currency", "island"]), rule.window_ns, cell_rows).withColumn("open", is_anchor))
    parts, number = [], 0
    while True:
        found = cut(_round(rows, rule, number, cell_rows))
        parts.append(found.where("kind <> 'wait'"))
        left = found.where("kind = 'wait'").select(F.col("anchor").alias("id"))
        if left.isEmpty():
            break
        gone = found.where("kind <> 'wait'").select(F.explode(F.concat("members", F.array("anchor"))).alias("id"))
        still = rows.drop("open").join(left.withColumn("open", F.lit(True)), "id", "left").withColumn("open", F.coalesce("open", F.lit(False)))
        busy = still.where("open").select("currency", "island").distinct()
        rows = cut(still.join(gone, "id", "left_anti").join(busy, ["currency", "island"], "left_semi").where(F.col("open") | (F.col("role") == many.many_role)))
        number += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.drop("anchor", "members")
