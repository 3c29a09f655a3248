"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows of equal text) sorted by size enter the bin with the tightest remaining capacity, which a balanced tree of
the remaining capacities finds. Groups of one size are interchangeable, so the driver packs sizes with their counts, all
groups of a size at once: as many as fit into the tightest bin, then into the next. Sizes above 2^DIGITS are rounded up
to DIGITS significant bits, so there are at most about 2^(DIGITS - 1) of them for each doubling of the size, and the
driver's state is bounded whatever the number of groups; below that the result is that of packing group by group. Groups
are then numbered within their size, in cells dealt by hash, and join the run of bins that their number falls into.

With a capacity the number of shards is as small as best-fit-decreasing makes it, and only a group above the capacity
makes a larger shard, of its own. With a number of shards the capacity is the smallest at which they suffice, groups
larger than a fair share get a shard each, and shards are levelled afterwards.

Defined results: a null text has size 1 and is a group apart from the empty text, which also has size 1; repeated rows
are one group; of groups of one size those of smaller cell and digest come first, of bins with equal room the one opened
last; a very long text is no special case; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm.common import Scratch

#: Significant bits of a size.
DIGITS = 17
#: Groups that hold more than this share of the rows or bytes are joined by broadcast: at most twice as many.
PARTS = 1 << 12
#: Runs of bins that are broadcast; more of them are joined by shuffle.
MOST_RUNS = 1 << 20
#: Rows of a shard, or groups of a size, that are numbered in one task, about.
ROWS_A_CELL = 50_000

Sizes = list[tuple[int, int]]


class Tree:
    """A balanced search tree of numbers: a treap whose priorities are hashes of the numbers."""

    def __init__(self):
        self.root: list | None = None  # number, priority, left, right

    @staticmethod
    def _split(t: list | None, x: int) -> tuple[list | None, list | None]:
        if t is None:
            return None, None
        if t[0] < x:
            t[3], high = Tree._split(t[3], x)
            return t, high
        low, t[2] = Tree._split(t[2], x)
        return low, t

    @staticmethod
    def _joined(a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = Tree._joined(a[3], b)
            return a
        b[2] = Tree._joined(a, b[2])
        return b

    def add(self, x: int) -> None:
        low, high = self._split(self.root, x)
        priority = (x + 1) * 0x9E3779B97F4A7C15 % (1 << 64) * 0xBF58476D1CE4E5B9 % (1 << 64)
        self.root = self._joined(self._joined(low, [x, priority, None, None]), high)

    def remove(self, x: int) -> None:
        low, rest = self._split(self.root, x)
        _, high = self._split(rest, x + 1)
        self.root = self._joined(low, high)

    def least_from(self, x: int) -> int | None:
        t, best = self.root, None
        while t is not None:
            if t[0] >= x:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


class Rooms:
    """Runs of bins (first, number) by what room they have left."""

    def __init__(self):
        self.tree, self.runs = Tree(), {}

    def put(self, room: int, first: int, n: int) -> None:
        if room not in self.runs:
            self.runs[room] = []
            self.tree.add(room)
        self.runs[room].append((first, n))

    def take(self, size: int) -> tuple[int, int, int] | None:
        """Room, first and number of the tightest bins that hold size."""
        room = self.tree.least_from(size)
        if room is None:
            return None
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.tree.remove(room)
        return room, first, n


def best_fit_decreasing(sizes: Sizes, capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Packs (size, number of groups), sizes descending. Returns runs (place in sizes, from number, to number, first bin,
    groups for each bin) and the number of bins. A group above the capacity gets a bin of its own."""
    rooms, n_bins, out = Rooms(), 0, []
    for i, (s, count) in enumerate(sizes):
        at = 0
        while at < count:
            room, first, n = rooms.take(s) or (max(capacity, s), n_bins, 0)
            each = room // s
            if not n:
                n = -(-(count - at) // each)
                n_bins += n
            full = min(n, (count - at) // each)
            if full:
                out.append((i, at, at + full * each, first, each))
                at += full * each
                if room - each * s:
                    rooms.put(room - each * s, first, full)
            rest = count - at if full < n else 0
            if rest:
                out.append((i, at, count, first + full, rest))
                at = count
                rooms.put(room - rest * s, first + full, 1)
            if full + bool(rest) < n:
                rooms.put(room, first + full + bool(rest), n - full - bool(rest))
    return out, n_bins


def fill(sizes: Sizes, bins: int) -> list[dict[int, int]]:
    """For each of so many bins the number of groups by place in sizes: that of best-fit-decreasing at the smallest
    capacity, found by bisection, at which it needs no more bins; groups above a fair share alone, the rest levelled."""
    alone, left, total = [], [n for _, n in sizes], sum(s * n for s, n in sizes)
    for i, (s, n) in enumerate(sizes):
        while left[i] and len(alone) < bins - 1 and s * (bins - len(alone)) > total:
            alone.append({i: 1})
            left[i] -= 1
            total -= s
        if left[i]:
            break
    at = [i for i, n in enumerate(left) if n]
    rest, bins = [(sizes[i][0], left[i]) for i in at], bins - len(alone)
    if not rest:
        return alone
    low = max(-(-total // bins), rest[0][0])
    high, step = low, max(1, low // 100_000)
    while (best := best_fit_decreasing(rest, high))[1] > bins:
        low, high = high + 1, high + step
        step *= 2
    while high - low > low // 100_000:
        mid = (low + high) // 2
        found = best_fit_decreasing(rest, mid)
        if found[1] <= bins:
            best, high = found, mid
        else:
            low = mid + 1
    held = [defaultdict(int) for _ in range(bins)]
    for i, lo, hi, first, each in best[0]:
        for b in range((hi - lo) // each):
            held[first + b][at[i]] += each
    level(sizes, held)
    return [dict(h) for h in held] + alone


def level(sizes: Sizes, held: list[dict[int, int]]) -> None:
    """Moves groups out of full bins into the emptiest while that narrows the gap between them."""
    loads = [sum(sizes[i][0] * n for i, n in h.items()) for h in held]
    order = [sorted(h, reverse=True) for h in held]  # by size ascending
    size_of_place = lambda i: sizes[i][0]
    while True:
        lo = min(range(len(held)), key=loads.__getitem__)
        for hi in sorted(range(len(held)), key=lambda b: -loads[b]):
            gap = loads[hi] - loads[lo]
            k = bisect_left(order[hi], gap, key=size_of_place) - 1
            if k >= 0:
                break
        else:
            return
        i = order[hi][k]
        s = sizes[i][0]
        n = max(1, min(held[hi][i], gap // 2 // s))
        held[hi][i] -= n
        if not held[hi][i]:
            del held[hi][i]
            order[hi].pop(k)
        if i not in held[lo]:
            held[lo][i] = 0
            insort(order[lo], i, key=size_of_place)
        held[lo][i] += n
        loads[hi] -= n * s
        loads[lo] += n * s


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def rounded(size: Column) -> Column:
    """size, up to DIGITS significant bits."""
    unit = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(size - 1)) - DIGITS)).cast("long")
    over = size + unit - 1
    return over - F.pmod(over, unit)


def numbered(rows: DataFrame, by: str, order: list[str], n_rows: int, name: str) -> DataFrame:
    """Adds the gapless place of every row among those with the same value of by. Rows are numbered in cells dealt by a
    hash of order, so that no value is a burden to one task."""
    cell = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-n_rows // ROWS_A_CELL)))).cast("int")
    dealt = rows.withColumn("cell", cell)
    counts = dealt.groupBy(by, "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy(by, "cell").orderBy(*order)
    at = dealt.withColumn("at", F.row_number().over(within) - 1)
    return at.join(starts, [by, "cell"]).withColumn(name, (F.col("start") + F.col("at")).cast("long")).drop("cell", "at", "start")


def shard(docs: DataFrame, bins: int | None = 16, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, crc32 of the text, shard and its gapless place there. Either bins or capacity is given; the
    other one is None or, for bins, ignored."""
    spark: SparkSession = docs.sparkSession
    scratch, text = Scratch(spark), F.col(text_col)
    rows = scratch.save(
        docs.select(
            F.col(id_col).alias("id"),
            size_of(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"null")).alias("group"),
        )
    )
    groups = scratch.save(rows.groupBy("group").agg(F.sum("size").alias("group_size"), F.count("*").alias("n_rows")).withColumn("class", rounded(F.col("group_size"))))
    n_rows, total, n_groups = groups.agg(F.sum("n_rows"), F.sum("group_size"), F.count("*")).first()
    found = groups.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.desc("class")).toArrow()
    sizes: Sizes = list(zip(found["class"].to_pylist(), found["n"].to_pylist(), strict=True))
    if capacity is not None:
        runs = [(sizes[i][0], lo, hi, first, each) for i, lo, hi, first, each in best_fit_decreasing(sizes, capacity)[0]]
    else:
        runs, used = [], [0] * len(sizes)
        for b, held in enumerate(fill(sizes, bins)):
            for i, n in held.items():
                runs.append((sizes[i][0], used[i], used[i] + n, b, n))
                used[i] += n
    names = ["class", "low", "high", "first", "each"]
    columns = np.array(runs, np.int64).reshape(-1, 5).T
    runs = spark.createDataFrame(pa.table({c: pa.array(x) for c, x in zip(names, columns, strict=True)}))
    small = F.broadcast if columns.shape[1] <= MOST_RUNS else lambda x: x
    ranked = numbered(groups, "class", ["group"], n_groups or 0, "rank")
    of_group = ranked.join(small(runs), "class").filter("rank >= low and rank < high").select("group", "group_size", "n_rows", F.expr("cast(first + (rank - low) div each as int)").alias("shard"))
    of_group = scratch.save(of_group)
    hot = (F.col("n_rows") * PARTS >= (n_rows or 0)) | (F.col("group_size") * PARTS >= (total or 0))
    hot_groups = of_group.filter(hot).select("group", "shard")  # at most 2 * PARTS
    placed = rows.join(F.broadcast(hot_groups), "group").unionByName(rows.join(F.broadcast(hot_groups), "group", "left_anti").join(of_group.filter(~hot).select("group", "shard"), "group"))
    out = numbered(placed.drop("group"), "shard", ["id", "text_crc32", "size"], n_rows or 0, "slot")
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
