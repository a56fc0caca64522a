"""Filling containers of fixed capacity by best fit, largest items first, at any number of items.

Best-fit decreasing looks at sizes only, and sizes are whole numbers up to the
capacity. So the driver packs the *histogram* of sizes, which has at most
``capacity`` entries however many items there are, and treats containers that look
alike as runs of consecutive ids. What it decides is a list of segments: the items
of one size with ranks from ``a`` on go, ``k`` each, into the containers from ``b``
on. The cluster then ranks the items of each size and looks its container up.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.session import materialise

#: The items of one size are ranked in parts of about so many, so that a size that a
#: third of all items share is ranked by many tasks; at least so many parts.
EACH, LEAST_PARTS = 500_000, 256


class OpenBins:
    """A segment tree over remaining capacities that holds where there are open containers."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def _mark(self, room: int, there: bool) -> None:
        node = room + self.leaves
        self.any[node] = there
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """Containers ``first`` to ``first + count - 1`` have ``room`` left."""
        if room and count:
            if not self.runs[room]:
                self._mark(room, True)
            self.runs[room].append((first, count))

    def take(self, room: int) -> tuple[int, int]:
        """A run of containers with exactly ``room`` left."""
        run = self.runs[room].popleft()
        if not self.runs[room]:
            self._mark(room, False)
        return run

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size``, in logarithmic time."""
        node = size + self.leaves
        if self.any[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_decreasing(sizes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Segments ``(size, first rank, first container, items a container)`` for a histogram of sizes.

    Equal, item by item, to best-fit decreasing: a container that takes an item of
    some size and has room for another is the tightest one for the next, too.
    """
    bins, opened, segments = OpenBins(capacity), 0, []
    for size in sorted(sizes, reverse=True):
        left, rank = sizes[size], 0
        while left:
            room = bins.tightest(size)
            if room is None:
                room = capacity
                first, count = opened, -(-left // (capacity // size))
                opened += count
            else:
                first, count = bins.take(room)
            each = room // size
            full = min(count, left // each)
            if full:
                segments.append((size, rank, first, each))
                bins.add(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:
                segments.append((size, rank, first + full, left))
                bins.add(room - left * size, first + full, 1)
                left, full = 0, full + 1
            bins.add(room, first + full, count - full)
    return segments


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """``key, piece, size, container`` of every item: pieces of one item only where it exceeds the capacity.

    An item larger than the capacity is cut into full containers and a rest that is
    packed like any item. Items of null or no size are in no container. Every row is
    an item of its own, so repeated rows are packed as often as they come; columns
    other than ``key`` and ``size`` don't matter. An empty table gives no rows.
    The driver gets at most ``capacity`` rows.
    """
    cap = F.lit(capacity).cast("long")
    whole = items.select(F.col(key).alias("_key"), F.col(size).cast("long").alias("_all")).where(F.col("_all") > 0)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_all") - 1) / cap))).alias("piece")
    cut = whole.select("_key", "_all", piece).select("_key", "piece", F.least(cap, F.col("_all") - F.col("piece") * cap).alias("_size"))
    pieces = materialise(cut, "pieces")
    parts = max(LEAST_PARTS, pieces.count() // EACH)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_key", "piece"), F.lit(parts)).cast("int"))
    spark = items.sparkSession

    counts = pieces.groupBy("_size", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_size", "_salt", F.coalesce(before, F.lit(0)).alias("_offset"))
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("count").alias("n")).collect()}
    segments = np.array(best_fit_decreasing(histogram, capacity) or [(0, 0, 0, 1)], np.int64)
    keys = segments[:, 0] * (1 << 48) + segments[:, 1]
    order = np.argsort(keys, kind="stable")
    plan = spark.sparkContext.broadcast((keys[order], segments[order]))

    @F.pandas_udf("long")
    def container(sizes: pd.Series, ranks: pd.Series) -> pd.Series:
        known, rows = plan.value
        at = np.searchsorted(known, sizes.to_numpy(np.int64) * (1 << 48) + ranks.to_numpy(np.int64), "right") - 1
        return pd.Series(rows[at, 2] + (ranks.to_numpy(np.int64) - rows[at, 1]) // rows[at, 3])

    nth = F.row_number().over(Window.partitionBy("_size", "_salt").orderBy("_key", "piece")) - 1
    ranked = pieces.withColumn("_nth", nth).join(offsets, ["_size", "_salt"])
    rank = (F.col("_nth") + F.col("_offset")).cast("long")
    return ranked.select(F.col("_key").alias(key), "piece", F.col("_size").alias("size"), container("_size", rank).alias("container"))
