"""Filling containers of fixed capacity with items of varying length (problem 8).

Method: best-fit decreasing with a segment tree over remaining capacities.  Items of one size are alike, and so
are open containers of one remaining capacity, so the whole corpus is packed from its histogram of sizes: sizes
in decreasing order, for each the tightest remaining capacity that holds it (found in the tree in logarithmic
time), and as many items of that size as those containers take, in one step.  The outcome is that of placing
the items one by one, at a cost that doesn't depend on their number.  The plan, rows of (size, ranks, first
container, items a container), is then applied to the ranked items in parallel.

Items above the capacity are divided into full pieces and a rest; no other item is divided.
Defined results: items of size null, zero or less are left out; ties (items of one size) are ranked by hash
bucket, key and piece, so the result is the same in every run; no items give no containers.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesseral.session import materialise

CAPACITY = 2048
ROWS_A_BUCKET = 500_000  # a size's items are ranked in buckets of about that many rows


class TightestFit:
    """Segment tree over capacities 0..n: the smallest capacity of at least s with an open container."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def find(self, s: int) -> int | None:
        i = s + self.size
        if self.any[i]:
            return s
        while i > 1:  # up to the first right sibling that holds one, then down its left side
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i *= 2
                    if not self.any[i]:
                        i += 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, items, first container, items a container) of best-fit decreasing."""
    tree = TightestFit(capacity)
    open_: dict[int, deque[tuple[int, int]]] = {}
    containers, out = 0, []

    def put(r: int, first: int, n: int) -> None:
        if n and r > 0:
            if not open_.setdefault(r, deque()):
                tree.set(r, True)
            if open_[r] and sum(open_[r][-1]) == first:
                first, n = open_[r][-1][0], open_[r].pop()[1] + n
            open_[r].append((first, n))

    for s in sorted((s for s, n in histogram.items() if n > 0 and 0 < s <= capacity), reverse=True):
        rank, left = 0, histogram[s]
        while left:
            r = tree.find(s)
            if r is None:
                r, first, n = capacity, containers, -(-left // (capacity // s))
                containers += n
            else:
                first, n = open_[r].popleft()
                if not open_[r]:
                    tree.set(r, False)
            each = r // s  # a container takes items until the next one doesn't fit: it stays the tightest
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            out.append((s, rank, placed, first, each))
            whole, rest = divmod(placed, each)
            put(r - each * s, first, whole)
            if rest:
                put(r - rest * s, first + whole, 1)
            if n > used:  # still open as they were, and the first to be met again
                if not open_.setdefault(r, deque()):
                    tree.set(r, True)
                open_[r].appendleft((first + used, n - used))
            rank, left = rank + placed, left - placed
    return out


def pack(items: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container_id, key, piece, start_token, n_tokens) for items (key, size), each key once."""
    spark = items.sparkSession
    n = F.col(size).cast("long")
    rows = items.where(n > 0).select(key, n.alias("__n"), F.posexplode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(capacity).cast("long"))).alias("piece", "start_token"))
    rows = rows.select(key, "piece", "start_token", F.least(F.col("__n") - F.col("start_token"), F.lit(capacity).cast("long")).alias("n_tokens"))
    rows = materialise(rows, "items")
    total = rows.count()
    buckets = int(min(2048, max(8, total // ROWS_A_BUCKET)))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int"))
    # at most capacity x buckets rows, however many the items
    counts = rows.groupBy("n_tokens", "__b").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["n_tokens", "__b"])
    histogram = {int(s): int(c) for s, c in counts.groupby("n_tokens")["n"].sum().items()}
    steps = plan(histogram, capacity)
    before = (counts.groupby("n_tokens")["n"].cumsum() - counts["n"]).to_numpy(np.int64)
    offset = np.zeros((capacity + 1) * buckets, np.int64)
    offset[counts["n_tokens"].to_numpy(np.int64) * buckets + counts["__b"].to_numpy(np.int64)] = before
    table = np.array(steps or np.zeros((0, 5)), np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = spark.sparkContext.broadcast((offset, table[:, 0] << 44 | table[:, 1], table))
    ranked = rows.withColumn("__r", F.row_number().over(W.partitionBy("n_tokens", "__b").orderBy(key, "piece")).cast("long") - 1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset, keys, table = sent.value
        for b in batches:
            s = b["n_tokens"].to_numpy(np.int64)
            rank = offset[s * buckets + b["__b"].to_numpy(np.int64)] + b["__r"].to_numpy(np.int64)
            at = np.searchsorted(keys, s << 44 | rank, "right") - 1
            b["container_id"] = table[at, 3] + (rank - table[at, 1]) // table[at, 4]
            yield b[["container_id", key, "piece", "start_token", "n_tokens"]]

    return ranked.mapInPandas(assign, f"container_id long, `{key}` {rows.schema[key].dataType.simpleString()}, piece int, start_token long, n_tokens long")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, tokens, the least possible number of containers, the share of space filled."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    n = F.count(F.lit(1))
    used = F.coalesce(F.sum("used"), F.lit(0))
    return per.agg(F.coalesce(F.sum("items"), F.lit(0)).alias("items"), n.alias("containers"), used.alias("tokens"), F.ceil(used / capacity).alias("least"), F.round(used / F.when(n > 0, n * capacity), 6).alias("filled"), F.max("used").alias("fullest"))
