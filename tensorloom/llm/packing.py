"""Filling fixed-capacity containers: histogram packing by non-negative least squares.

Only the histogram of lengths (at most capacity / quantum classes, whatever the number of items) reaches
the driver. There a plan is made: combinations of up to three lengths that fill a window of a quarter
of the capacity are enumerated, their repeat counts solved against the histogram by non-negative least
squares and rounded down; four windows make a container. What is left, and items too long for a window,
is packed greedily, longest first, each container filled with the longest lengths that still fit. The
plan gives every class of lengths intervals of ranks; items take their container from their rank, which
is counted in hash buckets so that a class may hold any share of the items.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.runtime import materialize

#: Items of one class that are ranked in one hash bucket, and the buckets of all classes together.
RANK_ROWS, MOST_BUCKETS = 100_000, 100_000


def nnls(a: np.ndarray, b: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by active sets on the normal equations."""
    n = a.shape[1]
    x = np.zeros(n)
    passive = np.zeros(n, dtype=bool)
    target = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(max_rounds or 3 * a.shape[0]):
        gradient = target - a.T @ (a @ x)
        gradient[passive] = -np.inf
        best = int(np.argmax(gradient)) if n else 0
        if not n or gradient[best] <= tolerance:
            break
        passive[best] = True
        while True:
            chosen = np.flatnonzero(passive)
            sub = a[:, chosen]
            gram = sub.T @ sub
            gram[np.diag_indices_from(gram)] += 1e-10
            s = np.linalg.solve(gram, target[chosen])
            if (s > 0).all():
                x[:] = 0
                x[chosen] = s
                break
            old = x[chosen]
            falling = s <= 0
            step = np.min(old[falling] / np.maximum(old[falling] - s[falling], 1e-300))
            moved = old + step * (s - old)
            x[chosen] = np.where(moved > 1e-12, moved, 0)
            drop = chosen[(x[chosen] <= 0)]
            passive[drop] = False
            if not passive.any():
                break
    return x


def combinations(window: int, slack: int) -> list[tuple[int, ...]]:
    """Up to three class numbers whose sum lies in (window - slack, window]."""
    out: list[tuple[int, ...]] = []
    for total in range(window - slack + 1, window + 1):
        out.append((total,))
        out += [(i, total - i) for i in range(1, total // 2 + 1)]
        for i in range(1, total // 3 + 1):
            rest = total - i
            out += [(i, j, rest - j) for j in range(i, rest // 2 + 1)]
    return out


@dataclass
class Plan:
    """Intervals of ranks: class, first rank, repeats, first slot, slots per container, first container."""

    intervals: list[tuple[int, int, int, int, int, int]]
    containers: int


def plan_containers(histogram: dict[int, int], capacity: int, parts: int = 4, slack: int = 2, fit: bool = True) -> Plan:
    """Plan for ``histogram`` (class -> items), all in units of the quantum; ``capacity`` in the same unit.

    ``fit=False`` leaves the least squares out and packs all items greedily, for comparison.
    """
    left = {c: n for c, n in histogram.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    intervals: list[tuple[int, int, int, int, int, int]] = []

    def take(pattern: list[tuple[int, int]], repeats: int, slot: int, per: int, base: int) -> None:
        for c, uses in pattern:
            intervals.append((c, taken[c], repeats, slot, per, base))
            taken[c] += repeats * uses
            left[c] -= repeats * uses

    window = capacity // parts
    small = np.array([left.get(c, 0) for c in range(window + 1)], dtype=float)
    # long items need short ones beside them: these are kept out of the windows
    need = sum((capacity - c) * n for c, n in left.items() if c > window)
    have = float((small * np.arange(window + 1)).sum())
    share = max(0.0, 1 - 1.05 * need / have) if have else 0.0
    slots = 0
    if fit and share > 0:
        patterns = [p for p in combinations(window, slack) if all(small[c] > 0 for c in p)]
        if patterns:
            a = np.zeros((window + 1, len(patterns)))
            for k, p in enumerate(patterns):
                for c in p:
                    a[c, k] += 1
            x = nnls(a, small * share)
            for k in np.argsort(-x, kind="stable"):
                if x[k] < 1:
                    break
                uses: dict[int, int] = {}
                for c in patterns[k]:
                    uses[c] = uses.get(c, 0) + 1
                repeats = min(int(x[k]), *(left[c] // u for c, u in uses.items()))
                if repeats:
                    take(sorted(uses.items()), repeats, slots, parts, 0)
                    slots += repeats
    containers = -(-slots // parts)
    active = sorted(c for c, n in left.items() if n)
    while active:
        rest, fill = capacity, {}
        spare = {}
        while rest > 0:
            at = bisect_right(active, rest) - 1
            # the longest class that fits and is not used up by this container
            while at >= 0 and spare.get(active[at], left[active[at]]) <= 0:
                at -= 1
            if at < 0:
                break
            c = active[at]
            times = max(1, min(rest // c, spare.get(c, left[c])))
            fill[c] = fill.get(c, 0) + times
            spare[c] = spare.get(c, left[c]) - times
            rest -= c * times
        repeats = min(left[c] // u for c, u in fill.items())
        take(sorted(fill.items()), repeats, containers, 1, 0)
        containers += repeats
        active = [c for c in active if left[c]]
    return Plan(intervals, containers)


def pack(items: DataFrame, capacity: int = 4096, quantum: int | None = None) -> DataFrame:
    """Put ``items`` (``row_id, length`` and any other columns) into containers of ``capacity``.

    Adds ``piece, n_pieces, piece_length, container``. An item is whole in one container unless it is
    longer than the capacity: then it is cut into pieces of the capacity and a rest.

    Defined cases: a null length, or one below 1, gets no container (``container`` and ``piece_length``
    null, one piece); repeated and equal items are items like any other; empty input gives no rows.
    The names ``piece, n_pieces, piece_length, container`` of the input are replaced; names that begin with
    ``__pack_`` are reserved.
    """
    made = ["piece", "n_pieces", "piece_length", "container"]
    items = items.drop(*made)
    quantum = quantum or max(1, capacity // 1024)
    units = capacity // quantum
    n_pieces = F.when(F.col("length") > capacity, F.ceil(F.col("length") / F.lit(capacity)).cast("int")).otherwise(F.lit(1))
    pieces = items.withColumn("n_pieces", n_pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    size = F.when(F.col("piece") < F.col("n_pieces") - 1, F.lit(capacity)).otherwise(F.col("length") - F.lit(capacity) * (F.col("n_pieces") - 1)).cast("int")
    pieces = pieces.withColumn("piece_length", F.when(F.col("length") >= 1, size))
    # the last class also holds what the capacity has beyond whole quanta: such an item fills a container alone
    last = F.least(F.ceil(F.col("piece_length") / F.lit(quantum)), F.lit(units)).cast("int")
    pieces = pieces.withColumn("__pack_class", F.when(F.col("piece_length").isNotNull(), last))

    sized = pieces.where(F.col("__pack_class").isNotNull())
    # one row per class, whatever the input
    histogram = {r["__pack_class"]: r["count"] for r in sized.groupBy("__pack_class").count().collect()}
    plan = plan_containers(histogram, units)
    table = sorted((c, start, repeats, slot, per, base) for c, start, repeats, slot, per, base in plan.intervals)
    columns = np.array(table, dtype=np.int64).reshape(-1, 6)
    keys = columns[:, 0] << 40 | columns[:, 1]
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast((keys, columns))  # bounded by the classes

    # a class is ranked in hash buckets of RANK_ROWS items or so, each from where the one before ends; beyond
    # MOST_BUCKETS buckets they hold more
    per_bucket = max(RANK_ROWS, -(-sum(histogram.values()) // MOST_BUCKETS))
    buckets = F.array(*[F.lit(-(-histogram.get(c, 1) // per_bucket)) for c in range(units + 1)])
    sized = sized.withColumn("__pack_bucket", F.pmod(F.xxhash64("row_id", "piece"), F.element_at(buckets, F.col("__pack_class") + 1)).cast("int"))
    counted = sized.groupBy("__pack_class", "__pack_bucket").agg(F.count("*").alias("__pack_n"))
    before = Window.partitionBy("__pack_class").orderBy("__pack_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("__pack_class", "__pack_bucket", F.coalesce(F.sum("__pack_n").over(before), F.lit(0)).alias("__pack_before"))

    @F.pandas_udf("bigint")
    def place(c: pd.Series, before: pd.Series, row: pd.Series) -> pd.Series:
        keys, columns = shared.value
        c = c.to_numpy(dtype=np.int64)
        rank = before.to_numpy(dtype=np.int64) + row.to_numpy(dtype=np.int64) - 1
        at = columns[np.searchsorted(keys, c << 40 | rank, side="right") - 1]
        return pd.Series(at[:, 5] + (at[:, 3] + (rank - at[:, 1]) % at[:, 2]) // at[:, 4])

    inner = ["__pack_class", "__pack_bucket", "__pack_before", "__pack_row"]
    order = Window.partitionBy("__pack_class", "__pack_bucket").orderBy("row_id", "piece", "length")
    # at most MOST_BUCKETS rows and one per class
    ranked = sized.join(F.broadcast(offsets), ["__pack_class", "__pack_bucket"]).withColumn("__pack_row", F.row_number().over(order))
    placed = ranked.withColumn("container", place("__pack_class", "__pack_before", "__pack_row")).drop(*inner)
    unsized = pieces.where(F.col("__pack_class").isNull()).drop(*inner).withColumn("container", F.lit(None).cast("long"))
    return placed.unionByName(unsized)


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """Containers, their filling and the share of capacity left unused."""
    each = materialize(packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("piece_length").alias("used"), F.count("*").alias("n")), "containers")
    total = each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pieces"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"), F.coalesce(F.min("used"), F.lit(0)).alias("emptiest"),
    )
    least = F.ceil(F.col("used") / F.lit(capacity))
    unused = F.when(F.col("n_containers") > 0, F.round(1 - F.col("used") / (F.col("n_containers") * capacity), 6))
    return total.withColumns({"least_containers": least, "unused_share": unused})
