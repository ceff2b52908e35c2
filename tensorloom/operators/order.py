"""Operations that depend on a total order, without ever sorting everything in one task.

``global_index`` numbers rows by range partitioning: partitions count their rows, one offset per
partition is broadcast. Ordered folds (``greedy_batches``, ``linear_scan``) take two passes: blocks first
report how they turn a state that enters them into the one that leaves, then run with their true entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.runtime import materialize


#: Rows of one block of an ordered scan.
SCAN_ROWS = 20_000


def global_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """``df`` with the 0-based position of each row in the given order.

    The order should be total; among equal rows any may come first. The sorted table is written once,
    so positions stay the same when tasks are repeated. Empty input gives no rows.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.withColumn("_mid", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_mid", 33)
    counts = placed.groupBy(part.alias("_part")).count()
    # one row per partition
    offsets = counts.select("_part", (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("_before"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_before")


def index_within(df: DataFrame, group: str, *order: Column | str, name: str = "pos") -> DataFrame:
    """Position of each row within its group; a group of any size is spread over many tasks."""
    indexed = global_index(df, group, *order, name="_gidx")
    starts = indexed.groupBy(F.col(group).alias("_key")).agg(F.min("_gidx").alias("_start"))
    joined = indexed.join(starts, F.col(group).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_gidx") - F.col("_start")).drop("_gidx", "_start", "_key")


def chunked(df: DataFrame, group: str, position: str, size: int, overlap: int) -> DataFrame:
    """Cut long groups into chunks of ``size`` rows that carry the ``overlap`` rows before them (``_lead`` true).

    A window over at most ``overlap`` preceding rows gives the same within (group, ``_chunk``) as within
    the group, but no task gets a whole group.
    """
    chunk = F.floor(F.col(position) / F.lit(size))
    next_ones = F.floor((F.col(position) + F.lit(overlap)) / F.lit(size))
    copies = F.explode(F.sequence(chunk, next_ones)).alias("_chunk")
    return df.select("*", copies).withColumn("_lead", F.col("_chunk") > F.floor(F.col(position) / F.lit(size)))


def running_totals(df: DataFrame, group: str, order: list[str], values: dict[str, Column], chunk: int = 100_000) -> DataFrame:
    """Running sums within each group in order, and ``n_so_far``; long groups are summed in chunks.

    ``values``: name of the sum -> what is summed (null counts as 0).
    """
    placed = index_within(df, group, *order, name="_pos").withColumn("_chunk", F.floor(F.col("_pos") / chunk))
    placed = placed.withColumns({f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()})
    sums = placed.groupBy(F.col(group).alias("_g"), F.col("_chunk").alias("_c")).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_g", "_c", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    inside = Window.partitionBy(group, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_chunk") == F.col("_c")))
    return joined.select(*df.columns, (F.col("_pos") + 1).alias("n_so_far"), *[(F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in values])


def next_starts(sizes: np.ndarray, cap: int) -> np.ndarray:
    """For a batch that begins at each place, where the next one begins."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    found = np.searchsorted(total, total[:-1] + cap, side="right") - 1
    return np.maximum(found, np.arange(1, len(sizes) + 1))


def first_start(sizes: np.ndarray, cap: int, held: int) -> int:
    """Where the first batch begins in a block entered with an open batch of size ``held`` (-1: none)."""
    if held < 0 or held > cap:
        return 0
    return int(np.searchsorted(np.cumsum(sizes), cap - held, side="right"))


def greedy_batches(df: DataFrame, size: str, cap: int, *order: Column | str) -> DataFrame:
    """Sequential packing in order: a new batch begins where the open one is not empty and would exceed ``cap``.

    Adds ``idx`` (position) and ``batch`` (0-based). An item above the cap gets a batch of its own; null
    and negative sizes count as 0. Batches depend on all rows before them: each block of rows reports, for the places
    its first own batch can begin, how many batches follow and what the last one holds. Places with one outcome
    are one row, items without size are no such place, so there are ``cap`` of them at most. The driver links the
    reports, a few numbers per block.
    """
    sized = df.withColumn("_size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)))
    indexed = materialize(global_index(sized, *order), "indexed")
    total = indexed.count()
    if not total:
        return indexed.drop("_size").withColumn("batch", F.lit(0).cast("long"))
    block = max(1, min(200_000, -(-total // max(1, indexed.sparkSession.sparkContext.defaultParallelism))))
    blocks = indexed.withColumn("_block", F.floor(F.col("idx") / block))

    def report(group: pd.DataFrame) -> pd.DataFrame:
        sizes = group.sort_values("idx")["_size"].to_numpy()
        n = len(sizes)
        after = next_starts(sizes, cap).tolist()
        count, last = [0] * (n + 1), list(range(n + 1))
        for k in range(n - 1, -1, -1):
            count[k] = count[after[k]] + 1
            last[k] = last[after[k]] if after[k] < n else k
        total = np.concatenate([[0], np.cumsum(sizes)])
        number = int(group["_block"].iloc[0])
        # -1: no open batch, or one beyond the cap
        rows = [(number, -1, count[0], int(total[n] - total[last[0]]))]
        for k in np.flatnonzero((sizes > 0) & (total[:-1] <= cap)):
            outcome = (count[k], int(total[n] - total[last[k]]))
            if len(rows) == 1 or rows[-1][2:] != outcome:
                rows.append((number, int(total[k]), *outcome))
        # everything fits into the open batch: it stays open
        rows.append((number, int(total[n]), 0, int(total[n])))
        return pd.DataFrame(rows, columns=["block", "room", "n", "open"])

    reports: dict[int, list] = {}
    for r in blocks.select("_block", "idx", "_size").groupBy("_block").applyInPandas(report, "block long, room long, n long, open long").collect():
        reports.setdefault(r["block"], []).append(r)
    entry, base, held = {}, 0, -1
    for b in sorted(reports):
        entry[b] = (base, held)
        rows = reports[b]
        if held < 0 or held > cap:
            pick = rows[0]
        elif cap - held >= rows[-1]["room"]:
            pick = rows[-1]
        else:
            # the last place that begins within the room left
            pick = [r for r in rows[1:-1] if r["room"] <= cap - held][-1]
        base += pick["n"]
        held = pick["open"] if pick["n"] else held + pick["open"]

    def assign(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        sizes = group["_size"].to_numpy()
        first, held = entry[int(group["_block"].iloc[0])]
        after = next_starts(sizes, cap)
        begins = np.zeros(len(sizes), dtype=np.int64)
        k = first_start(sizes, cap, held)
        while k < len(sizes):
            begins[k] = 1
            k = int(after[k])
        group["batch"] = first - 1 + np.cumsum(begins)
        return group.drop(columns=["_block", "_size"])

    schema = indexed.drop("_size").withColumn("batch", F.lit(0).cast("long")).schema
    return blocks.groupBy("_block").applyInPandas(assign, schema)


def linear_scan(df: DataFrame, value: str | dict[str, str], keep: float, *order: Column | str, group: str, name: str = "ema") -> DataFrame:
    """Exponential moving average of each group in order: ``e = keep * e + (1 - keep) * value``, the first value as seed.

    ``value`` is a column, whose average is called ``name``, or several with the names of their averages.

    The recurrence is linear, so a block of rows is two numbers: what it adds and how much of the entry
    state it keeps. Blocks of a group of any size run in parallel; null values leave the state as it is.
    """
    values = {value: name} if isinstance(value, str) else dict(value)
    seen = global_index(df, group, *order, name="_gidx").withColumn("_block", F.floor(F.col("_gidx") / SCAN_ROWS))
    kind = df.schema[group].dataType.simpleString()

    def runs(part: pd.DataFrame):
        """Rows of each group in a block, in order."""
        part = part.sort_values("_gidx", kind="stable")
        codes = pd.factorize(part[group], use_na_sentinel=False)[0]
        ends = np.flatnonzero(np.diff(codes)) + 1
        return part, list(zip([0, *ends], [*ends, len(part)], strict=True)) if len(part) else []

    def fold(values: np.ndarray, e: float) -> np.ndarray:
        out = np.empty(len(values))
        for k, x in enumerate(values):
            if x == x:
                e = x if e != e else keep * e + (1 - keep) * x
            out[k] = e
        return out

    def summary(part: pd.DataFrame) -> pd.DataFrame:
        part, spans = runs(part)
        rows = []
        for number, value in enumerate(values):
            v = part[value].to_numpy(dtype=float)
            for k, (lo, hi) in enumerate(spans):
                # groups inside the block neither get a state nor hand one on
                if 0 < k < len(spans) - 1:
                    continue
                known = v[lo:hi][~np.isnan(v[lo:hi])]
                # from an entry state s: held * s + added, where the fold seeds itself by the first value
                held = keep ** len(known)
                first = float(known[0]) if len(known) else np.nan
                added = fold(known, np.nan)[-1] - held * first if len(known) else 0.0
                rows.append((part[group].iloc[lo], number, part["_block"].iloc[lo], first, held, added, len(known)))
        return pd.DataFrame(rows, columns=["_g", "_v", "_b", "first", "held", "added", "n"])

    sums = seen.select(group, "_gidx", "_block", *values).groupBy("_block").applyInPandas(summary, f"_g {kind}, _v int, _b long, first double, held double, added double, n long")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        # one row per block: a group of 10^9 rows has 5 * 10^4 of them
        state, out = np.nan, []
        rows = rows.sort_values("_b")
        for first, held, added, n in zip(rows["first"], rows["held"], rows["added"], rows["n"], strict=True):
            out.append(state)
            if n:
                state = added + held * (first if np.isnan(state) else state)
        return pd.DataFrame({"_v": rows["_v"], "_b": rows["_b"], "_entry": out})

    # only groups that lie in several blocks are linked; a block begins with one of them at most
    wide = sums.groupBy(F.col("_g").alias("_w")).agg(F.countDistinct("_b").alias("blocks")).where("blocks > 1").select("_w")
    entries = sums.join(wide, F.col("_g").eqNullSafe(F.col("_w")), "left_semi").groupBy("_g", "_v").applyInPandas(link, "_v int, _b long, _entry double")
    # the last group of a block has no entry there, so the greatest non-null entry is the first group's
    entry = entries.groupBy("_b").agg(*[F.max(F.when((F.col("_v") == k) & ~F.isnan("_entry"), F.col("_entry"))).alias(f"_entry{k}") for k in range(len(values))])

    def fill(part: pd.DataFrame) -> pd.DataFrame:
        part, spans = runs(part)
        for number, (value, name) in enumerate(values.items()):
            v = part[value].to_numpy(dtype=float)
            e = part[f"_entry{number}"].iloc[0]
            part[name] = np.concatenate([fold(v[lo:hi], float(e) if k == 0 and e is not None else np.nan) for k, (lo, hi) in enumerate(spans)])
        return part[names]

    schema = df.withColumns(dict.fromkeys(values.values(), F.lit(0.0))).schema
    names = [f.name for f in schema]
    joined = seen.join(entry, F.col("_block") == F.col("_b"), "left")
    return joined.groupBy("_block").applyInPandas(fill, schema)
