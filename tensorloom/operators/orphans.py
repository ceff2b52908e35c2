"""References to records that do not exist: fixpoint cascade over a foreign-key graph, and as-of references.

``orphan_cascade`` starts from the rows whose key has no record at all (direct orphans) and treats
children of orphaned records as orphaned too (inherited), by semi-joins down the foreign-key graph
until a round finds nothing new. Cycles and self-references end at the fixpoint.

``asof_state`` resolves a reference that holds at a point in time to the last event of its key, without
ever bringing all events of one key into one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.runtime import hot_keys, is_empty, materialize, skewless_join, union_all

KEY_PATTERN = r"(?<![0-9a-f])([0-9a-f]{20})(?![0-9a-f])"


def image_of(column: Column | str) -> Column:
    """The 20 hex digits that name an image, whatever path, ending, case or blanks surround them; else null."""
    text = F.regexp_extract(F.lower(F.col(column) if isinstance(column, str) else column), KEY_PATTERN, 1)
    return F.when(text != "", text)


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.parent_column``."""

    child: str
    column: str
    parent: str
    parent_column: str


def orphan_cascade(
    tables: Mapping[str, DataFrame], keys: Sequence[ForeignKey], ids: Mapping[str, str], max_rounds: int | None = None
) -> DataFrame:
    """All orphaned rows of a foreign-key graph.

    The cascade runs until a round finds nothing new. ``max_rounds`` is a guard for graphs that should be
    shallow: a deeper one is an error, never a partial result.

    Returns ``table_name, row_id, orphan ('direct' | 'inherited'), via, round`` with one row per
    orphaned record: ``via`` is the parent table of the (alphabetically first) broken reference and
    ``round`` the number of steps from the missing record.

    Defined cases: a null reference is no reference; a null id is reported if direct but cannot hand
    orphanhood on; several parent rows with one key keep it alive while one of them lives; repeated
    ids are one record per row; empty tables make every reference to them direct; other columns of the
    tables are ignored, whatever their names.
    """
    schema = "table_name string, row_id string, orphan string, via string, round int"
    spark = next(iter(tables.values())).sparkSession
    node: dict[str, DataFrame] = {}
    for name, df in tables.items():
        used = [k.column for k in keys if k.child == name] + [k.parent_column for k in keys if k.parent == name]
        # one narrow projection per table: id and the key columns as strings under names of our own
        node[name] = df.select(
            F.col(ids[name]).cast("string").alias("row_id"),
            *[F.col(c).cast("string").alias(f"k_{c}") for c in dict.fromkeys(used)],
        )

    def direct(k: ForeignKey) -> DataFrame:
        parent = node[k.parent].select(F.col(f"k_{k.parent_column}").alias("ref")).where(F.col("ref").isNotNull()).distinct()
        return skewless_join(refs[k], parent, "ref", "left_anti", hot=hot[k]).select(
            F.lit(k.child).alias("table_name"), "row_id", F.lit("direct").alias("orphan"), F.lit(k.parent).alias("via"), F.lit(0).alias("round")
        )

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("table_name", "row_id").agg(F.min("orphan").alias("orphan"), F.min("via").alias("via"), F.min("round").cast("int").alias("round"))

    if not keys:
        return spark.createDataFrame([], schema)
    # keys that hold many rows of a child are counted once, not in every round
    refs = {k: node[k.child].select("row_id", F.col(f"k_{k.column}").alias("ref")).where(F.col("ref").isNotNull()) for k in keys}
    hot = {k: hot_keys(refs[k], "ref") for k in keys}
    found = materialize(merged(union_all([direct(k) for k in keys])), "orphans")
    frontier, levels = found, [found]
    for step in itertools.count(1):
        fresh = []
        touched_tables = {r[0] for r in frontier.select("table_name").distinct().collect()}  # at most one row per table
        for k in keys:
            if k.parent not in touched_tables:
                continue
            key = f"k_{k.parent_column}"
            parent = node[k.parent].select("row_id", F.col(key).alias("ref")).where(F.col("ref").isNotNull() & F.col("row_id").isNotNull())
            mine = found.where(F.col("table_name") == k.parent).select("row_id")
            hit = parent.join(frontier.where(F.col("table_name") == k.parent).select("row_id"), "row_id", "left_semi")
            alive = node[k.parent].select("row_id", F.col(key).alias("ref")).where(F.col("ref").isNotNull())
            alive = alive.join(mine, "row_id", "left_anti").select("ref").distinct()
            dead = hit.select("ref").distinct().join(alive, "ref", "left_anti")
            known = found.where(F.col("table_name") == k.child).select("row_id")
            below = skewless_join(refs[k], dead, "ref", "left_semi", hot=hot[k]).join(known, "row_id", "left_anti")
            fresh.append(below.select(F.lit(k.child).alias("table_name"), "row_id", F.lit("inherited").alias("orphan"), F.lit(k.parent).alias("via"), F.lit(step).alias("round")))
        if not fresh:
            break
        frontier = materialize(merged(union_all(fresh)), "orphans")
        if is_empty(frontier):
            break
        if max_rounds is not None and step > max_rounds:
            raise RuntimeError(f"orphans below orphans after {max_rounds} rounds")
        levels.append(frontier)
        if len(levels) > 16:
            levels = [materialize(union_all(levels), "orphans")]
        found = union_all(levels)
    return union_all(levels)


def asof_state(refs: DataFrame, events: DataFrame, key: str = "image", at: str = "at", order: str = "event_order") -> DataFrame:
    """``refs`` with the last event of their key up to and including ``at``.

    ``refs``: key, at and any other columns; ``events``: key, at, ``event_order`` (int; later wins at
    equal times) and a string ``event``. Adds ``event`` and ``event_at`` (null when there is none yet).

    Both sides are cut into hours of each key. Within an hour a window finds the last event; across
    hours only one summary row per key and hour is ordered, so the longest ordered run of a key is
    bounded by the hours covered, not by its rows. Null keys or times get no event.
    """
    refs = refs.drop("event", "event_at")
    side_columns = [c for c in refs.columns if c not in (key, at)]
    unplaced = refs.where(F.col(key).isNull() | F.col(at).isNull()).withColumns({"event": F.lit(None).cast("string"), "event_at": F.lit(None).cast("timestamp_ntz")})
    refs = refs.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    hour = F.substring(F.col(at).cast("string"), 1, 13)
    r = refs.select(key, at, F.lit(1).alias("_side"), F.lit(0).alias("_order"), F.lit(None).cast("struct<event_at:timestamp_ntz,event:string>").alias("_event"), F.struct(*[F.col(c) for c in side_columns]).alias("_row") if side_columns else F.lit(None).alias("_row"))
    e = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        key, at, F.lit(0).alias("_side"), F.col(order).cast("int").alias("_order"),
        F.struct(F.col(at).cast("timestamp_ntz").alias("event_at"), F.col("event").cast("string").alias("event")).alias("_event"),
        F.lit(None).cast(r.schema["_row"].dataType).alias("_row"),
    )
    both = r.unionByName(e).withColumn("_hour", hour)
    within = Window.partitionBy(key, "_hour").orderBy(at, "_side", "_order", "_event").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_event", ignorenulls=True).over(within)).where(F.col("_side") == 1)
    # one summary row for each hour of a key that has events or references
    hours = both.groupBy(key, "_hour").agg(F.max(F.when(F.col("_event").isNotNull(), F.struct(F.col(at), F.col("_order"), F.col("_event")))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(key, "_hour", F.last("_end", ignorenulls=True).over(before)["_event"].alias("_carried")).where(F.col("_carried").isNotNull())
    joined = inside.join(carried, [key, "_hour"], "left")
    state = F.coalesce("_last", "_carried")
    placed = joined.select(key, at, *[F.col("_row")[c].alias(c) for c in side_columns], state["event"].alias("event"), state["event_at"].alias("event_at"))
    return placed.unionByName(unplaced)
