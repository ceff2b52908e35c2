"""Joins, gates, selection, splitting and set operations of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tensorloom.operators.order import global_index
from tensorloom.runtime import checked_join, is_empty, with_scalars


class GateError(RuntimeError):
    """A fail-closed check found rows that must not exist."""


def gate(bad: DataFrame, what: str) -> None:
    """Raise if ``bad`` has any row (an action that reads one row at most)."""
    rows = bad.take(1)
    if rows:
        raise GateError(f"{what}: {rows[0].asDict()}")


def positional_join(wanted: DataFrame, source: DataFrame, order: list[str], index: str = "idx", strict: bool = True) -> DataFrame:
    """Rows of ``wanted`` (0-based ``index``) with the row of ``source`` at that position in the given order.

    Only the order columns, which must identify a row, are sorted and numbered; the payload is fetched for the
    wanted rows by a join. Strict mode fails closed: an index outside the source, a null one, or wanted rows that
    the order does not tell apart are an error.
    """
    positions = global_index(source.select(*order), *order, name=index)
    hits = wanted.join(positions, index)
    if strict:
        gate(wanted.select(index).join(positions.select(index), index, "left_anti"), "index without row")
    found = hits.join(source, order)
    if strict:
        gate(found.groupBy(index).agg(F.count("*").alias("_n")).join(hits.groupBy(index).agg(F.count("*").alias("_w")), index).where("_n > _w"), "order does not tell rows apart")
    return found.select(*wanted.columns, *[c for c in source.columns if c not in wanted.columns])


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str) -> DataFrame:
    """Each point with the half-open interval [low, high) that holds it, the intervals being disjoint.

    An equi-join: an interval between 2^(l-1) and 2^l long lies in at most two slices of width 2^l, and at most three
    disjoint ones share a slice. A point looks into one slice of every width there is (64 at most). Empty intervals
    and null bounds or points match nothing.
    """
    sized = intervals.where(F.col(high) > F.col(low)).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)).cast("double")))).cast("int"))
    levels = sorted(r[0] for r in sized.select("_level").distinct().collect())  # one row per power of two
    if not levels:
        return points.join(intervals.limit(0), F.lit(False))
    slice_of = lambda c, level: F.floor(F.col(c) / F.pow(F.lit(2.0), level)).cast("long")
    placed = sized.withColumn("_slice", F.explode(F.array_distinct(F.array(slice_of(low, F.col("_level")), slice_of(high, F.col("_level"))))))
    seen = points.withColumn("_level", F.explode(F.array(*[F.lit(level) for level in levels]))).withColumn("_slice", slice_of(point, F.col("_level")))
    joined = checked_join(seen, placed, ["_level", "_slice"], "inner")
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_level", "_slice")


def shards_covering(counts: DataFrame, shard: str, count: str, highest: int) -> DataFrame:
    """Number of leading shards needed to reach row ``highest``: the first whose running total exceeds it, else all."""
    total = F.sum(count).over(Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, 0))  # one row per shard
    running = counts.select(F.row_number().over(Window.orderBy(shard)).alias("n"), total.alias("total"))
    return running.agg(F.coalesce(F.min(F.when(F.col("total") > highest, F.col("n"))), F.coalesce(F.max("n"), F.lit(0))).cast("long").alias("n_shards"))


def fallback_lookup(names: DataFrame, members: DataFrame, name: str = "name", member: str = "member") -> DataFrame:
    """Each name with its archive member: the exact one, else the smallest with the same base name; null when neither exists."""
    base = lambda c: F.element_at(F.split(F.col(c), "/"), -1)
    exact = members.select(F.col(member).alias("_exact")).distinct()
    by_base = members.groupBy(base(member).alias("_base")).agg(F.min(member).alias("_first"))
    found = names.join(exact, F.col(name) == F.col("_exact"), "left").withColumn("_b", base(name)).join(by_base, F.col("_b") == F.col("_base"), "left")
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_first").isNotNull(), "base name").otherwise("none")
    return found.select(*names.columns, F.coalesce("_exact", "_first").alias("member"), how.alias("match"))


def strict_lookup(names: DataFrame, members: DataFrame, name: str = "name", member: str = "member") -> DataFrame:
    """``fallback_lookup`` that fails closed: a name without member is an error."""
    found = fallback_lookup(names, members, name, member)
    gate(found.where("match = 'none'").select(name), "name without member")
    return found


def catalogue(files: DataFrame, subset: str, path: str = "path", ending: str = ".parquet") -> DataFrame:
    """Files of a subset (``<folder>/<subset>-...``); where there is none, all that name it anywhere."""
    ended = files.where(F.col(path).endswith(ending))
    strict = ended.where(F.col(path).rlike(rf"(^|/){subset}-"))
    return strict if not is_empty(strict) else ended.where(F.col(path).contains(subset))


def listed_shards(listing: DataFrame, path: str = "path", prefix: str = "", ending: str = ".parquet") -> DataFrame:
    """Distinct base names of a listing that begin with ``prefix`` and end with ``ending``: ``shard``."""
    base = F.element_at(F.split(F.col(path), "/"), -1)
    return listing.select(base.alias("shard")).where(F.col("shard").startswith(prefix) & F.col("shard").endswith(ending)).distinct()


def total_within(rows: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """``n_rows, total`` of a column; an error where the total is not between the bounds, both excluded."""
    total = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    gate(total.where((F.col("total") <= low) | (F.col("total") >= high)), f"total not between {low} and {high}")
    return total


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume: what is not done yet. A null key is never done."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def resume_action(shards: DataFrame, on_volume: DataFrame, on_hub: DataFrame, key: str, hub_only: bool = False) -> DataFrame:
    """What to do with each shard: skip, push_from_vol or pack."""
    v = on_volume.select(key).distinct().withColumn("_v", F.lit(True))
    h = on_hub.select(key).distinct().withColumn("_h", F.lit(True))
    both = shards.join(v, key, "left").join(h, key, "left")
    vol, hub = F.coalesce("_v", F.lit(False)), F.coalesce("_h", F.lit(False))
    action = F.when(vol & hub, "skip").when(vol, "push_from_vol").when(hub & F.lit(hub_only), "skip").otherwise("pack")
    return both.withColumn("action", action).drop("_v", "_h")


def merged_cache(rows: DataFrame, cache: DataFrame, key: str, computed: Column, value: str = "value") -> DataFrame:
    """Union of a key/value cache and values computed for the keys it lacks; cached entries of other keys stay."""
    fresh = rows.select(key, computed.alias(value)).distinct().join(cache.select(key), key, "left_anti")
    return cache.select(key, value).unionByName(fresh)


def size_mismatches(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Files whose length differs from the expected one, or that are absent (actual null)."""
    both = expected.select(key, F.col("size").alias("expected")).join(actual.select(key, F.col("size").alias("actual")), key, "left")
    return both.where(F.col("actual").isNull() | (F.col("actual") != F.col("expected")))


def joined_or_fail(rows: DataFrame, tensors: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Manifest rows with their tensor; strict mode fails when a tensor is missing."""
    if strict:
        gate(rows.select(key).join(tensors.select(key), key, "left_anti"), "row without tensor")
    return rows.join(tensors, key)


def complete_chunks(expected: DataFrame, present: DataFrame, chunk: str, key: str) -> DataFrame:
    """Per chunk: names expected and present, and whether all are there."""
    have = present.select(key).distinct().withColumn("_p", F.lit(1))
    return expected.join(have, key, "left").groupBy(chunk).agg(F.count("*").alias("n_expected"), F.count("_p").alias("n_present"), F.bool_and(F.col("_p").isNotNull()).alias("complete"))


def last_per_key(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Last value of each key by ``order`` (combined map-side); ties by the greater value."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, value)).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value))


def first_per_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Smallest value of each key."""
    return df.groupBy(*keys).agg(F.min(value).alias(value))


def coverage(rows: DataFrame, sizes: DataFrame, key: str, index: str, size: str) -> DataFrame:
    """Count, least and greatest index per key and verdict: OK while the greatest is below the size, SKIP when there is none."""
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(index).alias("lo"), F.max(index).alias("hi"))
    verdict = F.when(F.col("n").isNull(), "SKIP").when(F.col("hi") < F.col(size), "OK").otherwise("OUT OF RANGE")
    return sizes.join(seen, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi", size, verdict.alias("verdict"))


def hash_order(seed: int, *keys: str) -> Column:
    """Order of a reproducible shuffle: SHA-1 of seed and keys."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def capped(df: DataFrame, group: str, order: list, cap: Column | int, most: int | None = None) -> DataFrame:
    """First ``cap`` rows of each group in order.

    ``most`` bounds a cap that is an expression: with a constant bound every task keeps only its own
    first rows of a group before the shuffle, so a hot group sends ``most`` rows per task.
    """
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    bound = cap if isinstance(cap, int) else most
    kept = df.withColumn("_n", n)
    kept = kept.where(F.col("_n") <= bound) if bound is not None else kept
    return (kept if isinstance(cap, int) else kept.where(F.col("_n") <= cap)).drop("_n")


def sampled(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Sample without replacement of at most ``n`` rows of each group, the same for the same rows."""
    return capped(df, group, [hash_order(seed, key), key], n)


def split_head(df: DataFrame, key: str, seed: int = 0, share: float = 0.02, least: int = 256, by: str | None = None) -> DataFrame:
    """Adds ``split``: the first ``max(least, int(share * n))`` rows of the shuffled order are ``val``.

    With ``by`` all rows of one value go to the same side: the values are split instead of the rows.
    """
    if by is None:
        shuffled = global_index(df, hash_order(seed, key), key, name="_i")
        n = shuffled.agg(F.greatest(F.lit(least), F.floor(F.count("*") * share)).alias("_n_val"))  # one row
        return with_scalars(shuffled, n).withColumn("split", F.when(F.col("_i") < F.col("_n_val"), "val").otherwise("train")).drop("_i", "_n_val")
    sides = split_head(df.select(by).distinct(), by, seed, share, least)
    return checked_join(df, sides, by, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def even_stride(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Rows at positions ``int(i * len / n)``; all when there are not more than ``n``."""
    indexed = global_index(df, *order, name="_i")
    total = indexed.agg(F.count("*").alias("_len"))
    if is_empty(df):
        return indexed.drop("_i")
    picks = with_scalars(df.sparkSession.range(n), total).select(F.when(F.col("_len") <= n, F.col("id")).otherwise(F.floor(F.col("id") * F.col("_len") / n)).alias("_i"))
    return indexed.join(picks.distinct(), "_i").drop("_i")


def proportional(counts: DataFrame, key: str, count: str, n: int) -> DataFrame:
    """``round(n * count / total)`` for each key but the last, which gets the rest (half to even)."""
    total = counts.agg(F.sum(count).alias("_t"), F.max(key).alias("_last"))
    share = with_scalars(counts, total).withColumn("_a", F.bround(F.lit(n) * F.col(count) / F.col("_t")).cast("long"))
    others = share.where(F.col(key) != F.col("_last")).agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("_o"))
    return with_scalars(share, others).select(key, count, F.when(F.col(key) == F.col("_last"), F.lit(n) - F.col("_o")).otherwise(F.col("_a")).alias("n_take"))


def batched(df: DataFrame, order: list, size: int, drop_last: bool) -> DataFrame:
    """Fixed batches in order (``idx, batch``); a short last batch is dropped or kept."""
    indexed = global_index(df, *order).withColumn("batch", F.floor(F.col("idx") / size))
    if not drop_last:
        return indexed
    full = df.count() // size
    return indexed.where(F.col("batch") < full)


def sharded(df: DataFrame, order: list, rows: int) -> DataFrame:
    """Fixed-size shards of the rows in order (``idx, shard``)."""
    return global_index(df, *order).withColumn("shard", F.floor(F.col("idx") / rows))
