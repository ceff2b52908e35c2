"""Far too many small files: size-tiered incremental compaction with an idempotent transaction journal.

Merges are planned in metadata, level by level: files of one size tier are combined until they reach
the next tier, then that tier is treated, up to the target size. Only the final composition is written,
so every byte moves once per run however many levels it climbed, and files already large enough are
not rewritten by later runs unless one of their records was superseded.

Layout below ``out``::

    data/run=<run>/output=<n>/part-*.parquet   consolidated files, one per output
    journal/run=<run>/                         the transaction; its _SUCCESS file is the commit

``run`` is a digest of the input units, so repeating an interrupted run writes to the same place and a
committed run is not repeated. Readers (``read_compacted``) only see committed outputs that no later
run retired.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.runtime import BROADCAST_ROWS, checked_join, delete_path, materialize, path_exists, union_all

#: Rows of one planning window; more units than this are planned in several hash buckets.
PLAN_ROWS = 100_000

JOURNAL = "action string, level int, unit string, output string, rows bigint, bytes bigint"


def plan_tiers(units: DataFrame, target_bytes: int, base_bytes: int = 4096, fanout: int = 8) -> tuple[DataFrame, DataFrame]:
    """Assign every unit (``unit string, bytes bigint, rows bigint``) to a merged output.

    Returns ``(unit, output)`` and the merges ``(level, unit, output)`` that led there. A merged output
    stays below twice the target; units of the target size or more stay as they are. The
    last merge takes what the tiers left over, so at most one output per planning bucket stays small.
    """
    levels = max(1, math.ceil(math.log(max(2, target_bytes / base_bytes), fanout)))
    current = units.select(F.col("unit").alias("leaf"), "unit", F.greatest(F.col("bytes"), F.lit(1)).alias("bytes"))
    merges: list[DataFrame] = []
    for level in range(levels + 1):
        last = level == levels
        floor, ceiling = (0, target_bytes) if last else (0 if level == 0 else base_bytes * fanout**level, min(target_bytes, base_bytes * fanout ** (level + 1)))
        if floor >= target_bytes:
            continue
        tops = current.groupBy("unit").agg(F.sum("bytes").alias("bytes"))
        tier = tops.where((F.col("bytes") >= floor) & (F.col("bytes") < ceiling))
        size = tier.count()
        if size < 2:
            continue
        buckets = 1 if last and size <= 2 * PLAN_ROWS else max(1, math.ceil(size / PLAN_ROWS))
        order = Window.partitionBy("_bucket").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
        placed = tier.withColumn("_bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets))).withColumn("_before", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
        placed = placed.withColumn("_slot", F.floor(F.col("_before") / F.lit(ceiling)))
        group = Window.partitionBy("_bucket", "_slot")
        placed = placed.withColumn("_n", F.count("*").over(group)).withColumn("_first", F.min("unit").over(group)).where(F.col("_n") > 1)
        moved = placed.select("unit", F.sha1(F.concat_ws("|", F.lit(level), "_bucket", "_slot", "_first")).alias("merged"))
        moved = materialize(moved, f"tier{level}")
        merges.append(moved.select(F.lit(level).alias("level"), "unit", F.col("merged").alias("output")))
        joined = checked_join(current, moved, "unit", "left")
        current = materialize(joined.select("leaf", F.coalesce("merged", "unit").alias("unit"), "bytes"), f"plan{level}")
    none = current.sparkSession.createDataFrame([], "level int, unit string, output string")
    return current.select(F.col("leaf").alias("unit"), F.col("unit").alias("output")), union_all([none, *merges])


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Journal rows of all committed runs."""
    if not path_exists(spark, f"{out}/journal"):
        return spark.createDataFrame([], JOURNAL + ", run string")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{out}/journal")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    runs = sorted(str(s.getPath().toString()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if not runs:
        return spark.createDataFrame([], JOURNAL + ", run string")
    # one scan, however many runs there were
    return spark.read.schema(JOURNAL).parquet(*runs).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1))


def live_outputs(spark: SparkSession, out: str) -> DataFrame:
    """``run, output, rows, bytes`` of the outputs that are current."""
    journal = committed(spark, out)
    made = journal.where(F.col("action") == "output").select("run", "output", "rows", "bytes")
    retired = journal.where(F.col("action") == "retire").select(F.col("unit").alias("output"))
    return made.join(retired, "output", "left_anti")


def read_compacted(spark: SparkSession, out: str) -> DataFrame | None:
    """Records of all live outputs with their ``output``; None when nothing was committed yet."""
    live = live_outputs(spark, out)
    runs = [r[0] for r in live.select("run").distinct().collect()]  # one row per compaction run
    if not runs:
        return None
    paths = [f"{out}/data/run={r}" for r in runs]
    records = spark.read.option("basePath", f"{out}/data").parquet(*paths).withColumn("output", F.col("output").cast("string")).drop("run")
    return checked_join(records, live.select("output"), "output", "left_semi")


def compact(
    records: DataFrame,
    out: str,
    *,
    file_column: str,
    record_id: str,
    key: Column,
    whole: Column,
    order: list[Column],
    payload: list[str],
    weight: Column,
    target_bytes: int = 128 << 20,
    base_bytes: int = 4096,
    fanout: int = 8,
) -> dict:
    """Consolidate the records of many small files below ``out``; returns what the run did.

    ``records`` has one row per record with the name of its file. ``whole`` says whether a record may
    be kept, ``key`` names what must be there exactly once (null: every record stands for itself),
    ``order`` ranks the records of a key (greatest stays), ``payload`` are the columns to write,
    ``weight`` is a record's size in bytes.

    Files that an earlier committed run consumed are skipped, so the call may be repeated at any time.
    An empty input, or one without new files, changes nothing. Records that are not whole, superseded
    ones and null keys are handled as stated; file names may be null (they form one file of their own).
    """
    taken = {"unit", "output", "no", "run", "_rid", "_old"} & set(payload)
    if taken:
        raise ValueError(f"payload columns must not be named {sorted(taken)}")
    spark = records.sparkSession
    journal = committed(spark, out)
    consumed = journal.where(F.col("action") == "input").select(F.col("unit")).distinct()
    unit = F.concat(F.lit("file:"), F.coalesce(F.col(file_column).cast("string"), F.lit("")))
    fresh_meta = records.select(
        unit.alias("unit"), F.col(record_id).alias("_rid"), key.alias("_key"), F.coalesce(whole, F.lit(False)).alias("_whole"),
        F.struct(*order).alias("_order"), weight.cast("long").alias("_weight"),
    )
    fresh_meta = materialize(fresh_meta.join(consumed, "unit", "left_anti"), "meta")
    inputs = fresh_meta.groupBy("unit").agg(F.count("*").alias("rows"), F.sum("_weight").alias("bytes"))
    digest = inputs.agg(F.count("*"), F.bit_xor(F.xxhash64("unit", "rows", "bytes"))).first()
    if not digest[0]:
        return {"run": None, "inputs": 0, "outputs": 0, "records": 0, "dropped": 0}
    before = live_outputs(spark, out).select("output").agg(F.count("*"), F.bit_xor(F.xxhash64("output"))).first()
    run = f"{digest[0]:x}-{(digest[1] or 0) & (2**64 - 1):016x}-{(before[1] or 0) & (2**64 - 1):016x}"

    # records that live outputs hold already, without their payload
    old = read_compacted(spark, out)
    candidates = fresh_meta.where("_whole").select("unit", "_rid", "_key", "_order", "_weight")
    if old is not None:
        held = old.select(F.concat(F.lit("out:"), "output").alias("unit"), F.col(record_id).alias("_rid"), key.alias("_key"), F.struct(*order).alias("_order"), weight.cast("long").alias("_weight"))
        candidates = candidates.unionByName(held)
    own = F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("\0"), F.col("_rid").cast("string")))
    keyed = candidates.withColumn("_key", own)
    kept = keyed.groupBy("_key").agg(F.max(F.struct("_order", F.col("_rid").alias("rid"), "unit", "_weight")).alias("b")).select(F.col("b")["rid"].alias("_rid"), F.col("b")["unit"].alias("unit"), F.col("b")["_weight"].alias("_weight"))
    kept = materialize(kept, "kept")

    sizes = kept.groupBy("unit").agg(F.sum("_weight").alias("bytes"), F.count("*").alias("rows"))
    if old is not None:
        # an old output is rewritten only if it lost a record or is still small enough to merge
        all_held = held.groupBy("unit").agg(F.count("*").alias("had"))
        same = all_held.join(sizes, "unit", "left")
        untouched = same.where((F.col("had") == F.col("rows")) & (F.col("bytes") >= target_bytes)).select("unit")
        sizes = sizes.join(untouched, "unit", "left_anti")
    target, merges = plan_tiers(sizes, target_bytes, base_bytes, fanout)
    if old is not None:
        lost = all_held.join(sizes, "unit", "left").where(F.coalesce(F.col("rows"), F.lit(0)) < F.col("had")).select("unit").join(untouched, "unit", "left_anti")
        idle = target.where((F.col("unit") == F.col("output")) & F.col("unit").startswith("out:")).select("unit").join(lost, "unit", "left_anti")
        target = target.join(idle, "unit", "left_anti")
    # outputs are numbered, so that a record carries eight bytes to its file (one row per output here); a unit far above
    # the target is spread over several files by a hash of its records
    weights = target.join(sizes, "unit").groupBy("output").agg(F.sum("bytes").alias("b"))
    numbered = weights.select("output", F.greatest(F.lit(1), F.floor(F.col("b") / F.lit(target_bytes))).alias("pieces"))
    up_to = F.sum("pieces").over(Window.orderBy("output").rowsBetween(Window.unboundedPreceding, 0))
    numbered = materialize(numbered.select("output", "pieces", (up_to - F.col("pieces")).alias("before")), "numbered")
    target = materialize(target.join(numbered, "output"), "target")

    # one join puts the output number on the records, one exchange brings them together; record ids are
    # unique among the records and among the live outputs
    is_old = lambda c: F.col(c).startswith("out:").alias("_old")
    number = (F.col("before") + F.pmod(F.xxhash64("_rid"), F.col("pieces"))).cast("int")
    place = materialize(kept.join(target, "unit").select("_rid", is_old("unit"), number.alias("no"), "_weight"), "place")
    placed = place.count()
    source = records.select(F.lit(False).alias("_old"), F.col(record_id).alias("_rid"), *payload)
    if old is not None:
        source = source.unionByName(old.select(F.lit(True).alias("_old"), F.col(record_id).alias("_rid"), *payload))
    outputs = int(numbered.agg(F.coalesce(F.sum("pieces"), F.lit(0))).first()[0])
    # a join by broadcast only while the counted mapping is small (13 bytes a row)
    where = place.drop("_weight")
    merged = source.join(F.broadcast(where) if placed <= BROADCAST_ROWS else where, ["_rid", "_old"]).drop("_rid", "_old")
    name = lambda c: F.concat(F.lit(run), F.lit("-"), F.col(c).cast("string"))
    data = f"{out}/data/run={run}"
    delete_path(spark, data)
    if outputs:
        # one task per output, none with two
        merged = merged.repartitionById(outputs, "no").withColumn("output", name("no")).drop("no")
        merged.write.option("compression", "uncompressed").partitionBy("output").parquet(data)

    made = place.groupBy(name("no").alias("output")).agg(F.count("*").alias("count"), F.sum("_weight").alias("bytes"))
    rows = [
        inputs.select(F.lit("input").alias("action"), F.lit(None).cast("int").alias("level"), "unit", F.lit(None).cast("string").alias("output"), "rows", "bytes"),
        merges.select(F.lit("merge").alias("action"), "level", "unit", "output", F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bytes")),
        made.select(F.lit("output").alias("action"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("unit"), "output", F.col("count").alias("rows"), "bytes"),
    ]
    if old is not None:
        gone = target.where(F.col("unit").startswith("out:")).select("unit").unionByName(lost).distinct()
        rows.append(gone.select(F.lit("retire").alias("action"), F.lit(None).cast("int").alias("level"), F.expr("substring(unit, 5)").alias("unit"), F.lit(None).cast("string").alias("output"), F.lit(None).cast("long").alias("rows"), F.lit(None).cast("long").alias("bytes")))
    # the _SUCCESS file of this write is the commit: before it, readers see the state of the last run
    union_all(rows).write.mode("overwrite").parquet(f"{out}/journal/run={run}")
    total = inputs.agg(F.sum("rows")).first()[0]
    return {"run": run, "inputs": digest[0], "outputs": outputs, "records": placed, "dropped": total - placed if old is None else None}
