"""Session-level helpers shared by every operator: work folder, lineage cuts, skew handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it was counted. Keys here are at most ~100 bytes,
#: so this bounds a broadcast to about 20 MB.
BROADCAST_ROWS = 200_000

_local_roots: dict[str, str] = {}
_marked: set[str] = set()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tensorloom")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: below ``spark.checkpoint.dir``, which all executors share.

    Only a session in one process (``local[...]``) may leave the setting unset; it then gets a
    temporary folder that is removed at exit. On a cluster a missing setting is an error, since a
    machine-local folder would lose the tables with the machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        root = f"{shared.rstrip('/')}/tensorloom-{app}"
        if app not in _marked:
            # removed with the session's process; other applications have folders of their own
            _marked.add(app)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="tensorloom-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return f"file://{_local_roots[app]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: a lineage cut that survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of any Hadoop file system, if it exists."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def spread(df: DataFrame, per_core: int = 3) -> DataFrame:
    """Give Python-heavy stages enough tasks when the input has fewer splits than cores.

    A table of normal size has more splits than this asks for and passes unchanged, without a shuffle. Only for
    plans that read files and project: there the number of splits is known without running anything. A
    plan with a shuffle is left to adaptive execution.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores or _shuffles(df) or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(per_core * cores)


def _shuffles(df: DataFrame) -> bool:
    """The plan moves rows between tasks (asking for its partitions would run it)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any(node in plan for node in ("Join ", "Aggregate ", "Sort ", "Window ", "Repartition", "Limit ", "Generate "))


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def hot_keys(df: DataFrame, key: str, share: float = 1 / 64) -> list:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share`` of them, whatever the input.

    The count is combined map-side, so a hot key costs one row per task in the shuffle.
    """
    # one pass: a rollup gives the total along with the counts, which are combined map-side
    counts = df.select(key).rollup(key).agg(F.count("*").alias("_n"), F.grouping_id().alias("_g"))
    rows = counts.orderBy(F.desc("_n")).limit(int(1 / share) + 3).collect()
    total = max((r["_n"] for r in rows if r["_g"]), default=0)
    return [r[key] for r in rows if not r["_g"] and r[key] is not None and r["_n"] > share * max(total, 64)]


def skewless_join(left: DataFrame, right: DataFrame, key: str, how: str, share: float = 1 / 64, hot: list | None = None) -> DataFrame:
    """Equi-join of a table with any key skew against a table with one row per key.

    Rows of hot keys meet their few right rows by broadcast (at most ``1 / share`` rows by
    construction); all others are joined by shuffle. ``how``: inner, left, left_semi or left_anti.
    ``hot``: the hot keys, where they were counted before.
    """
    hot = hot_keys(left, key, share) if hot is None else hot
    known = F.col(key).isNotNull()
    parts = [left.where(known & ~F.col(key).isin(hot)).join(right.where(~F.col(key).isin(hot)), key, how) if hot else left.where(known).join(right, key, how)]
    if hot:
        parts.append(left.where(F.col(key).isin(hot)).join(F.broadcast(right.where(F.col(key).isin(hot))), key, how))
    if how in ("left", "left_anti"):
        # rows without key match nothing and would all meet in one task
        parts.append(left.where(~known))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def checked_join(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join that broadcasts ``right`` only if it was counted and found small; else a shuffle join."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def with_scalars(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``df`` with the columns of a table of exactly one row, as constants."""
    row = totals.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in totals.schema})


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def bucket_of(*columns: Column | str, buckets: int) -> Column:
    """Deterministic bucket number; a null hashes like any value."""
    return F.pmod(F.xxhash64(*columns), F.lit(buckets))
