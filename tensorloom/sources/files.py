"""File scans and sinks: JSON lines and arrays, archives, image headers, shards, cards, staged copies."""

from __future__ import annotations

import io
import os
import shutil
import struct
import time
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StructType

from tensorloom.functions.codec import bf16_bytes, bf16_values, whole_tensor
from tensorloom.operators.relational import gate, listed_shards
from tensorloom.runtime import delete_path, is_empty, materialize, path_exists


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, strict: bool = True) -> DataFrame:
    """JSON lines. Strict: a malformed line is an error; else it is skipped. A missing path gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, element: str) -> DataFrame:
    """Elements of JSON array files with their position: ``file, idx`` and the fields of ``element``."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"array<struct<{element}>>", {"mode": "FAILFAST"}).alias("_a"))
    return whole.select("file", F.posexplode("_a").alias("idx", "_e")).select("file", "idx", "_e.*")


def list_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """``path, length`` of files; their content is not read. A missing path gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, length bigint")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length")


def existing_shards(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Base names (``shard``) of the Parquet files in a folder that begin with ``prefix``; none where the listing fails."""
    try:
        return listed_shards(list_files(spark, path).where("length > 0"), prefix=prefix)
    except Exception:  # noqa: BLE001  a folder that cannot be listed has no shards
        return spark.createDataFrame([], "shard string")


def read_whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path, length, content`` of non-empty files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length > 0").select("path", "length", "content")


def indexed_scan(spark: SparkSession, *paths: str, index: str = "idx") -> DataFrame:
    """Rows of Parquet files with their 0-based position over all files in order of path: file offset plus row index.

    Nothing is sorted or shuffled: offsets come from counts, one row per file.
    """
    rows = spark.read.parquet(*paths)
    where = F.col("_metadata.file_path")
    counts = rows.groupBy(where.alias("_file")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    offsets = counts.select("_file", before.alias("_before"))
    placed = rows.select("*", where.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.join(F.broadcast(offsets), "_file").withColumn(index, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def read_cache(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A JSON lines cache. A missing one, or one with a line that cannot be read, is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = spark.read.schema(StructType(kind.fields).add("_corrupt_record", "string")).option("mode", "PERMISSIVE").json(path)
    lines = materialize(marked, "cache")
    return lines.drop("_corrupt_record") if is_empty(lines.where(F.col("_corrupt_record").isNotNull())) else spark.createDataFrame([], kind)


def parquet_counts(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of each file, counted from metadata: no data column is read."""
    return spark.read.parquet(*paths).groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count("*").alias("n_rows"))


def zip_members(archives: DataFrame) -> DataFrame:
    """``archive, member, content`` of the files of ``archives`` (``path, content``); folders are left out."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"archive": [path], "member": [info.filename], "content": [z.read(info)]})

    return archives.select("path", "content").mapInPandas(unpack, "archive string, member string, content binary")


class ZipSource(DataSource):
    """``spark.read.format("zip").load(path)``: members of one archive or of a folder of archives, one task each."""

    @classmethod
    def name(cls) -> str:
        return "zip"

    def schema(self) -> str:
        return "archive string, member string, length bigint"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ZipReader(self.options["path"])


class _ZipReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".zip")) if os.path.isdir(self.path) else [self.path]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition):
        with zipfile.ZipFile(partition.value) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield partition.value, info.filename, info.file_size


def header_size(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG or JPEG; None for anything else or a cut header."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        mark = data[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@F.pandas_udf(StructType().add("w", LongType()).add("h", LongType()))
def image_size(content: pd.Series) -> pd.DataFrame:
    """Size of images by their header; nulls where it cannot be read."""
    sizes = [header_size(c) or (None, None) for c in content]
    return pd.DataFrame(sizes, columns=["w", "h"]).astype("Int64")


def write_shards(df: DataFrame, path: str, shard: str = "shard", rows_per_file: int = 1360, row_group_bytes: int = 32 << 20, row_group_rows: int = 64) -> None:
    """One folder per shard, uncompressed (bfloat16 does not compress), at most ``rows_per_file`` rows a file and ``row_group_rows`` a row group."""
    (
        df.repartition(shard).sortWithinPartitions(shard).write.mode("overwrite").option("compression", "uncompressed").option("maxRecordsPerFile", rows_per_file)
        .option("parquet.block.size", row_group_bytes).option("parquet.block.row.count.limit", row_group_rows).partitionBy(shard).parquet(path)
    )


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines of every split in a folder of its own; a rewrite replaces them all."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def append_once(df: DataFrame, path: str, batch_id: int) -> None:
    """Append a batch; repeating it replaces what the first try wrote, so rows never double."""
    df.write.mode("overwrite").json(f"{path}/batch={batch_id:012d}")


def dataset_card(df: DataFrame, group: str | None = None, size: str | None = None) -> DataFrame:
    """Counts and bytes of a dataset as rows of ``name, n_rows, n_bytes``."""
    name = F.coalesce(F.col(group).cast("string"), F.lit("none")) if group else F.lit("all")
    return df.groupBy(name.alias("name")).agg(F.count("*").alias("n_rows"), (F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(0)).cast("long").alias("n_bytes"))


def write_card(card: DataFrame, path: str) -> bool:
    """Write a dataset card as one JSON file, unless there is one: says whether it was written."""
    if path_exists(card.sparkSession, path):
        return False
    card.coalesce(1).write.json(path)  # a row per group
    return True


def write_report(lines: DataFrame, path: str, append: bool = False) -> None:
    """Write a text report (one string column), new or after what is there."""
    lines.coalesce(1).write.mode("append" if append else "overwrite").text(path)  # a report is short


def write_tensors(df: DataFrame, path: str, values: str, width: int, key: str = "key", **options) -> None:
    """Encode arrays of floats as bfloat16 records (``key, n_vis, vis_bytes``) and write them as shards."""
    coded = df.select(key, *[c for c in df.columns if c == "shard"], (F.size(values) / width).cast("long").alias("n_vis"), bf16_bytes(values).alias("vis_bytes"))
    write_shards(coded if "shard" in df.columns else coded.withColumn("shard", F.lit(0)), path, **options)


def read_tensors(spark: SparkSession, path: str, width: int, strict: bool = True) -> DataFrame:
    """``key, n_vis, values`` of tensor records. Strict: a record without ``n_vis * width`` values is an error; else it is left out."""
    rows = spark.read.parquet(path)
    whole = whole_tensor(F.col("n_vis"), F.col("vis_bytes"), width)
    if strict:
        gate(rows.where(~whole).select("key", "n_vis"), "record without all its bytes")
    return rows.where(whole).select("key", "n_vis", bf16_values("vis_bytes").alias("values"))


def publish(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> bool:
    """Copy a written folder or file to another Hadoop file system under a passing name, then rename it: whole or not at all.

    What is there already stays unless ``overwrite``; says whether anything was copied.
    """
    if path_exists(spark, target):
        if not overwrite:
            return False
        delete_path(spark, target)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    a, b, part = hadoop.Path(source), hadoop.Path(target), hadoop.Path(f"{target}.part")
    to = b.getFileSystem(conf)
    to.delete(part, True)
    hadoop.FileUtil.copy(a.getFileSystem(conf), a, to, part, False, conf)
    return bool(to.rename(part, b))


def staged_copy(files: DataFrame, target: str, retries: int = 4, wait: float = 0.5) -> DataFrame:
    """Copy ``path`` (with the expected ``size``) into ``target`` in tasks: ``path, staged, length, attempts``.

    A file already there with its size is kept. A short copy is repeated after ``wait * 2^k`` seconds;
    after the last try the task fails. ``target`` must be a folder all executors share.
    """
    folder = target.removeprefix("file://")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                source, there = path.removeprefix("file:").replace("///", "/"), os.path.join(folder, os.path.basename(path))
                tries = 0
                while not (os.path.exists(there) and os.path.getsize(there) == size):
                    if tries >= retries:
                        raise OSError(f"{path}: size differs from {size} after {tries} tries")
                    if tries:
                        time.sleep(wait * 2 ** (tries - 1))
                    part = f"{there}.{os.getpid()}.part"
                    shutil.copyfile(source, part)
                    os.replace(part, there)
                    tries += 1
                rows.append((path, there, os.path.getsize(there), tries))
            yield pd.DataFrame(rows, columns=["path", "staged", "length", "attempts"])

    return files.select("path", "size").mapInPandas(copy, "path string, staged string, length bigint, attempts int")
