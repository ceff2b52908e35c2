"""Content-addressed keys, path parts and zero-padded names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes of corpus file names and what follows them.
PREFIXES = ("waveui", "showui", "aitw", "miniwob", "mind2web", "guiact-web-multi")
_REST = r"_(\d+)\.(png|jpg)$"


def name_pattern(prefixes: Sequence[str] = PREFIXES) -> str:
    """Pattern of corpus file names; its groups are prefix, number and extension."""
    return "^(" + "|".join(prefixes) + ")" + _REST


def logical_path(path: Column) -> Column:
    """What follows the first ``/images/``; the whole path where that is absent."""
    at = F.instr(path, "/images/")
    return F.when(at > 0, F.substring(path, at + 8, F.length(path))).otherwise(path)


def tensor_key(path: Column) -> Column:
    """``embeddings/<first 20 hex digits of the SHA-1 of the logical path>.pt``; null for null."""
    return F.concat(F.lit("embeddings/"), F.substring(F.sha1(logical_path(path).cast("binary")), 1, 20), F.lit(".pt"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the base name; empty without a dot."""
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def padded(prefix: str, number: Column, digits: int, suffix: str = "") -> Column:
    """Zero-padded name; longer numbers are not truncated."""
    return F.format_string(f"{prefix}%0{digits}d{suffix}", number)


def shard_of(number: Column, total: Column) -> Column:
    return F.format_string("train-%05d-of-%05d", number, total)


def relative_path(url: Column) -> Column:
    """Path inside the repository of a resolve URL; the whole text where it is none."""
    found = F.regexp_extract(url, r"/resolve/[^/]+/(.+)$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), url)


def parsed_name(name: Column, prefixes: Sequence[str] = PREFIXES) -> Column:
    """struct(prefix, idx, ext) of a corpus file name; null where the prefix is unknown or the form differs (never guessed)."""
    pattern = name_pattern(prefixes)
    fields = (F.regexp_extract(name, pattern, 1).alias("prefix"), F.regexp_extract(name, pattern, 2).cast("long").alias("idx"), F.regexp_extract(name, pattern, 3).alias("ext"))
    return F.when(name.rlike(pattern), F.struct(*fields))


def tensor_path(path: Column) -> Column:
    """``embeddings/<name>`` of a listed path, which may lack the folder; null for entries of other folders."""
    return F.when(path.startswith("embeddings/"), path).when(~path.contains("/"), F.concat(F.lit("embeddings/"), path))


def shard_range(text: str, shards: int) -> tuple[int, int]:
    """Half-open range of shards named by ``i[:j]``: a bare ``i`` means from ``i`` to the end, an empty part its own end."""
    low, _, high = text.partition(":")
    return int(low) if low else 0, min(int(high), shards) if high else shards


def int_list(text: Column) -> Column:
    """``"(1, 8)"`` -> [1, 8]."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, r"[()\[\]\s]", ""), ","), lambda x: x != ""), lambda x: x.cast("int"))
