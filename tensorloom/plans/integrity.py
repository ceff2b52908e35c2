"""Queries p1_* (orphan references) and p5_* (small files)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.operators.compaction import committed, compact, read_compacted
from tensorloom.operators.orphans import ForeignKey, asof_state, image_of, orphan_cascade
from tensorloom.runtime import materialize, scratch_path, skewless_join, with_scalars
from tensorloom.sources.tables import table

MANIFESTS = ("train_manifest", "val_manifest")


def _whole() -> Column:
    """A tensor record with all its bytes (two per token at width 1)."""
    return F.col("vis_bytes").isNotNull() & F.col("n_vis").isNotNull() & (F.length("vis_bytes") == F.col("n_vis") * 2)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Packs (whole tensor records) and deletes of every image; at equal times the delete comes last."""
    packs = table(spark, sf, "emb_shards").where(_whole()).select(image_of("key").alias("image"), F.col("packed_at").alias("at"), F.lit(0).alias("event_order"), F.lit("pack").alias("event"))
    deletes = table(spark, sf, "pack_log").where(F.lower(F.trim("action")) == "delete").select(image_of("key").alias("image"), F.col("ts").alias("at"), F.lit(1).alias("event_order"), F.lit("delete").alias("event"))
    return packs.unionByName(deletes).where(F.col("image").isNotNull() & F.col("at").isNotNull()).distinct()


def _references(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows with a non-null ``emb``; one that names no image refers to an image of its own that does not exist."""
    parts = [
        table(spark, sf, name).where(F.col("emb").isNotNull()).select(
            F.lit(name).alias("table_name"), "row_id", F.coalesce(image_of("emb"), F.concat(F.lit("?"), "emb")).alias("image"), F.col("written_at").alias("at")
        )
        for name in MANIFESTS
    ]
    return parts[0].unionByName(parts[1])


def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References with their state, and the orphans among all records of the graph.

    The graph: a manifest row refers to the state its image had when the row was written; a state refers
    to the bytes that were packed. Deletes leave a state without bytes: it is orphaned itself and the
    rows that refer to it inherit that. Rows written before any state exists are orphaned directly.
    """
    events = materialize(_events(spark, sf), "events")
    stamp = lambda image, at, event: F.concat_ws("|", F.col(image), F.col(at).cast("string"), F.col(event))
    refs = asof_state(_references(spark, sf), events)
    refs = materialize(refs.withColumn("state", F.when(F.col("event").isNotNull(), stamp("image", "event_at", "event")).otherwise(F.concat(F.col("image"), F.lit("|never")))), "refs")
    packs = events.where("event = 'pack'").select(stamp("image", "at", "event").alias("pack_id"), stamp("image", "at", "event").alias("bytes_of"))
    states = events.select(stamp("image", "at", "event").alias("state_id"), stamp("image", "at", "event").alias("state"), stamp("image", "at", "event").alias("bytes_of"))
    tables = {"packs": packs, "states": states} | {m: refs.where(F.col("table_name") == m).select("row_id", "state") for m in MANIFESTS}
    keys = [ForeignKey("states", "bytes_of", "packs", "bytes_of")] + [ForeignKey(m, "state", "states", "state") for m in MANIFESTS]
    return refs, orphan_cascade(tables, keys, {"packs": "pack_id", "states": "state_id"} | {m: "row_id" for m in MANIFESTS})


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    refs, orphans = _orphans(spark, sf)
    mine = orphans.where(F.col("table_name").isin(*MANIFESTS)).select("table_name", F.col("row_id").cast("long").alias("row_id"), "orphan")
    images = table(spark, sf, "emb_shards").groupBy(image_of("key").alias("image")).agg(F.max(F.coalesce(_whole(), F.lit(False)).cast("int")).alias("_packed")).where(F.col("image").isNotNull())
    rows = refs.join(mine, ["table_name", "row_id"])
    known = skewless_join(rows, images, "image", "left")
    kind = F.when(F.col("orphan") == "inherited", "deleted").when(F.col("_packed") == 1, "late").otherwise("missing")
    return known.select("table_name", "row_id", "at", kind.alias("kind"), "orphan")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest rows whose image was not live when they were written: missing, late or deleted."""
    return _classified(spark, sf).select("table_name", "row_id", "kind")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, references and orphans by kind, direct and inherited, per manifest and month of ``written_at``."""
    month = lambda c: F.substring(F.col(c).cast("string"), 1, 7)
    found = _classified(spark, sf)
    bad = found.groupBy("table_name", month("at").alias("month")).agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("missing", "late", "deleted")],
        F.sum((F.col("orphan") == "direct").cast("long")).alias("direct"), F.sum((F.col("orphan") == "inherited").cast("long")).alias("inherited"),
    )
    parts = [table(spark, sf, m).groupBy(F.lit(m).alias("table_name"), month("written_at").alias("month")).agg(F.count("*").alias("n_rows"), F.count("emb").alias("n_refs")) for m in MANIFESTS]
    counts = ("missing", "late", "deleted", "direct", "inherited")
    both = parts[0].unionByName(parts[1]).withColumns({c: F.lit(0).cast("long") for c in counts})
    return both.unionByName(bad.withColumns({"n_rows": F.lit(0).cast("long"), "n_refs": F.lit(0).cast("long")})).groupBy("table_name", "month").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_refs", *counts)])


_IMG = "regexp_extract(lower({}), '(?:^|[^0-9a-f])([0-9a-f]{{20}})(?:[^0-9a-f]|$)', 1)"
_WHOLE = "(vis_bytes IS NOT NULL AND octet_length(vis_bytes) = n_vis * 2)"
_P1_CTE = f"""
WITH ev AS (
  SELECT {_IMG.format('"key"')} AS image, packed_at AS w_at, 0 AS o FROM emb_shards WHERE {_WHOLE}
  UNION ALL SELECT {_IMG.format('"key"')}, ts, 1 FROM pack_log WHERE lower(trim(action)) = 'delete'),
refs AS (
  SELECT 'train_manifest' AS table_name, row_id, {_IMG.format('emb')} AS image, written_at AS w_at FROM train_manifest WHERE emb IS NOT NULL
  UNION ALL SELECT 'val_manifest', row_id, {_IMG.format('emb')}, written_at FROM val_manifest WHERE emb IS NOT NULL),
packed AS (SELECT {_IMG.format('"key"')} AS image, bool_or({_WHOLE}) AS whole FROM emb_shards GROUP BY 1),
state AS (
  SELECT r.table_name, r.row_id, r.image, r.w_at, max_by(e.o, (e.w_at, e.o)) AS o
  FROM refs r LEFT JOIN ev e ON e.image = r.image AND e.w_at <= r.w_at GROUP BY ALL),
found AS (
  SELECT s.table_name, s.row_id, s.w_at, CASE WHEN s.o = 1 THEN 'deleted' WHEN p.whole THEN 'late' ELSE 'missing' END AS kind,
         CASE WHEN s.o = 1 THEN 'inherited' ELSE 'direct' END AS orphan
  FROM state s LEFT JOIN packed p ON p.image = s.image WHERE s.o IS NULL OR s.o = 1)
"""


def _documents_graph(spark: SparkSession, sf: str) -> tuple[dict[str, DataFrame], list[ForeignKey], dict[str, str]]:
    image = F.substring(F.sha1(F.col("origin").cast("binary")), 1, 20)
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("origin").isNotNull(), image).alias("image"))
    rows = table(spark, sf, "train_manifest").where(F.col("emb").isNotNull()).groupBy(image_of("emb").alias("image")).agg(F.min("row_id").alias("row_id")).where(F.col("image").isNotNull())
    shards = table(spark, sf, "emb_shards").where(_whole()).select("emb_row_id", image_of("key").alias("image"))
    tables = {"documents": docs, "images": rows, "emb_shards": shards}
    keys = [ForeignKey("images", "image", "emb_shards", "image"), ForeignKey("documents", "image", "images", "image")]
    return tables, keys, {"documents": "doc_id", "images": "row_id", "emb_shards": "emb_row_id"}


def p1_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose image no training line uses (direct) or whose image has lost its tensor (inherited)."""
    tables, keys, ids = _documents_graph(spark, sf)
    return orphan_cascade(tables, keys, ids).select("table_name", F.col("row_id").cast("long").alias("row_id"), "orphan", "via", "round")


_P1_CASCADE = f"""
WITH shards AS (SELECT DISTINCT {_IMG.format('"key"')} AS image FROM emb_shards WHERE {_WHOLE}),
images AS (SELECT {_IMG.format('emb')} AS image, min(row_id) AS row_id FROM train_manifest WHERE emb IS NOT NULL GROUP BY 1),
docs AS (SELECT doc_id, substring(sha1(origin), 1, 20) AS image FROM documents WHERE origin IS NOT NULL)
SELECT 'images' AS table_name, row_id, 'direct' AS orphan, 'emb_shards' AS via, CAST(0 AS INTEGER) AS round
FROM images WHERE image <> '' AND image NOT IN (SELECT image FROM shards)
UNION ALL SELECT 'documents', doc_id, 'direct', 'images', CAST(0 AS INTEGER) FROM docs WHERE image NOT IN (SELECT image FROM images)
UNION ALL SELECT 'documents', doc_id, 'inherited', 'images', CAST(1 AS INTEGER) FROM docs
WHERE image IN (SELECT image FROM images) AND image NOT IN (SELECT image FROM shards)
"""


def compact_shards(spark: SparkSession, sf: str, out: str, target_bytes: int = 128 << 20) -> dict:
    """Consolidate the tensor records of ``emb_shards`` below ``out``."""
    return compact(
        table(spark, sf, "emb_shards"), out, file_column="file_name", record_id="emb_row_id", key=image_of("key"), whole=_whole(),
        order=[F.col("packed_at"), (-F.col("emb_row_id")).alias("tie")], payload=["emb_row_id", "key", "n_vis", "vis_bytes", "packed_at"],
        weight=F.coalesce(F.length("vis_bytes"), F.lit(0)) + 64, target_bytes=target_bytes,
    )


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of ``emb_shards`` that the consolidated files do not hold: broken or superseded ones."""
    out = scratch_path(spark, "compacted")
    compact_shards(spark, sf, out)
    kept = read_compacted(spark, out)
    rows = table(spark, sf, "emb_shards").select("emb_row_id")
    return rows if kept is None else rows.join(kept.select("emb_row_id"), "emb_row_id", "left_anti")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Files, records, images and bytes before and after consolidation, and whether every image is there once."""
    out = scratch_path(spark, "compacted")
    compact_shards(spark, sf, out)
    shards = table(spark, sf, "emb_shards")
    before = shards.agg(F.countDistinct("file_name").alias("files_before"), F.count("*").alias("records_before"), F.countDistinct(F.when(_whole(), image_of("key"))).alias("images_before"))
    kept = read_compacted(spark, out)
    if kept is None:
        kept = shards.limit(0).withColumn("output", F.lit(""))
    after = kept.agg(
        (F.countDistinct("output") < F.lit(1)).alias("no_files"), F.count("*").alias("records_after"), F.countDistinct(image_of("key")).alias("images_after"), F.coalesce(F.sum(F.length("vis_bytes")), F.lit(0)).alias("bytes_after"),
    )
    return with_scalars(before, after.drop("no_files"))


def p5_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Journal of the transaction: inputs, merges by level and outputs."""
    out = scratch_path(spark, "compacted")
    compact_shards(spark, sf, out)
    return committed(spark, out).groupBy("action", "level").agg(F.count("*").alias("n_units"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


def p5_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the journal of a whole transaction must add up to: files and records read, records and bytes written, nothing retired."""
    out = scratch_path(spark, "compacted")
    compact_shards(spark, sf, out)
    journal = committed(spark, out)
    is_ = lambda action: F.col("action") == action
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return journal.agg(
        F.count_if(is_("input")).alias("files_read"), zero(F.sum(F.when(is_("input"), F.col("rows")))).alias("records_read"), zero(F.sum(F.when(is_("output"), F.col("rows")))).alias("records_written"),
        zero(F.sum(F.when(is_("output"), F.col("bytes")))).alias("bytes_written"), F.count_if(is_("retire")).alias("retired"),
    )


QUERIES = {"p5_totals": p5_totals, "p1_found": p1_found, "p1_report": p1_report, "p1_cascade": p1_cascade, "p5_found": p5_found, "p5_report": p5_report, "p5_journal": p5_journal}

_KEPT = f"""
WITH whole AS (SELECT emb_row_id, {_IMG.format('"key"')} AS image, packed_at, vis_bytes FROM emb_shards WHERE {_WHOLE}),
kept AS (SELECT * FROM whole QUALIFY row_number() OVER (PARTITION BY image ORDER BY packed_at DESC, emb_row_id) = 1)
"""

ORACLE = {
    "p1_found": _P1_CTE + "SELECT table_name, row_id, kind FROM found",
    "p1_report": _P1_CTE
    + """, months AS (
  SELECT 'train_manifest' AS table_name, strftime(written_at, '%Y-%m') AS month, count(*) AS n_rows, count(emb) AS n_refs FROM train_manifest GROUP BY ALL
  UNION ALL SELECT 'val_manifest', strftime(written_at, '%Y-%m'), count(*), count(emb) FROM val_manifest GROUP BY ALL),
bad AS (SELECT table_name, strftime(w_at, '%Y-%m') AS month, count(*) FILTER (WHERE kind = 'missing') AS missing, count(*) FILTER (WHERE kind = 'late') AS late,
  count(*) FILTER (WHERE kind = 'deleted') AS deleted, count(*) FILTER (WHERE orphan = 'direct') AS direct, count(*) FILTER (WHERE orphan = 'inherited') AS inherited FROM found GROUP BY ALL)
SELECT m.*, coalesce(missing, 0) AS missing, coalesce(late, 0) AS late, coalesce(deleted, 0) AS deleted, coalesce(direct, 0) AS direct, coalesce(inherited, 0) AS inherited
FROM months m LEFT JOIN bad b ON b.table_name = m.table_name AND b.month IS NOT DISTINCT FROM m.month""",
    "p1_cascade": _P1_CASCADE,
    "p5_totals": _KEPT
    + """SELECT (SELECT count(DISTINCT file_name) FROM emb_shards) AS files_read, (SELECT count(*) FROM emb_shards) AS records_read, count(*) AS records_written,
  CAST(sum(octet_length(vis_bytes) + 64) AS BIGINT) AS bytes_written, CAST(0 AS BIGINT) AS retired FROM kept""",
    "p5_found": _KEPT + "SELECT emb_row_id FROM emb_shards WHERE emb_row_id NOT IN (SELECT emb_row_id FROM kept)",
    "p5_report": _KEPT
    + f"""SELECT (SELECT count(DISTINCT file_name) FROM emb_shards) AS files_before, (SELECT count(*) FROM emb_shards) AS records_before,
  (SELECT count(DISTINCT {_IMG.format('"key"')}) FROM emb_shards WHERE {_WHOLE}) AS images_before,
  count(*) AS records_after, count(DISTINCT image) AS images_after, CAST(sum(octet_length(vis_bytes)) AS BIGINT) AS bytes_after FROM kept""",
}
