"""Queries of the optional subpackage over the data folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.language import document_languages, document_segments, fit_profiles, label_faults
from tensorloom.llm.leakage import find_leaks, remove_leaks
from tensorloom.llm.mixing import mix
from tensorloom.llm.overlap import linked_rows, near_pairs
from tensorloom.llm.packing import fill_report, pack
from tensorloom.llm.pairs import find_defects, main_defect
from tensorloom.operators.orphans import image_of
from tensorloom.runtime import materialize, skewless_join, with_scalars
from tensorloom.sources.tables import table

MANIFESTS = ("train_manifest", "val_manifest")


def _both_manifests(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, m).select(F.lit(m).alias("table_name"), "row_id", "user", "assistant", "subset") for m in MANIFESTS]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of both manifests with a defective answer, one defect each."""
    return main_defect(find_defects(_both_manifests(spark, sf)))


def p2_defects(spark: SparkSession, sf: str) -> DataFrame:
    """Every triggered defect type, counted per manifest and subset."""
    pairs = _both_manifests(spark, sf)
    found = find_defects(pairs).select("row_id", F.explode("defects").alias("defect"))
    return found.join(pairs.select("row_id", "table_name", "subset"), "row_id").groupBy("table_name", "subset", "defect").agg(F.count("*").alias("n_rows"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows in sequences of 4096. Rows without image have no visual tokens; an image without tensor record leaves its row out of all sequences."""
    rows = table(spark, sf, "train_manifest").select(
        "row_id", F.col("emb").isNull().alias("text_only"), image_of("emb").alias("image"),
        (F.coalesce(F.length("user"), F.lit(0)) + F.coalesce(F.length("assistant"), F.lit(0)) + 2).alias("text_length"),
    )
    images = table(spark, sf, "emb_shards").groupBy(image_of("key").alias("image")).agg(F.max("n_vis").alias("n_vis")).where(F.col("image").isNotNull())
    known = skewless_join(rows, images, "image", "left")
    length = F.when(F.col("text_only"), F.col("text_length")).otherwise(F.col("n_vis") + F.col("text_length")).cast("long")
    return pack(materialize(known.select("row_id", length.alias("length"), "text_only"), "lengths"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows with a tensor record that the packing puts into more than one sequence: those longer than one."""
    placed = _packed(spark, sf).where("container is not null and not text_only")
    return placed.groupBy("row_id").agg(F.min("container").alias("first"), F.max("container").alias("last")).where("first < last").select("row_id")


def p3_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What any right packing has: every row with a length placed once, in full, whole unless too long, no sequence overfull."""
    placed = materialize(_packed(spark, sf).where("container is not null"), "placed")
    rows = placed.groupBy("row_id").agg(F.max("length").alias("length"), F.sum("piece_length").alias("put"), F.count("*").alias("n"), F.countDistinct("container").alias("containers"))
    fill = placed.groupBy("container").agg(F.sum("piece_length").alias("used")).agg(F.count_if(F.col("used") > 4096).alias("n_overfull"))
    totals = rows.agg(
        F.count("*").alias("n_rows"), F.sum("put").alias("total"), F.sum("n").alias("n_pieces"), F.count_if(F.col("put") != F.col("length")).alias("n_incomplete"),
        F.count_if((F.col("length") <= 4096) & (F.col("containers") > 1)).alias("n_split_whole"), F.count_if((F.col("length") > 4096) & (F.col("containers") != F.ceil(F.col("length") / 4096))).alias("n_wrong_cut"),
    )
    return with_scalars(totals, fill)


def p3_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every train row, or piece of one, with its sequence."""
    return _packed(spark, sf).select("row_id", "piece", "n_pieces", "piece_length", F.col("container").alias("sequence_id"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences, their filling and the unused share."""
    return fill_report(_packed(spark, sf))


def _sides(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, m).select("row_id", "user", "assistant", image_of("emb").alias("image")) for m in ("val_manifest", "train_manifest")]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one validation and one training row with the same question and answer, the smaller id first."""
    return near_pairs(*_sides(spark, sf)).select(F.least("eval_id", "train_id").alias("row_id_a"), F.greatest("eval_id", "train_id").alias("row_id_b"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each evaluation split and subset, and how many of them are also in the training split."""
    hits = linked_rows(*_sides(spark, sf)).select("row_id", F.col("n_links").alias("n"))
    rows = table(spark, sf, "val_manifest").select("row_id", "eval_split", "subset").join(hits, "row_id", "left")
    return rows.groupBy("eval_split", "subset").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Items and the documents that hold a passage of them."""
    return _leaks(spark, sf).select("item_id", "doc_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    """Leaked items and documents concerned, by suite and source."""
    leaks = materialize(_leaks(spark, sf), "leaks")
    suites = table(spark, sf, "eval_items").select("item_id", "suite")
    sources = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("source")).alias("source"))
    return leaks.join(suites, "item_id").join(sources, "doc_id").groupBy("suite", "source").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every document when the leaked passages were removed."""
    leaks = materialize(_leaks(spark, sf), "leaks")
    return remove_leaks(table(spark, sf, "documents"), leaks).select("doc_id", "action", F.length("text").alias("n_chars"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the mix and how often each is used."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0].select("doc_id", "source", "tokens", "repeats")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of every source of the mix."""
    return mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p7_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Of every target: whether its documents are repeated too often, and whether its share of the reachable targets is met within a percentage point."""
    report = mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]
    reachable = report.agg(F.sum(F.when(F.col("n_documents") > 0, F.col("target_share"))).alias("_all"))
    off = F.abs(F.col("reached_share") - F.when(F.col("n_documents") > 0, F.col("target_share") / F.col("_all")).otherwise(0)) > 0.01
    return with_scalars(report, reachable).select("source", "target_share", "max_repeats", (F.col("n_documents") > 0).alias("has_documents"), (F.col("repeats_most") > F.col("max_repeats")).alias("over_repeated"), off.alias("off_target"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages of the documents whose label is missing, wrong or names only one of several languages."""
    documents = table(spark, sf, "documents")
    return label_faults(document_languages(documents, fit_profiles(documents))).select("doc_id", F.col("language").alias("lang"))


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's languages with confidence and share of its letters."""
    documents = table(spark, sf, "documents")
    found = document_languages(documents, fit_profiles(documents))
    return found.select("doc_id", "label", "language", F.round("confidence", 6).alias("confidence"), F.round("share", 6).alias("share"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Language segments of every document."""
    documents = table(spark, sf, "documents")
    return document_segments(documents, fit_profiles(documents))


QUERIES = {"p2_found": p2_found, "p2_defects": p2_defects, "p3_found": p3_found, "p3_invariants": p3_invariants, "p3_packed": p3_packed, "p3_report": p3_report, "p4_found": p4_found, "p4_report": p4_report, "p6_found": p6_found, "p6_report": p6_report, "p6_clean": p6_clean, "p7_mix": p7_mix, "p7_report": p7_report, "p7_bounds": p7_bounds, "p8_found": p8_found, "p8_languages": p8_languages, "p8_segments": p8_segments}

_IMG = "regexp_extract(lower({}), '(?:^|[^0-9a-f])([0-9a-f]{{20}})(?:[^0-9a-f]|$)', 1)"

ORACLE = {
    "p3_found": f"""
WITH images AS (SELECT {_IMG.format('"key"')} AS image, max(n_vis) AS n_vis FROM emb_shards GROUP BY 1)
SELECT t.row_id FROM train_manifest t JOIN images i ON i.image = {_IMG.format("t.emb")}
WHERE i.image <> '' AND i.n_vis + coalesce(length(t."user"), 0) + coalesce(length(t.assistant), 0) + 2 > 4096""",
    "p7_bounds": """
SELECT lower(trim(source)) AS source, sum(coalesce(target_share, 0)) AS target_share, max(coalesce(max_repeats, 0)) AS max_repeats,
  lower(trim(source)) IN (SELECT lower(trim(source)) FROM documents WHERE source IS NOT NULL AND text <> '') AS has_documents, false AS over_repeated, false AS off_target
FROM mix_targets GROUP BY 1""",
    "p3_invariants": f"""
WITH images AS (SELECT {_IMG.format('"key"')} AS image, max(n_vis) AS n_vis FROM emb_shards GROUP BY 1),
rows AS (SELECT CASE WHEN t.emb IS NULL THEN 0 ELSE i.n_vis END + coalesce(length(t."user"), 0) + coalesce(length(t.assistant), 0) + 2 AS length
  FROM train_manifest t LEFT JOIN images i ON i.image = {_IMG.format("t.emb")} AND i.image <> '' WHERE t.emb IS NULL OR i.n_vis IS NOT NULL)
SELECT count(*) AS n_rows, CAST(sum(length) AS BIGINT) AS total, CAST(sum(ceil(length / 4096.0)) AS BIGINT) AS n_pieces, CAST(0 AS BIGINT) AS n_incomplete,
  CAST(0 AS BIGINT) AS n_split_whole, CAST(0 AS BIGINT) AS n_wrong_cut, CAST(0 AS BIGINT) AS n_overfull FROM rows""",
}
