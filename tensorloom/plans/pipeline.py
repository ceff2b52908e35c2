"""Queries over listings, runs, tensors and pixels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import codec, geometry, keys, pixels
from tensorloom.operators import metrics, relational
from tensorloom.plans.reference import _BF16
from tensorloom.runtime import scratch_path
from tensorloom.sources import files
from tensorloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- listings ----------------------------------------------------------------------------------
@query("""SELECT emb_row_id, CASE WHEN starts_with("key", 'embeddings/') THEN "key" WHEN NOT contains("key", '/') THEN 'embeddings/' || "key" END AS path FROM emb_shards""")
def tensor_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Listed names in one form; entries of other folders have none."""
    return table(spark, sf, "emb_shards").select("emb_row_id", keys.tensor_path(F.col("key")).alias("path"))


@query("SELECT DISTINCT regexp_extract(file_name, '([^/]*)$', 1) AS shard FROM emb_shards WHERE regexp_matches(file_name, '(^|/)emb_[^/]*\\.parquet$')")
def listed_shards(spark: SparkSession, sf: str) -> DataFrame:
    return relational.listed_shards(table(spark, sf, "emb_shards"), "file_name", "emb_")


@query("SELECT DISTINCT origin FROM documents WHERE origin LIKE '%.png' AND contains(origin, 'kioskui')")
def catalogue_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """No file is called after the strict form, so all that name the subset come out."""
    return relational.catalogue(table(spark, sf, "documents").select("origin").distinct(), "kioskui", "origin", ".png")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5400")
def ordered_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of one order over all rows (a top-k report)."""
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5400).select("o_orderkey")


@query("SELECT count(*) AS n, CAST(min(idx) AS BIGINT) AS lo, CAST(max(idx) AS BIGINT) AS hi, count(DISTINCT idx) AS n_places FROM (SELECT row_number() OVER () - 1 AS idx FROM documents)")
def file_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of rows in their files, without a sort: they have no gap and no repeat."""
    placed = files.indexed_scan(spark, f"{sf}/documents.parquet")
    return placed.agg(F.count("*").alias("n"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.countDistinct("idx").alias("n_places"))


# --- runs --------------------------------------------------------------------------------------
_RUN = "SELECT user_id, event_id, ts, event_id % 97 AS tok, epoch(ts) AS at_s, value AS ms FROM events"


@query(
    f"""WITH r AS ({_RUN}), k AS (SELECT *, row_number() OVER w AS step, CAST(sum(tok) OVER w AS BIGINT) AS tokens_seen, min(at_s) OVER (PARTITION BY user_id) AS b FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, step, 8 * step AS samples_seen, tokens_seen, round(CASE WHEN at_s - b > 1e-9 THEN tokens_seen / (at_s - b) ELSE 0 END, 4) AS tok_s, round(CASE WHEN at_s - b > 1e-9 THEN step / (at_s - b) ELSE 0 END, 6) AS it_s, round((100000 - step) * ms / 60000, 1) AS eta_min FROM k"""
)
def run_throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Counters, rates since the run began and time left; the rates of its first moment are shown as 0."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 97).alias("tok"), at.alias("at_s"), F.col("value").alias("ms"))
    began = rows.groupBy(F.col("user_id").alias("u")).agg(F.min("at_s").alias("b"))
    seen = metrics.throughput(rows, "user_id", ["ts", "event_id"], "tok", "at_s", "ms", 100_000).join(began, F.col("user_id") == F.col("u"))
    elapsed = F.col("at_s") - F.col("b")
    rate = lambda c, digits: F.round(F.when(elapsed > 1e-9, F.col(c) / elapsed).otherwise(0.0), digits)
    return seen.select("user_id", "event_id", "step", "samples_seen", "tokens_seen", rate("tokens_seen", 4).alias("tok_s"), rate("step", 6).alias("it_s"), "eta_min")


@query(
    """WITH d AS (SELECT event_type, event_id, ts, epoch(ts) - 1600000000 AS s, CAST(sum(event_id % 7) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rows_done FROM events)
SELECT event_type, event_id, rows_done, round(rows_done / s, 1) AS rows_s, round((900000 - rows_done) / greatest(1e-9, rows_done / s) / 60 / 1e6, 1) AS eta_mega FROM d WHERE rows_done > 0"""
)
def pack_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rows done, rate and time left (in millions of minutes) after every entry of a progress log."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "ts", (F.col("event_id") % 7).alias("n"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at_s"))
    done = metrics.progress(rows, "event_type", ["ts", "event_id"], "n", "at_s", 1_600_000_000.0, 900_000).where("rows_done > 0")
    elapsed = F.col("at_s") - 1_600_000_000
    return done.select("event_type", "event_id", "rows_done", "rows_s", F.round((900_000 - F.col("rows_done")) / F.greatest(F.lit(1e-9), F.col("rows_done") / elapsed) / 60 / 1e6, 1).alias("eta_mega"))


@query(
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value, event_id FROM events),
m AS (SELECT run, step, value, CAST(event_id % 13 AS DOUBLE) AS g, list_reduce(list(value) OVER w, lambda a, v: 0.98 * a + 0.02 * v) AS le, list_reduce(list(CAST(event_id % 13 AS DOUBLE)) OVER w, lambda a, v: 0.98 * a + 0.02 * v) AS ge FROM e WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING))
SELECT run, 'loss' AS panel, 'train' AS series, step, round(value, 6) AS value FROM m UNION ALL SELECT run, 'loss', 'train average', step, round(le, 6) FROM m
UNION ALL SELECT run, 'gradient norm', 'raw', step, round(g, 6) FROM m UNION ALL SELECT run, 'gradient norm', 'average', step, round(ge, 6) FROM m
UNION ALL SELECT run, 'rates', 'lr', step, 0.001 FROM m UNION ALL SELECT run, 'rates', 'tokens/s', step, round(value, 6) FROM m
UNION ALL SELECT run, 'loss', 'validation', step, round(value, 6) FROM m WHERE step % 25 = 0"""
)
def train_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the three charts of a run."""
    from tensorloom.operators.order import index_within

    rows = index_within(table(spark, sf, "events").select("user_id", "event_id", "ts", "value"), "user_id", "ts", "event_id", name="step").withColumn("step", F.col("step") + 1)
    base = rows.select(F.col("user_id").cast("string").alias("run"), "step", F.col("value").alias("loss"), (F.col("event_id") % 13).cast("double").alias("grad_norm"), F.lit(0.001).alias("lr"), F.col("value").alias("tok_s"), F.col("value").alias("val_loss"))
    records = base.withColumn("type", F.lit("train")).unionByName(base.where("step % 25 = 0").withColumn("type", F.lit("val")))
    return metrics.chart_series(records).withColumn("value", F.round("value", 6))


@query("SELECT l_linenumber, round(sum(l_quantity) / greatest(1e-9, sum(l_extendedprice)), 6) AS img_s, max(l_tax) AS peak, round(avg(l_discount), 6) AS load FROM lineitem GROUP BY 1")
def sweep_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sweep_stats(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount")


@query("SELECT count(*) AS n_rows, CAST(sum(p_size) AS BIGINT) AS total FROM part")
def parameter_total(spark: SparkSession, sf: str) -> DataFrame:
    """A total that must lie in a range."""
    return relational.total_within(table(spark, sf, "part"), "p_size", 0, 1e15)


# --- tensors and pixels ------------------------------------------------------------------------
@query(f"SELECT CAST(vec_id AS VARCHAR) AS \"key\", CAST(4 AS BIGINT) AS n_vis, {_BF16.format('embedding')} AS vals FROM embeddings WHERE len(embedding) = 64")
def tensor_write_read(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as tensors of four rows of sixteen values: encoded, written in shards, read and decoded."""
    rows = table(spark, sf, "embeddings").where(F.size("embedding") == 64).select(F.col("vec_id").cast("string").alias("key"), "embedding", F.floor(F.col("vec_id") / 1360).alias("shard"))
    path = scratch_path(spark, "tensors")
    files.write_tensors(rows, path, "embedding", 16)
    return files.read_tensors(spark, path, 16).select("key", "n_vis", F.col("values").alias("vals"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(range(64), lambda i: (i // 8) // 3 * 2 + (i % 8) // 5 + 1) AS place, list_transform([1, 2, 3, 4, 5, 6], lambda s: s + vec_id % 3) AS scales, embedding FROM embeddings WHERE len(embedding) = 64)
SELECT vec_id, list_transform(embedding, lambda x, i: round(CAST(x AS DOUBLE) * scales[place[i]], 6) + 0.0) AS vals FROM v"""
)
def blockwise_dequant_2d(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 matrices in blocks of 3 x 5, cut at the edges."""
    rows = table(spark, sf, "embeddings").where(F.size("embedding") == 64)
    scales = F.transform(F.array(*[F.lit(float(k)) for k in range(1, 7)]), lambda s: s + F.col("vec_id") % 3)
    scaled = codec.block_scaled_2d(F.transform("embedding", lambda x: x.cast("double")), scales, 8, 3, 5)
    return rows.select("vec_id", F.transform(scaled, lambda x: F.round(x, 6) + F.lit(0.0)).alias("vals"))


_IMAGES = "SELECT p_partkey, 1 + p_partkey % 61 AS w, 1 + (p_partkey * 7) % 43 AS h, p_partkey % 256 AS v FROM part"
_GRIDS = "SELECT *, 2 * CAST(ceil(w / 28.0) AS BIGINT) AS gw, 2 * CAST(ceil(h / 28.0) AS BIGINT) AS gh FROM i"


@query(f"WITH i AS ({_IMAGES}), g AS ({_GRIDS}) SELECT p_partkey, gh AS grid_h, gw AS grid_w, gh * gw * 588 AS n_values, round(w * h * 3 * (v / 127.5 - 1), 1) AS total FROM g")
def image_patches(spark: SparkSession, sf: str) -> DataFrame:
    """One-coloured images cut into normalised, padded patches: grid, values and their sum."""
    k = F.col("p_partkey")
    sized = table(spark, sf, "part").select(k, (1 + k % 61).alias("w"), (1 + k * 7 % 43).alias("h"), (k % 256).alias("v"))
    raw = F.unhex(F.repeat(F.lpad(F.hex("v"), 2, "0"), (F.col("w") * F.col("h") * 3).cast("int")))
    cut = sized.select("p_partkey", pixels.image_patches(raw, F.col("w"), F.col("h")).alias("p"))
    total = F.aggregate("p.patches", F.lit(0.0), lambda s, x: s + x)
    return cut.select("p_partkey", "p.grid_h", "p.grid_w", F.size("p.patches").cast("long").alias("n_values"), F.round(total, 1).alias("total"))


@query(
    f"""WITH i AS ({_IMAGES}), g AS ({_GRIDS})
SELECT p_partkey, p_partkey // 8 AS batch, gh, gw, CAST(coalesce(sum(gh * gw) OVER (PARTITION BY p_partkey // 8 ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM g"""
)
def patch_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of images as one list of patches: a grid row and the first patch of each image."""
    k = F.col("p_partkey")
    gh, gw = geometry.grid((1 + k % 61).cast("double"), (1 + k * 7 % 43).cast("double"))
    # the grid pads without resizing here: sides below one patch stay as they are
    side = lambda n: 2 * F.ceil(n / 28)
    rows = table(spark, sf, "part").select(k, F.floor(k / 8).alias("batch"), side(1 + k * 7 % 43).alias("gh"), side(1 + k % 61).alias("gw"))
    before = F.sum(F.col("gh") * F.col("gw")).over(Window.partitionBy("batch").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("p_partkey", "batch", "gh", "gw", F.coalesce(before, F.lit(0)).alias("begins"))


@query(
    f"""WITH i AS ({_IMAGES}), g AS ({_GRIDS})
SELECT p_partkey, list_transform(range(gh * gw // 4), lambda k: list_transform(range(4), lambda j: ((k // (gw // 2)) * 2 + j // 2) * gw + (k % (gw // 2)) * 2 + j % 2)) AS groups FROM g"""
)
def merge_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of a grid (here their positions) in groups of four neighbours."""
    k = F.col("p_partkey")
    side = lambda n: (2 * F.ceil(n / 28)).cast("long")
    rows = table(spark, sf, "part").select(k, side(1 + k * 7 % 43).alias("gh"), side(1 + k % 61).alias("gw"))
    tokens = F.transform(F.sequence(F.lit(0), (F.col("gh") * F.col("gw") - 1).cast("int")), lambda x: x.cast("long"))
    return rows.select("p_partkey", pixels.merged(tokens, F.col("gh"), F.col("gw")).alias("groups"))
