"""Queries over the corpus operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tensorloom.functions import codec, geometry, keys, layout
from tensorloom.operators import metrics, order, relational
from tensorloom.operators.orphans import image_of
from tensorloom.runtime import delete_path, scratch_path, skewless_join, union_all
from tensorloom.sources import files
from tensorloom.sources.tables import table
from tensorloom.streaming import telemetry

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


_T = table
_IMG = "regexp_extract(lower({}), '(?:^|[^0-9a-f])([0-9a-f]{{20}})(?:[^0-9a-f]|$)', 1)"
_WHOLE = "(vis_bytes IS NOT NULL AND octet_length(vis_bytes) = n_vis * 2)"


# --- scans, projections, keys ------------------------------------------------------------------
@query("SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'purchase')")
def scan_project_in(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "events").where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type", "value")


@query("SELECT DISTINCT emb, subset FROM train_manifest WHERE subset IN ('kioskui', 'webstep')")
def distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "train_manifest").where(F.col("subset").isin("kioskui", "webstep")).select("emb", "subset").distinct()


@query("SELECT doc_id, 'embeddings/' || substring(sha1(CASE WHEN instr(origin, '/images/') > 0 THEN substring(origin, instr(origin, '/images/') + 8) ELSE origin END), 1, 20) || '.pt' AS key FROM documents")
def embedding_key(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "documents").select("doc_id", keys.tensor_key(F.col("origin")).alias("key"))


@query(
    "SELECT doc_id, split_part(origin, '/', 1) AS first, regexp_extract(origin, '([^/]*)$', 1) AS base, regexp_extract(origin, '\\.([^./]*)$', 1) AS ext FROM documents WHERE origin IS NOT NULL"
)
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("origin")
    return _T(spark, sf, "documents").where(o.isNotNull()).select("doc_id", keys.first_segment(o).alias("first"), keys.base_name(o).alias("base"), keys.extension(o).alias("ext"))


_NAMES = r"SELECT doc_id, regexp_extract(origin, '([^/]*)$', 1) AS name FROM documents WHERE origin IS NOT NULL"


_SCREENS = ("toolpath", "deskpane", "kioskui", "webstep", "tapflow")
_SUBSETS = (*_SCREENS, "slidetext", "rulebook", "plotset", "bookpage", "whyframe", "scenechat", "odditybox", "formscan", "chartlab")
_PATTERN = rf"^({'|'.join(_SCREENS)})_(\d+)\.(png|jpg)$"


@query(rf"SELECT doc_id, regexp_extract(name, '{_PATTERN}', 1) AS prefix, CAST(regexp_extract(name, '{_PATTERN}', 2) AS BIGINT) AS idx, regexp_extract(name, '{_PATTERN}', 3) AS ext FROM ({_NAMES}) WHERE regexp_matches(name, '{_PATTERN}')")
def regex_parse_name(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the screen subsets; names of other subsets are not parsed."""
    parsed = _T(spark, sf, "documents").where(F.col("origin").isNotNull()).select("doc_id", keys.parsed_name(keys.base_name(F.col("origin")), _SCREENS).alias("p"))
    return parsed.where(F.col("p").isNotNull()).select("doc_id", "p.*")


@query(rf"SELECT doc_id, name FROM ({_NAMES}) WHERE NOT regexp_matches(name, '{_PATTERN}')")
def regex_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    named = _T(spark, sf, "documents").where(F.col("origin").isNotNull()).select("doc_id", keys.base_name(F.col("origin")).alias("name"))
    return named.where(keys.parsed_name(F.col("name"), _SCREENS).isNull())


@query("SELECT emb_row_id, regexp_extract(file_name, '^data/(.+)$', 1) AS rel FROM emb_shards")
def url_relpath(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://host/datasets/x/resolve/main/"), F.expr("substring(file_name, 6)"))
    return _T(spark, sf, "emb_shards").select("emb_row_id", keys.relative_path(url).alias("rel"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error'")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "events").where("event_type = 'error'").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_type, count(*) FILTER (WHERE event_id % 20 = 0) AS every20, count(*) FILTER (WHERE event_id % 200 = 0) AS every200, count(*) FILTER (WHERE event_id % 250 = 0) AS every250 FROM events GROUP BY 1")
def log_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "events").groupBy("event_type").agg(*[F.count_if(F.col("event_id") % k == 0).alias(f"every{k}") for k in (20, 200, 250)])


@query("SELECT row_id, coalesce(g, '?') AS g, CASE WHEN subset IN ('chartlab', 'formscan', 'plotset', 'bookpage', 'slidetext', 'rulebook') THEN 'doc' ELSE 'conv' END AS grp FROM train_manifest")
def default_group(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.coalesce(F.col("subset").isin("chartlab", "formscan", "plotset", "bookpage", "slidetext", "rulebook"), F.lit(False))
    return _T(spark, sf, "train_manifest").select("row_id", F.coalesce("g", F.lit("?")).alias("g"), F.when(doc, "doc").otherwise("conv").alias("grp"))


# --- nested rows -------------------------------------------------------------------------------
def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows nested by image, as the upstream sources deliver them; text-only rows by themselves."""
    rec = F.coalesce(image_of("emb"), F.concat(F.lit("text"), F.col("row_id").cast("string")))
    turn = F.struct("row_id", "user", "assistant")
    return _T(spark, sf, "train_manifest").withColumn("part", F.floor(F.col("row_id") / 1000)).groupBy(rec.alias("rec"), "part").agg(F.sort_array(F.collect_list(turn)).alias("texts"))


@query(
    f"""WITH r AS (SELECT coalesce(nullif({_IMG.format('emb')}, ''), 'text' || row_id) AS rec, row_id // 1000 AS part, row_id, "user", assistant FROM train_manifest)
SELECT rec, CAST(part AS BIGINT) AS part, CAST(row_number() OVER (PARTITION BY rec, part ORDER BY row_id) - 1 AS INTEGER) AS turn, row_id, "user", assistant FROM r"""
)
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per turn of nested records."""
    return _records(spark, sf).select("rec", "part", F.posexplode("texts").alias("turn", "t")).select("rec", "part", "turn", "t.*")


@query(
    f"""WITH r AS (SELECT coalesce(nullif({_IMG.format('emb')}, ''), 'text' || row_id) AS rec, row_id // 1000 AS part, row_id, "user", assistant FROM train_manifest)
SELECT rec, CAST(part AS BIGINT) AS part, count(*) AS n, arg_min("user", row_id) AS first_user FROM r WHERE "user" IS NOT NULL GROUP BY 1, 2"""
)
def nested_first_turn(spark: SparkSession, sf: str) -> DataFrame:
    full = _records(spark, sf).withColumn("texts", F.filter("texts", lambda t: t["user"].isNotNull())).where(F.size("texts") > 0)
    return full.select("rec", "part", F.size("texts").cast("long").alias("n"), F.col("texts")[0]["user"].alias("first_user"))


@query("SELECT origin, j, origin || '-' || j || '.png' AS file FROM (SELECT DISTINCT origin FROM documents WHERE origin IS NOT NULL), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS j)")
def image_list_explode(spark: SparkSession, sf: str) -> DataFrame:
    images = _T(spark, sf, "documents").where(F.col("origin").isNotNull()).select("origin").distinct().withColumn("images", F.array(F.lit("a"), F.lit("b")))
    return images.select("origin", F.posexplode("images").alias("j", "_")).select("origin", "j", F.format_string("%s-%d.png", "origin", "j").alias("file"))


# --- joins -------------------------------------------------------------------------------------
@query(
    """WITH src AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, n_chars FROM documents),
want AS (SELECT DISTINCT row_id % (SELECT count(*) FROM documents) AS idx FROM val_manifest)
SELECT idx, doc_id, n_chars FROM want JOIN src USING (idx)"""
)
def positional_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = _T(spark, sf, "documents").select("doc_id", "n_chars")
    n = docs.count()
    wanted = _T(spark, sf, "val_manifest").select((F.col("row_id") % n).alias("idx")).distinct()
    return relational.positional_join(wanted, docs, ["doc_id"])


_OFFSETS = "SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, sum(n) OVER (ORDER BY source) AS hi FROM (SELECT coalesce(lower(trim(source)), '?') AS source, count(*) AS n FROM documents GROUP BY 1)"


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _T(spark, sf, "documents").groupBy(F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("source")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))  # one row per shard
    return sizes.select("source", (total - F.col("n")).alias("lo"), total.alias("hi"))


@query(f"WITH s AS ({_OFFSETS}) SELECT l_orderkey, l_linenumber, source FROM lineitem JOIN s ON l_orderkey >= lo AND l_orderkey < hi")
def range_join_offsets(spark: SparkSession, sf: str) -> DataFrame:
    points = _T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return relational.range_join(points, _offsets(spark, sf), "l_orderkey", "lo", "hi").select("l_orderkey", "l_linenumber", "source")


@query(f"WITH s AS ({_OFFSETS}) SELECT count(*) FILTER (WHERE lo <= (SELECT count(*) // 2 FROM documents)) AS n_shards FROM s")
def shards_covering(spark: SparkSession, sf: str) -> DataFrame:
    half = _T(spark, sf, "documents").count() // 2
    return relational.shards_covering(_offsets(spark, sf).select("source", (F.col("hi") - F.col("lo")).alias("n")), "source", "n", half)


@query(
    """WITH m AS (SELECT DISTINCT origin AS member FROM documents WHERE origin IS NOT NULL AND doc_id % 3 > 0),
b AS (SELECT split_part(member, '/', 2) AS base, min(member) AS first FROM m GROUP BY 1),
n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN origin ELSE 'moved/' || split_part(origin, '/', 2) END AS name FROM documents WHERE origin IS NOT NULL)
SELECT doc_id, name, coalesce(m.member, b.first) AS member, CASE WHEN m.member IS NOT NULL THEN 'exact' WHEN b.first IS NOT NULL THEN 'base name' ELSE 'none' END AS match
FROM n LEFT JOIN m ON m.member = n.name LEFT JOIN b ON b.base = split_part(n.name, '/', 2)"""
)
def lookup_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    docs = _T(spark, sf, "documents").where(F.col("origin").isNotNull())
    members = docs.where("doc_id % 3 > 0").select(F.col("origin").alias("member")).distinct()
    names = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("origin")).otherwise(F.concat(F.lit("moved/"), keys.base_name(F.col("origin")))).alias("name"))
    return relational.fallback_lookup(names, members)


@query(f"SELECT row_id FROM train_manifest WHERE emb IS NOT NULL AND {_IMG.format('emb')} NOT IN (SELECT {_IMG.format('key')} FROM pack_log WHERE lower(action) = 'pack')")
def resume_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose image was never packed."""
    todo = _T(spark, sf, "train_manifest").select("row_id", image_of("emb").alias("image")).where(F.col("image").isNotNull())
    done = _T(spark, sf, "pack_log").where(F.lower("action") == "pack").select(image_of("key").alias("image"))
    return relational.not_done(todo, done, "image").select("row_id")


@query(f"SELECT emb_row_id, n_vis FROM emb_shards WHERE {_IMG.format('key')} IN (SELECT {_IMG.format('emb')} FROM val_manifest)")
def keep_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    keep = _T(spark, sf, "val_manifest").select(image_of("emb").alias("image")).where(F.col("image").isNotNull()).distinct()
    return _T(spark, sf, "emb_shards").select("emb_row_id", "n_vis", image_of("key").alias("image")).join(keep, "image", "left_semi").select("emb_row_id", "n_vis")


def _resume_sql(hub_only: str) -> str:
    return f"""WITH s AS (SELECT DISTINCT {_IMG.format('key')} AS image FROM pack_log),
v AS (SELECT DISTINCT {_IMG.format('key')} AS image FROM emb_shards WHERE {_WHOLE}),
h AS (SELECT DISTINCT {_IMG.format('emb')} AS image FROM val_manifest WHERE emb IS NOT NULL)
SELECT image, CASE WHEN v.image IS NOT NULL AND h.image IS NOT NULL THEN 'skip' WHEN v.image IS NOT NULL THEN 'push_from_vol' WHEN h.image IS NOT NULL AND {hub_only} THEN 'skip' ELSE 'pack' END AS action
FROM s LEFT JOIN v USING (image) LEFT JOIN h USING (image)"""


def _resume(spark: SparkSession, sf: str, hub_only: bool) -> DataFrame:
    shards = _T(spark, sf, "pack_log").select(image_of("key").alias("image")).distinct()
    vol = _T(spark, sf, "emb_shards").where(codec.whole_tensor(F.col("n_vis"), F.col("vis_bytes"), 1)).select(image_of("key").alias("image"))
    hub = _T(spark, sf, "val_manifest").where(F.col("emb").isNotNull()).select(image_of("emb").alias("image"))
    return relational.resume_action(shards, vol, hub, "image", hub_only)


@query(_resume_sql("false"))
def resume_action(spark: SparkSession, sf: str) -> DataFrame:
    return _resume(spark, sf, False)


@query(_resume_sql("true"))
def resume_action_hub_only(spark: SparkSession, sf: str) -> DataFrame:
    return _resume(spark, sf, True)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE length(text) * 10 END AS value FROM documents")
def size_cache_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = _T(spark, sf, "documents")
    cache = docs.where("doc_id % 3 = 0").select("doc_id", F.col("n_chars").alias("value"))
    return relational.merged_cache(docs, cache, "doc_id", (F.length("text") * 10).cast("long"))


@query("SELECT emb_row_id, n_vis * 2 AS expected, CAST(octet_length(vis_bytes) AS BIGINT) AS actual FROM emb_shards WHERE vis_bytes IS NULL OR octet_length(vis_bytes) <> n_vis * 2")
def size_verify(spark: SparkSession, sf: str) -> DataFrame:
    shards = _T(spark, sf, "emb_shards")
    expected = shards.select("emb_row_id", (F.col("n_vis") * 2).alias("size"))
    actual = shards.select("emb_row_id", F.length("vis_bytes").cast("long").alias("size"))
    return relational.size_mismatches(expected, actual, "emb_row_id")


@query(
    f"""WITH t AS (SELECT {_IMG.format('key')} AS image, max(n_vis) AS n_vis FROM emb_shards WHERE {_WHOLE} GROUP BY 1)
SELECT row_id, n_vis FROM (SELECT row_id, {_IMG.format('emb')} AS image FROM train_manifest WHERE emb IS NOT NULL) JOIN t USING (image)"""
)
def manifest_join_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = _T(spark, sf, "train_manifest").select("row_id", image_of("emb").alias("image")).where(F.col("image").isNotNull())
    tensors = _T(spark, sf, "emb_shards").where(codec.whole_tensor(F.col("n_vis"), F.col("vis_bytes"), 1)).groupBy(image_of("key").alias("image")).agg(F.max("n_vis").alias("n_vis"))
    return relational.joined_or_fail(rows, tensors, "image", strict=False).select("row_id", "n_vis")


@query(
    f"""WITH p AS (SELECT DISTINCT {_IMG.format('key')} AS image FROM emb_shards WHERE {_WHOLE}),
e AS (SELECT shard, {_IMG.format('key')} AS image FROM pack_log WHERE lower(action) = 'pack' AND shard IS NOT NULL)
SELECT shard, count(*) AS n_expected, count(p.image) AS n_present, bool_and(p.image IS NOT NULL) AS complete FROM e LEFT JOIN p USING (image) GROUP BY 1"""
)
def chunk_all_present(spark: SparkSession, sf: str) -> DataFrame:
    expected = _T(spark, sf, "pack_log").where((F.lower("action") == "pack") & F.col("shard").isNotNull()).select("shard", image_of("key").alias("image"))
    present = _T(spark, sf, "emb_shards").where(codec.whole_tensor(F.col("n_vis"), F.col("vis_bytes"), 1)).select(image_of("key").alias("image"))
    return relational.complete_chunks(expected, present, "shard", "image")


# --- aggregations ------------------------------------------------------------------------------
@query("SELECT 'train' AS split, g, count(*) AS n FROM train_manifest GROUP BY g UNION ALL SELECT 'val', g, count(*) FROM val_manifest GROUP BY g")
def mix_counts(spark: SparkSession, sf: str) -> DataFrame:
    return union_all([_T(spark, sf, f"{s}_manifest").groupBy(F.lit(s).alias("split"), "g").agg(F.count("*").alias("n")) for s in ("train", "val")])


@query("SELECT source, lang, arg_max(origin, doc_id) AS origin FROM documents WHERE origin IS NOT NULL GROUP BY 1, 2")
def last_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return relational.last_per_key(_T(spark, sf, "documents").where(F.col("origin").isNotNull()), ["source", "lang"], "origin", "doc_id")


@query("SELECT split_part(origin, '/', 2) AS base, min(origin) AS origin FROM documents WHERE origin IS NOT NULL GROUP BY 1")
def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    named = _T(spark, sf, "documents").where(F.col("origin").isNotNull()).withColumn("base", keys.base_name(F.col("origin")))
    return relational.first_per_key(named, ["base"], "origin")


@query(
    r"""WITH d AS (SELECT regexp_extract(origin, '/([a-z]+)_(\d+)', 1) AS prefix, CAST(regexp_extract(origin, '/([a-z]+)_(\d+)', 2) AS BIGINT) AS idx FROM documents WHERE origin IS NOT NULL),
s AS (SELECT DISTINCT subset AS prefix, CAST(9000 AS BIGINT) AS size FROM train_manifest WHERE subset IS NOT NULL UNION SELECT 'unused', 10)
SELECT s.prefix, count(d.idx) AS n, min(idx) AS lo, max(idx) AS hi, any_value(size) AS size, CASE WHEN count(d.idx) = 0 THEN 'SKIP' WHEN max(idx) < any_value(size) THEN 'OK' ELSE 'OUT OF RANGE' END AS verdict
FROM s LEFT JOIN d ON d.prefix = s.prefix GROUP BY 1"""
)
def coverage_gate(spark: SparkSession, sf: str) -> DataFrame:
    parsed = _T(spark, sf, "documents").select(keys.parsed_name(keys.base_name(F.col("origin")), _SUBSETS).alias("p")).select("p.prefix", "p.idx")
    subsets = _T(spark, sf, "train_manifest").where(F.col("subset").isNotNull()).select(F.col("subset").alias("prefix")).distinct().withColumn("size", F.lit(9000).cast("long"))
    sizes = subsets.unionByName(spark.createDataFrame([("unused", 10)], "prefix string, size bigint"))
    return relational.coverage(parsed.where(F.col("prefix").isNotNull()), sizes, "prefix", "idx", "size")


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, min(value) FILTER (WHERE i = greatest(n * 95 // 100, 1)) AS p95 FROM r GROUP BY 1"""
)
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.latency_stats(_T(spark, sf, "events"), "event_type", "value")


@query("SELECT event_type, round(8 * avg(value) / 1000 / (10 + 8 * avg(value) / 1000), 6) AS serial, round(avg(value) / 1000 / (10 + avg(value) / 1000), 6) AS parallel FROM events GROUP BY 1")
def io_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a ten second step spent on reading eight records of mean latency, by one and by eight readers."""
    mean = _T(spark, sf, "events").groupBy("event_type").agg((F.avg("value") / 1000).alias("m"))
    share = lambda s: F.round(s / (s + 10), 6)
    return mean.select("event_type", share(F.col("m") * 8).alias("serial"), share(F.col("m") * 8 / 8).alias("parallel"))


@query("SELECT user_id, round(avg(m), 6) AS mean_of_means, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT user_id, event_id // 64 AS b, avg(value) AS m, count(value) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def val_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.mean_of_means(_T(spark, sf, "events").withColumn("b", F.floor(F.col("event_id") / 64)), "user_id", "b", "value")


@query(f"SELECT file_name, count(*) AS n_rows, CAST(sum(octet_length(vis_bytes)) AS BIGINT) AS n_bytes, bool_and({_WHOLE}) AS all_whole, count(*) FILTER (WHERE NOT coalesce({_WHOLE}, false)) AS n_broken FROM emb_shards GROUP BY 1")
def shard_stats(spark: SparkSession, sf: str) -> DataFrame:
    whole = codec.whole_tensor(F.col("n_vis"), F.col("vis_bytes"), 1)
    return _T(spark, sf, "emb_shards").groupBy("file_name").agg(F.count("*").alias("n_rows"), F.sum(F.length("vis_bytes")).alias("n_bytes"), F.bool_and(whole).alias("all_whole"), F.count_if(~whole).alias("n_broken"))


@query("SELECT coalesce(lower(trim(source)), 'none') AS name, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def dataset_card(spark: SparkSession, sf: str) -> DataFrame:
    return files.dataset_card(_T(spark, sf, "documents").withColumn("s", F.lower(F.trim("source"))), "s", "n_chars")


# --- order: shards, packing, splits ------------------------------------------------------------
@query("SELECT emb_row_id, idx, CAST(idx // 1360 AS BIGINT) AS shard, printf('emb_%04d', idx // 1360) AS name FROM (SELECT emb_row_id, row_number() OVER (ORDER BY \"key\", emb_row_id) - 1 AS idx FROM emb_shards)")
def shard_names(spark: SparkSession, sf: str) -> DataFrame:
    cut = relational.sharded(_T(spark, sf, "emb_shards").select("emb_row_id", "key"), ["key", "emb_row_id"], 1360)
    return cut.select("emb_row_id", "idx", "shard", keys.padded("emb_", F.col("shard"), 4).alias("name"))


@query("SELECT row_id, printf('%s-%07d', subset, row_number() OVER (PARTITION BY subset ORDER BY row_id) - 1) AS rec_id FROM train_manifest WHERE subset IS NOT NULL")
def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = _T(spark, sf, "train_manifest").where(F.col("subset").isNotNull()).select("row_id", "subset")
    return order.index_within(rows, "subset", "row_id").select("row_id", F.format_string("%s-%07d", "subset", "pos").alias("rec_id"))


@query(
    """WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, n_chars AS n FROM documents),
b(i, doc_id, batch, cur) AS (SELECT i, doc_id, CAST(0 AS BIGINT), n FROM d WHERE i = 1
UNION ALL SELECT d.i, d.doc_id, CASE WHEN b.cur + d.n > 20000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.cur + d.n > 20000 THEN d.n ELSE b.cur + d.n END FROM b JOIN d ON d.i = b.i + 1)
SELECT doc_id, batch FROM b"""
)
def greedy_pack(spark: SparkSession, sf: str) -> DataFrame:
    return order.greedy_batches(_T(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 20000, "doc_id").select("doc_id", "batch")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo, CAST(max(l_quantity) OVER (PARTITION BY l_orderkey) AS BIGINT) AS max_len FROM lineitem"
)
def cu_seqlens(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusive running offsets and the longest segment of each packed batch (a batch is bounded by its cap)."""
    key = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    before = F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    return _T(spark, sf, "lineitem").select("l_orderkey", *key, F.coalesce(before, F.lit(0)).cast("long").alias("lo"), F.max("l_quantity").over(Window.partitionBy("l_orderkey")).cast("long").alias("max_len"))


_SHA = "sha1('0|' || {})"


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= CASE WHEN source IN ('runbook', 'datacard') THEN 540 ELSE 300 END")
def head_cap_per_group(spark: SparkSession, sf: str) -> DataFrame:
    cap = F.when(F.coalesce(F.col("source").isin("runbook", "datacard"), F.lit(False)), 540).otherwise(300)
    return relational.capped(_T(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"], cap, 540)


@query("SELECT row_id, subset FROM (SELECT row_id, subset, row_number() OVER (PARTITION BY subset ORDER BY row_id) AS n FROM train_manifest) WHERE n <= 25")
def limit_n_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return relational.capped(_T(spark, sf, "train_manifest").select("row_id", "subset"), "subset", ["row_id"], 25)


@query(f"SELECT row_id, g FROM (SELECT row_id, g, row_number() OVER (PARTITION BY g ORDER BY {_SHA.format('row_id')}, row_id) AS n FROM train_manifest) WHERE n <= 300")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.sampled(_T(spark, sf, "train_manifest").select("row_id", "g"), "g", "row_id", 300)


@query(
    f"""WITH s AS (SELECT row_id, g, emb, row_number() OVER (PARTITION BY g ORDER BY {_SHA.format('row_id')}, row_id) AS n FROM train_manifest WHERE g IN ('doc', 'conv'))
SELECT g, count(*) AS n_rows, count(DISTINCT emb) AS n_images FROM (SELECT g, emb FROM train_manifest WHERE g = 'agentic' UNION ALL SELECT g, emb FROM s WHERE n <= 1000) GROUP BY g"""
)
def mix_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """All agentic rows with a capped sample of the other groups."""
    rows = _T(spark, sf, "train_manifest").select("row_id", "g", "emb")
    mixed = rows.where("g = 'agentic'").unionByName(relational.sampled(rows.where(F.col("g").isin("doc", "conv")), "g", "row_id", 1000))
    return mixed.groupBy("g").agg(F.count("*").alias("n_rows"), F.countDistinct("emb").alias("n_images"))


@query(
    f"""WITH o AS (SELECT row_id, row_number() OVER (ORDER BY {_SHA.format('row_id')}, row_id) - 1 AS i FROM train_manifest)
SELECT row_id, CASE WHEN i < greatest(256, CAST(floor((SELECT count(*) FROM train_manifest) * 0.02) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM o"""
)
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    return relational.split_head(_T(spark, sf, "train_manifest").select("row_id"), "row_id")


@query(
    f"""WITH e AS (SELECT DISTINCT emb FROM train_manifest WHERE emb IS NOT NULL),
o AS (SELECT emb, row_number() OVER (ORDER BY {_SHA.format('emb')}, emb) - 1 AS i FROM e)
SELECT row_id, CASE WHEN i < greatest(256, CAST(floor((SELECT count(*) FROM e) * 0.02) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM train_manifest LEFT JOIN o USING (emb)"""
)
def train_val_split_by_image(spark: SparkSession, sf: str) -> DataFrame:
    """Split by image: all rows of one image on one side; text-only rows train."""
    rows = _T(spark, sf, "train_manifest").select("row_id", "emb")
    sides = relational.split_head(rows.where(F.col("emb").isNotNull()), "emb", by="emb")
    return sides.select("row_id", "split").unionByName(rows.where(F.col("emb").isNull()).select("row_id", F.lit("train").alias("split")))


@query(
    """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
SELECT vec_id FROM o WHERE i IN (SELECT CAST(floor(j * (SELECT count(*) FROM embeddings) / 37) AS BIGINT) FROM range(37) t(j))"""
)
def even_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.even_stride(_T(spark, sf, "embeddings").select("vec_id"), ["vec_id"], 37)


@query(
    """WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), a AS (SELECT p_type, n, CAST(round_even(100 * n / (SELECT sum(n) FROM c), 0) AS BIGINT) AS k FROM c)
SELECT p_type, n, CASE WHEN p_type = (SELECT max(p_type) FROM c) THEN CAST(100 - (SELECT coalesce(sum(k), 0) FROM a WHERE p_type <> (SELECT max(p_type) FROM c)) AS BIGINT) ELSE k END AS n_take FROM a"""
)
def proportional_alloc(spark: SparkSession, sf: str) -> DataFrame:
    return relational.proportional(_T(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")), "p_type", "n", 100)


@query("WITH o AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM val_manifest) SELECT row_id, idx, CAST(idx // 48 AS BIGINT) AS batch FROM o WHERE idx // 48 < (SELECT count(*) // 48 FROM val_manifest)")
def batch_drop_last(spark: SparkSession, sf: str) -> DataFrame:
    return relational.batched(_T(spark, sf, "val_manifest").select("row_id"), ["row_id"], 48, True)


@query("SELECT shard, count(*) AS n FROM pack_log WHERE shard >= 2 AND shard < 9 GROUP BY 1")
def shard_range(spark: SparkSession, sf: str) -> DataFrame:
    return _selected_shards(spark, sf, "2:9")


def _selected_shards(spark: SparkSession, sf: str, text: str) -> DataFrame:
    log = _T(spark, sf, "pack_log")
    n = (log.agg(F.max("shard")).first()[0] or 0) + 1
    low, high = keys.shard_range(text, n)
    return log.where((F.col("shard") >= low) & (F.col("shard") < high)).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT shard, count(*) AS n FROM pack_log WHERE shard >= 5 GROUP BY 1")
def shard_range_open(spark: SparkSession, sf: str) -> DataFrame:
    """A bare number selects from that shard to the end."""
    return _selected_shards(spark, sf, "5")


@query("SELECT key FROM pack_log UNION SELECT key FROM emb_shards")
def name_union(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "pack_log").select("key").union(_T(spark, sf, "emb_shards").select("key")).distinct()


@query("SELECT DISTINCT emb FROM train_manifest WHERE emb IS NOT NULL INTERSECT SELECT emb FROM val_manifest")
def name_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "train_manifest").select("emb").where(F.col("emb").isNotNull()).intersect(_T(spark, sf, "val_manifest").select("emb"))


@query("SELECT CAST(0 AS INTEGER) AS grp, row_number() OVER (ORDER BY key) AS i, key FROM (SELECT DISTINCT key FROM pack_log) UNION ALL SELECT 1, row_number() OVER (ORDER BY emb), emb FROM (SELECT DISTINCT emb FROM val_manifest WHERE emb IS NOT NULL)")
def ordered_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two listings, one after the other, each sorted."""
    a = _T(spark, sf, "pack_log").select("key").distinct().withColumn("grp", F.lit(0))
    b = _T(spark, sf, "val_manifest").where(F.col("emb").isNotNull()).select(F.col("emb").alias("key")).distinct().withColumn("grp", F.lit(1))
    both = order.index_within(a.unionByName(b), "grp", "key")
    return both.select("grp", (F.col("pos") + 1).alias("i"), "key")


# --- geometry ----------------------------------------------------------------------------------
_WH = "SELECT p_partkey, CAST(1 + (p_partkey * 7919) % 50000 AS DOUBLE) AS w, CAST(1 + (p_partkey * 104729) % 9000 AS DOUBLE) AS h FROM part"
_SCALED = f"""WITH g AS ({_WH}), p AS (SELECT *, floor(w / 14) * floor(h / 14) AS p FROM g),
s AS (SELECT *, least(1.0, CASE WHEN p > 0 THEN sqrt(65536.0 / p) ELSE 1.0 END, 7168.0 / w, 7168.0 / h) AS s FROM p),
r AS (SELECT p_partkey, w, h, CAST(greatest(14, least(7168, floor(w * s))) AS BIGINT) AS rw, CAST(greatest(14, least(7168, floor(h * s))) AS BIGINT) AS rh, CAST(least(7168, floor(w * s)) AS BIGINT) AS ew, CAST(least(7168, floor(h * s)) AS BIGINT) AS eh FROM s),
q AS (SELECT *, rw + (28 - rw % 28) % 28 AS pw, rh + (28 - rh % 28) % 28 AS ph, ew + (28 - ew % 28) % 28 AS qw, eh + (28 - eh % 28) % 28 AS qh FROM r)
"""


def _wh(spark: SparkSession, sf: str) -> tuple[DataFrame, Column, Column]:
    side = lambda prime, n: (1 + F.col("p_partkey") * prime % n).cast("double")
    return _T(spark, sf, "part").select("p_partkey", side(7919, 50000).alias("w"), side(104729, 9000).alias("h")), F.col("w"), F.col("h")


@query(_SCALED + "SELECT p_partkey, rw AS width, rh AS height, ph // 14 AS grid_h, pw // 14 AS grid_w FROM q")
def patch_geometry(spark: SparkSession, sf: str) -> DataFrame:
    df, w, h = _wh(spark, sf)
    (rw, rh), (gh, gw) = geometry.resized(w, h), geometry.grid(w, h)
    return df.select("p_partkey", rw.alias("width"), rh.alias("height"), gh.alias("grid_h"), gw.alias("grid_w"))


@query(_SCALED + "SELECT p_partkey, (ph // 14) * (pw // 14) // 4 AS tokens, greatest(1, (qh // 14) * (qw // 14)) AS estimate FROM q")
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    df, w, h = _wh(spark, sf)
    return df.select("p_partkey", geometry.token_count(w, h).alias("tokens"), geometry.patches_estimate(w, h).alias("estimate"))


@query(
    f"""WITH g AS ({_WH}), s AS (SELECT *, sqrt(300000.0 / (w * h)) AS s FROM g),
r AS (SELECT p_partkey, CASE WHEN s < 1 THEN greatest(1, floor(w * s)) ELSE w END AS rw, CASE WHEN s < 1 THEN greatest(1, floor(h * s)) ELSE h END AS rh FROM s)
SELECT p_partkey, CAST(greatest(28, floor(rw / 28) * 28) AS BIGINT) AS width, CAST(greatest(28, floor(rh / 28) * 28) AS BIGINT) AS height FROM r"""
)
def agentic_geometry(spark: SparkSession, sf: str) -> DataFrame:
    df, w, h = _wh(spark, sf)
    sw, sh = geometry.screen_size(w, h)
    return df.select("p_partkey", sw.alias("width"), sh.alias("height"))


# --- series ------------------------------------------------------------------------------------
@query(
    """SELECT event_id, user_id, round(list_reduce(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, v: 0.98 * a + 0.02 * v), 6) AS ema FROM events"""
)
def ema(spark: SparkSession, sf: str) -> DataFrame:
    scanned = order.linear_scan(_T(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value"), "value", 0.98, "ts", "event_id", group="user_id")
    return scanned.select("event_id", "user_id", F.round("ema", 6).alias("ema"))


@query("SELECT event_id, user_id, round(median(value) OVER w, 6) AS med, count(*) OVER w AS n_window FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
def rolling_median(spark: SparkSession, sf: str) -> DataFrame:
    med = metrics.rolling_median(_T(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"], {"value": "med"})
    return med.select("event_id", "user_id", F.round("med", 6).alias("med"), "n_window")


@query(
    "SELECT user_id, event_id, 8 * row_number() OVER w AS samples, CAST(sum(event_id % 97) OVER w AS BIGINT) AS tokens, round(sum(event_id % 97) OVER w / greatest(1e-9, row_number() OVER w), 6) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def cumulative_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and tokens seen so far and their ratio, per user."""
    totals = order.running_totals(_T(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], {"tokens": F.col("event_id") % 97})
    return totals.select("user_id", "event_id", (F.col("n_so_far") * 8).alias("samples"), "tokens", F.round(F.col("tokens") / F.greatest(F.lit(1e-9), F.col("n_so_far")), 6).alias("rate"))


def _spike_sql(cooldown: int, ids: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss,
  CAST(1 + (event_id * 7919) % 13 + CASE WHEN event_id % 11 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS gnorm FROM events),
m AS (SELECT user_id, step, loss, gnorm, median(loss) OVER w AS loss_median, median(gnorm) OVER w AS gnorm_median, count(*) OVER w AS n,
  list_reduce(list(loss) OVER u, lambda a, v: 0.98 * a + 0.02 * v) AS loss_ema, list_reduce(list(gnorm) OVER u, lambda a, v: 0.98 * a + 0.02 * v) AS gnorm_ema
  FROM e WINDOW w AS (PARTITION BY user_id ORDER BY step ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), u AS (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY step) AS i FROM m WHERE n >= 10 AND loss > 1.5 * loss_median AND gnorm > 3 * gnorm_median),
f(user_id, i, step, last, hit) AS (SELECT user_id, i, step, step, true FROM c WHERE i = 1
UNION ALL SELECT c.user_id, c.i, c.step, CASE WHEN c.step - f.last > {cooldown} THEN c.step ELSE f.last END, c.step - f.last > {cooldown} FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1)
SELECT {ids}, c.step, round(c.loss, 5) AS loss, round(c.loss_median, 5) AS loss_median, round(c.loss_ema, 5) AS loss_ema, round(c.gnorm, 4) AS gnorm, round(c.gnorm_median, 4) AS gnorm_median, round(c.gnorm_ema, 4) AS gnorm_ema
FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i WHERE f.hit"""


def _run_series(spark: SparkSession, sf: str) -> DataFrame:
    gnorm = 1 + F.col("event_id") * 7919 % 13 + F.when(F.col("event_id") % 11 == 0, 60).otherwise(0)
    rows = _T(spark, sf, "events").select("user_id", "ts", "event_id", F.col("value").alias("loss"), gnorm.cast("double").alias("gnorm"))
    return order.index_within(rows, "user_id", "ts", "event_id", name="step").withColumn("step", F.col("step") + 1)


@query(_spike_sql(5, "c.user_id"))
def spike_alerts(spark: SparkSession, sf: str) -> DataFrame:
    series = _run_series(spark, sf).withColumn("_at", F.col("step") - 1)
    return metrics.spikes(series, "user_id", ["step"], "step", cooldown=5, position="_at")


@query(
    """WITH d AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS run, CAST(len(v) AS BIGINT) AS n_rows, round(list_reduce(v, lambda a, x: 0.98 * a + 0.02 * x), 6) AS loss_ema, round(list_median(v[-200:]), 6) AS loss_median FROM d"""
)
def telemetry_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The monitor over a stream of JSON lines; the last record of each run."""
    out = _monitored(spark, sf)
    last = out.groupBy("run").agg(F.count("*").alias("n_rows"), F.max(F.struct("step", "loss_ema", "loss_median")).alias("m"))
    return last.select("run", "n_rows", F.round("m.loss_ema", 6).alias("loss_ema"), F.round("m.loss_median", 6).alias("loss_median"))


def _monitored(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "telemetry")
    log = _run_series(spark, sf).select(F.lit("train").alias("type"), F.col("user_id").cast("string").alias("run"), "step", "loss", F.col("gnorm").alias("grad_norm"))
    log.repartition(4, "run").write.json(f"{folder}/log")
    telemetry.to_table(telemetry.monitor(telemetry.read_log(spark, f"{folder}/log")), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query(_spike_sql(50, "CAST(c.user_id AS VARCHAR) AS run").replace(" AS gnorm,", " AS grad_norm,"))
def telemetry_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert records of the monitor over a stream."""
    return telemetry.alert_records(_monitored(spark, sf)).drop("type", "lr")


# --- sequence layout ---------------------------------------------------------------------------
# Both manifests, the images' numbers of visual tokens, the trainer's bound and batches padded to their longest sequence.
MAX_SEQ_LEN, BATCH_SIZE = 4096, 8
_TOK = "CASE WHEN coalesce({0}, '') = '' THEN [10] ELSE list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) % 900 + 10 AS INTEGER)) END"
_LAYOUT = f"""WITH m AS (SELECT 'train_manifest' AS table_name, row_id, emb, "user", assistant FROM train_manifest UNION ALL SELECT 'val_manifest', row_id, emb, "user", assistant FROM val_manifest),
images AS (SELECT image, max(n_vis) AS n_vis FROM (SELECT {_IMG.format('"key"')} AS image, n_vis FROM emb_shards) WHERE image <> '' GROUP BY 1),
t AS (SELECT table_name, row_id, CAST(row_id // {BATCH_SIZE} AS BIGINT) AS batch, CAST(CASE WHEN emb IS NULL THEN 0 ELSE i.n_vis END AS INTEGER) AS nv, {_TOK.format('"user"')} AS u0, {_TOK.format('assistant')} AS a0
  FROM m LEFT JOIN images i ON i.image = {_IMG.format('m.emb')} WHERE emb IS NULL OR i.n_vis IS NOT NULL),
b AS (SELECT table_name, row_id, batch, nv, u0, a0[1:greatest(1, {MAX_SEQ_LEN} - nv - 2)] AS a FROM t),
c AS (SELECT table_name, row_id, batch, nv, a, u0[1:greatest(1, {MAX_SEQ_LEN} - nv - 2 - len(a))] AS u FROM b),
l AS (SELECT *, 2 + nv + len(u) + len(a) AS n FROM c),
p AS (SELECT *, greatest(max(n) OVER w, max(nv) OVER w) AS pad_to, max(nv) OVER w AS max_v FROM l WINDOW w AS (PARTITION BY table_name, batch)),
z AS (SELECT *, list_transform(range(nv), lambda i: CAST(0 AS INTEGER)) AS vz, list_transform(range(pad_to - n), lambda i: CAST(0 AS INTEGER)) AS pz FROM p)
"""


def _collated(spark: SparkSession, sf: str) -> DataFrame:
    """``table_name, row_id, batch, nv, u, a, n, pad_to, max_v`` of every row that can be loaded.

    A row without ``emb`` has no visual tokens; an image without tensor record leaves its row out. Batches are
    eight consecutive ``row_id`` of one manifest.
    """
    rows = union_all([_T(spark, sf, m).select(F.lit(m).alias("table_name"), "row_id", "emb", image_of("emb").alias("image"), "user", "assistant") for m in ("train_manifest", "val_manifest")])
    images = _T(spark, sf, "emb_shards").groupBy(image_of("key").alias("image")).agg(F.max("n_vis").cast("int").alias("n_vis")).where(F.col("image").isNotNull())
    known = skewless_join(rows, images, "image", "left").withColumn("nv", F.when(F.col("emb").isNull(), 0).otherwise(F.col("n_vis"))).where(F.col("nv").isNotNull())
    nv = F.col("nv")
    u, a = layout.budget(layout.char_tokens(F.col("user")), layout.char_tokens(F.col("assistant")), nv, MAX_SEQ_LEN)
    known = known.select("table_name", "row_id", F.floor(F.col("row_id") / BATCH_SIZE).alias("batch"), "nv", "user", "assistant", layout.sequence_length(u, a, nv).alias("n"))
    batch = Window.partitionBy("table_name", "batch")
    padded = known.withColumns({"pad_to": F.greatest(F.max("n").over(batch), F.max("nv").over(batch)), "max_v": F.max("nv").over(batch)})
    return padded.select("table_name", "row_id", "batch", "nv", u.alias("u"), a.alias("a"), "n", "pad_to", "max_v")


@query(_LAYOUT + "SELECT table_name, row_id, CAST(n AS INTEGER) AS n, list_concat(list_concat(list_concat([1], vz), list_concat(u, a)), list_concat([2], pz)) AS input_ids FROM z")
def collate_layout(spark: SparkSession, sf: str) -> DataFrame:
    return _collated(spark, sf).select("table_name", "row_id", "n", layout.input_ids(F.col("u"), F.col("a"), F.col("nv"), F.col("pad_to")).alias("input_ids"))


@query(_LAYOUT + "SELECT table_name, row_id, list_concat(list_concat(list_transform(range(1 + nv + len(u)), lambda i: CAST(-100 AS INTEGER)), list_concat(a, [2])), list_transform(pz, lambda x: CAST(-100 AS INTEGER))) AS labels FROM z")
def collate_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _collated(spark, sf).select("table_name", "row_id", layout.labels(F.col("u"), F.col("a"), F.col("nv"), F.col("pad_to")).alias("labels"))


@query(_LAYOUT + "SELECT table_name, row_id, list_concat(list_transform(range(n), lambda i: CAST(1 AS INTEGER)), pz) AS mask, CAST(n AS BIGINT) AS n_tokens FROM z")
def collate_attention(spark: SparkSession, sf: str) -> DataFrame:
    mask = layout.attention_mask(F.col("u"), F.col("a"), F.col("nv"), F.col("pad_to"))
    return _collated(spark, sf).select("table_name", "row_id", mask.alias("mask"), F.col("n").cast("long").alias("n_tokens"))


@query(_LAYOUT + "SELECT table_name, batch, CAST(max(pad_to) AS INTEGER) AS pad_len, CAST(sum(n) AS BIGINT) AS n_tokens FROM z GROUP BY 1, 2")
def batch_pad_len(spark: SparkSession, sf: str) -> DataFrame:
    return _collated(spark, sf).groupBy("table_name", "batch").agg(F.max("pad_to").alias("pad_len"), F.sum("n").alias("n_tokens"))


@query(_LAYOUT + "SELECT table_name, row_id, list_concat(list_concat(list_concat([1], list_transform(range(nv), lambda i: CAST(1001 + i AS INTEGER))), list_concat(u, a)), [2]) AS spliced FROM z")
def splice_visual(spark: SparkSession, sf: str) -> DataFrame:
    nv = F.col("nv")
    ids = layout.input_ids(F.col("u"), F.col("a"), nv, F.col("n"))
    visual = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), nv)), lambda x: x + 1000)
    return _collated(spark, sf).select("table_name", "row_id", layout.spliced(ids, visual, nv).alias("spliced"))


@query(_LAYOUT + "SELECT table_name, row_id, nv AS n_vis, list_concat(list_transform(range(nv), lambda i: CAST(i + 1 AS DOUBLE)), list_transform(range(max_v - nv), lambda i: CAST(0 AS DOUBLE))) AS visual FROM z")
def collate_visual(spark: SparkSession, sf: str) -> DataFrame:
    """Visual part of every row (here the numbers of its tokens) with zero rows up to the longest of its batch."""
    values = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("nv"))), lambda x: x.cast("double"))
    return _collated(spark, sf).select("table_name", "row_id", F.col("nv").alias("n_vis"), layout.padded_visual(values, F.col("nv"), F.col("max_v"), 1).alias("visual"))


# --- binary tensors ----------------------------------------------------------------------------
_LUT = "[0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 0.0, -0.5, -1.0, -1.5, -2.0, -3.0, -4.0, -6.0]"


@query(
    f"""WITH b AS (SELECT vec_id, list_transform(range(8), lambda i: CAST((vec_id * 31 + i * 17) % 256 AS INTEGER)) AS p, CAST(pow(2.0, (120 + vec_id % 16) - 127) AS DOUBLE) AS s FROM embeddings)
SELECT vec_id, list_transform(flatten(list_transform(p, lambda x: [CAST({_LUT}[(x & 15) + 1] AS DOUBLE), CAST({_LUT}[(x >> 4) + 1] AS DOUBLE)])), lambda v: round(v * s, 9) + 0.0) AS vals FROM b"""
)
def fp4_dequant(spark: SparkSession, sf: str) -> DataFrame:
    packed = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("vec_id") * 31 + i * 17) % 256).cast("int"))
    scale = codec.exponent_scale(120 + F.col("vec_id") % 16)
    vals = codec.e2m1_values(packed, scale)
    return _T(spark, sf, "embeddings").select("vec_id", F.transform(vals, lambda v: F.round(v, 9) + F.lit(0.0)).alias("vals"))


@query("SELECT vec_id, list_transform(embedding, lambda x, i: round(CAST(x AS DOUBLE) * (1 + (i - 1) // 24), 6) + 0.0) AS vals FROM embeddings")
def blockwise_dequant(spark: SparkSession, sf: str) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    scaled = codec.block_scaled(values, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 24)
    return _T(spark, sf, "embeddings").select("vec_id", F.transform(scaled, lambda x: F.round(x, 6) + F.lit(0.0)).alias("vals"))


_BF16 = "list_transform({0}, lambda x: CASE WHEN x = 0 THEN CAST(0 AS FLOAT) ELSE CAST(round_even(CAST(x AS DOUBLE) / pow(2.0, floor(log2(abs(CAST(x AS DOUBLE)))) - 7), 0) * pow(2.0, floor(log2(abs(CAST(x AS DOUBLE)))) - 7) AS FLOAT) END)"


@query(f"SELECT vec_id, CAST(len(embedding) * 2 AS BIGINT) AS n_bytes, {_BF16.format('embedding')} AS vals FROM embeddings")
def bf16_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip through bfloat16 bytes: every value rounded to eight significant bits, halves to even."""
    coded = _T(spark, sf, "embeddings").withColumn("b", codec.bf16_bytes("embedding"))
    return coded.select("vec_id", F.length("b").cast("long").alias("n_bytes"), codec.bf16_values("b").alias("vals"))


@query(f"SELECT emb_row_id, n_vis, {_WHOLE} IS TRUE AS whole FROM emb_shards")
def tensor_shape_check(spark: SparkSession, sf: str) -> DataFrame:
    return _T(spark, sf, "emb_shards").select("emb_row_id", "n_vis", codec.whole_tensor(F.col("n_vis"), F.col("vis_bytes"), 1).alias("whole"))


# --- sinks read back ---------------------------------------------------------------------------
@query('SELECT emb_row_id, "key", n_vis FROM emb_shards')
def shard_write_read(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of 1360 rows written uncompressed and read again."""
    rows = _T(spark, sf, "emb_shards").select("emb_row_id", "key", "n_vis")
    path = scratch_path(spark, "shards")
    files.write_shards(relational.sharded(rows, ["key", "emb_row_id"], 1360), path)
    return spark.read.parquet(path).select("emb_row_id", "key", "n_vis")


@query('SELECT row_id, emb, "user", assistant, g FROM val_manifest')
def jsonl_write_read(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines written and read again, strictly."""
    rows = _T(spark, sf, "val_manifest").select("row_id", "emb", "user", "assistant", "g")
    path = scratch_path(spark, "jsonl")
    delete_path(spark, path)
    rows.write.json(path)
    return files.read_jsonl(spark, path, rows.schema)


@query("SELECT count(*) AS n_rows FROM documents")
def footer_counts(spark: SparkSession, sf: str) -> DataFrame:
    return files.parquet_counts(spark, f"{sf}/documents.parquet").agg(F.sum("n_rows").alias("n_rows"))


@query(f"SELECT lower(action) AS action, count(*) AS n, count(DISTINCT {_IMG.format('key')}) AS n_images, min(shard) AS lo, max(shard) AS hi FROM pack_log GROUP BY 1")
def pack_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Actions of the packer: entries, images and shard range."""
    return _T(spark, sf, "pack_log").groupBy(F.lower("action").alias("action")).agg(F.count("*").alias("n"), F.countDistinct(image_of("key")).alias("n_images"), F.min("shard").alias("lo"), F.max("shard").alias("hi"))
