import os

from pyspark.sql import functions as F

from tensorloom.operators.compaction import committed, compact, live_outputs, plan_tiers, read_compacted

SCHEMA = "id bigint, file string, key string, n int, data binary, at int, output_hint string"


def run(df, out, **kw):
    return compact(
        df, out, file_column="file", record_id="id", key=F.col("key"), whole=F.length("data") == F.col("n"),
        order=[F.col("at"), (-F.col("id")).alias("tie")], payload=["id", "key", "n", "data", "at"], weight=F.length("data") + 64, **kw,
    )


def rows(n, start=0, at=1):
    return [(start + i, f"f{(start + i) // 2}", f"k{start + i}", 10, b"x" * 10, at, "h") for i in range(n)]


def test_whole_records_once(spark, tmp_path):
    out = f"file://{tmp_path}/a"
    extra = [(900, "f900", "k1", 10, b"x" * 10, 2, "h"), (901, "f900", "k2", 10, b"x", 3, "h"), (902, None, "k3", 10, None, 3, "h"), (903, "f901", "k4", 10, b"x" * 10, 1, "h"), (904, "f901", None, 10, b"x" * 10, 1, "h"), (905, "f901", None, 10, b"x" * 10, 1, "h")]
    df = spark.createDataFrame(rows(50) + extra, SCHEMA)
    done = run(df, out, target_bytes=1500, base_bytes=100, fanout=4)
    kept = {r["id"]: r for r in read_compacted(spark, out).collect()}
    assert set(kept) == (set(range(50)) - {1}) | {900, 904, 905}  # null keys stand for themselves
    assert done["records"] == 52 and all(len(r["data"]) == 10 for r in kept.values())
    made = live_outputs(spark, out).collect()
    assert 3 <= len(made) <= 6 and sum(r["rows"] for r in made) == 52
    assert all(r["bytes"] < 2 * 1500 for r in made)


def test_repeat_changes_nothing_and_new_files_are_added(spark, tmp_path):
    out = f"file://{tmp_path}/b"
    first = spark.createDataFrame(rows(40), SCHEMA)
    assert run(first, out, target_bytes=1000, base_bytes=100)["run"]
    before = {r["output"] for r in live_outputs(spark, out).collect()}
    assert run(first, out, target_bytes=1000, base_bytes=100)["run"] is None
    more = first.unionByName(spark.createDataFrame(rows(10, 100) + [(500, "late", "k0", 10, b"y" * 10, 9, "h")], SCHEMA))
    run(more, out, target_bytes=1000, base_bytes=100)
    kept = sorted(r["id"] for r in read_compacted(spark, out).collect())
    assert kept == [*range(1, 40), *range(100, 110), 500]
    after = {r["output"] for r in live_outputs(spark, out).collect()}
    assert before & after and committed(spark, out).where("action = 'retire'").count() >= 1


def test_interrupted_run_is_repeated(spark, tmp_path):
    out = f"file://{tmp_path}/c"
    df = spark.createDataFrame(rows(20), SCHEMA)
    name = run(df, out, target_bytes=1000, base_bytes=100)["run"]
    os.remove(tmp_path / "c" / "journal" / f"run={name}" / "_SUCCESS")  # written, but not committed
    assert read_compacted(spark, out) is None
    assert run(df, out, target_bytes=1000, base_bytes=100)["run"] == name
    assert read_compacted(spark, out).count() == 20


def test_empty_input(spark, tmp_path):
    out = f"file://{tmp_path}/d"
    assert run(spark.createDataFrame([], SCHEMA), out)["run"] is None
    broken = spark.createDataFrame([(1, "f", "k", 10, b"", 1, "h")], SCHEMA)
    assert run(broken, out)["records"] == 0
    assert read_compacted(spark, out) is None


def test_tiers_bound_the_outputs(spark):
    units = spark.range(500).selectExpr("concat('u', id) as unit", "100 + id % 700 as bytes", "1L as rows")
    target, merges = plan_tiers(units, 8000, base_bytes=128, fanout=4)
    sizes = [r["b"] for r in target.join(units, "unit").groupBy("output").agg(F.sum("bytes").alias("b")).collect()]
    assert max(sizes) < 16000 and len(sizes) < 60 and merges.count() >= 500


def test_unit_above_the_target_is_spread(spark, tmp_path):
    rows = [(i, "one.parquet", f"k{i}", bytes(100)) for i in range(600)] + [(1000 + i, f"small{i}.parquet", f"s{i}", bytes(10)) for i in range(5)]
    df = spark.createDataFrame(rows, "rid bigint, file string, k string, data binary")
    out = f"file://{tmp_path}/c"
    done = compact(df, out, file_column="file", record_id="rid", key=F.col("k"), whole=F.lit(True), order=[F.col("rid")], payload=["rid", "k", "data"], weight=F.length("data"), target_bytes=10_000, base_bytes=16)
    kept = read_compacted(spark, out).groupBy("output").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("b")).collect()
    assert sum(r["n"] for r in kept) == 605 and done["outputs"] == 7 and len(kept) >= 6 and max(r["b"] for r in kept) < 20_000
