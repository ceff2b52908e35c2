from pyspark.sql import functions as F

from tensorloom.runtime import hot_keys, skewless_join, spread


def test_hot_keys_and_null_keys(spark):
    left = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    assert hot_keys(left, "k") == ["hot"] and hot_keys(left.limit(0), "k") == []
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("x", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "k", how)
        got = skewless_join(left, right, "k", how)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_spread_runs_nothing(spark, data):
    rows = spark.read.parquet(f"{data}/val_manifest.parquet")
    assert spread(rows.select("row_id")).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism
    counted = rows.groupBy("g").count()
    assert spread(counted) is counted
