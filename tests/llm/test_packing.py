import random

import numpy as np
from pyspark.sql import functions as F

from tensorloom.llm import packing
from tensorloom.llm.packing import combinations, fill_report, nnls, pack, plan_containers


def check(df, packed, capacity):
    rows = packed.collect()
    used = {}
    for r in rows:
        if r["container"] is not None:
            used[r["container"]] = used.get(r["container"], 0) + r["piece_length"]
    assert all(v <= capacity for v in used.values())
    assert sum(used.values()) == sum(r["length"] for r in df.collect() if (r["length"] or 0) >= 1)
    return used


def test_nnls_solves():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, (12, 30)).astype(float)
    x = np.zeros(30)
    x[[3, 9, 20]] = [5, 2, 7]
    got = nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-6)
    assert nnls(np.zeros((3, 0)), np.ones(3)).size == 0


def test_combinations():
    assert all(9 <= sum(p) <= 10 and len(p) <= 3 for p in combinations(10, 2))
    assert (2, 3, 5) in combinations(10, 2) and len(set(combinations(10, 2))) == len(combinations(10, 2))


def test_plan_uses_every_item_once():
    rng = random.Random(2)
    histogram = {}
    for _ in range(5000):
        c = min(1024, max(1, int(rng.lognormvariate(4.3, 0.8))))
        histogram[c] = histogram.get(c, 0) + 1
    plan = plan_containers(histogram, 1024)
    assert any(i[4] == 4 for i in plan.intervals)  # windows of the least squares solution
    seen = {}
    fill = {}
    for c, start, repeats, slot, per, base in plan.intervals:
        seen.setdefault(c, []).append(start)
    for c, starts in seen.items():
        assert len(starts) == len(set(starts))
    bounds = {c: sorted(s) + [histogram[c]] for c, s in seen.items()}
    for c, start, repeats, slot, per, base in plan.intervals:
        end = bounds[c][bounds[c].index(start) + 1]
        for rank in range(start, end):
            k = base + (slot + (rank - start) % repeats) // per
            fill[k] = fill.get(k, 0) + c
    assert max(fill.values()) <= 1024 and sum(fill.values()) == sum(c * n for c, n in histogram.items())
    assert len(fill) == plan.containers <= 1.02 * sum(fill.values()) / 1024 + 2


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.lognormvariate(5.8, 0.7)), None if i % 5 else i) for i in range(4000)] + [(9001, 9000, 1), (9002, 4096, 1), (9003, 4097, 1), (9004, 8192, 1)]
    df = spark.createDataFrame(rows, "row_id bigint, length bigint, piece bigint").withColumn("note", F.lit("x"))
    packed = pack(df)
    check(df, packed, 4096)
    whole = packed.groupBy("row_id").agg(F.count("*").alias("n"), F.max("n_pieces").alias("m")).where("n > 1 or m > 1").collect()
    assert {r["row_id"]: r["n"] for r in whole} == {i: -(-n // 4096) for i, n, _ in rows if n > 4096}
    report = fill_report(packed).first()
    assert report["unused_share"] < 0.02 and report["fullest"] <= 4096


def test_defined_cases(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (None, 10), (3, 10), (3, 10)], "row_id bigint, length bigint")
    rows = pack(df, 64).collect()
    assert len(rows) == 5 and sum(r["container"] is None for r in rows) == 2
    check(df, pack(df, 64), 64)
    assert pack(df.limit(0)).count() == 0 and fill_report(pack(df.limit(0))).first()["n_containers"] == 0


def test_one_length_holds_everything(spark):
    df = spark.range(3000).selectExpr("id as row_id", "500L as length")
    used = check(df, pack(df), 4096)
    assert len(used) == 375


def test_capacity_between_quanta(spark):
    """Nothing that fits is split, whatever the capacity."""
    df = spark.createDataFrame([(1, 4098), (2, 4099), (3, 4100), (4, 2000), (5, 2099)], "row_id bigint, length bigint")
    packed = pack(df, 4099)
    check(df, packed, 4099)
    assert {r["row_id"] for r in packed.where("n_pieces > 1").collect()} == {3}


def test_least_squares_at_any_size():
    plan = plan_containers({2: 4, 3: 4, 5: 4, 10: 3}, 40)
    assert any(i[4] == 4 for i in plan.intervals)
    fitted, greedy = (plan_containers({c: 40 + c % 7 for c in range(1, 200)}, 1024, fit=f).containers for f in (True, False))
    assert fitted <= greedy + 2


def test_hot_class_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 100)
    df = spark.range(3000).selectExpr("id as row_id", "if(id % 3 = 0, 700L, 500L) as length")
    used = check(df, pack(df), 4096)
    assert len(used) <= 425
