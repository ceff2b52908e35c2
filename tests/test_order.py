import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tensorloom.operators import metrics, order, relational


def test_global_index(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 as v")
    got = [(r["v"], r["idx"]) for r in order.global_index(df, "v").collect()]
    assert all(v == i for v, i in got) and len(got) == 1000
    assert order.global_index(df.limit(0), "v").count() == 0


def loop(sizes, cap):
    batch, cur, out = -1, None, []
    for s in sizes:
        s = s or 0
        if cur is None or cur + s > cap:
            batch, cur = batch + 1, s
        else:
            cur += s
        out.append(batch)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 40)), min_size=1, max_size=120))
def test_greedy_batches_equal_a_loop(spark, sizes):
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").repartition(5)
    got = sorted((r["i"], r["batch"]) for r in order.greedy_batches(df, "n", 50, "i").collect())
    assert [b for _, b in got] == loop(sizes, 50)


@pytest.mark.parametrize("block", [7, 20_000])
def test_linear_scan_equals_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(order, "SCAN_ROWS", block)
    rng = random.Random(1)
    rows = [(g, i, None if rng.random() < 0.1 else rng.random()) for g in ("a", "b", None) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, i int, v double").where("g is not null")
    got = {(r["g"], r["i"]): r["ema"] for r in order.linear_scan(df, "v", 0.9, "i", group="g").collect()}
    for g in ("a", "b"):
        e = None
        for gg, i, v in rows:
            if gg != g:
                continue
            if v is not None:
                e = v if e is None else 0.9 * e + 0.1 * v
            assert got[g, i] == pytest.approx(e, nan_ok=True) if e is not None else got[g, i] != got[g, i]


def test_chunks_do_not_change_windows(spark):
    df = spark.range(300).selectExpr("id % 2 as g", "id as i", "cast(id * 37 % 101 as double) as v")
    whole = metrics.rolling_median(df, "g", ["i"], {"v": "m"}, width=20)
    cut = metrics.rolling_median(df, "g", ["i"], {"v": "m"}, width=20, chunk=30)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    sums = order.running_totals(df, "g", ["i"], {"s": F.col("v")}, chunk=30)
    last = {r["g"]: r["s"] for r in sums.where("n_so_far = 150").collect()}
    assert last == {r["g"]: r["s"] for r in df.groupBy("g").agg(F.sum("v").alias("s")).collect()}


def test_spike_cooldown(spark):
    rows = [("r", i, 10.0 if i in (40, 45, 95) else 1.0, 50.0 if i in (40, 45, 95) else 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "run string, step int, loss double, gnorm double")
    assert [r["step"] for r in metrics.spikes(df, "run", ["step"], "step").orderBy("step").collect()] == [40, 95]
    early = spark.createDataFrame([("r", i, 10.0 if i == 5 else 1.0, 50.0 if i == 5 else 0.5) for i in range(8)], df.schema)
    assert metrics.spikes(early, "run", ["step"], "step").count() == 0


def test_gates_fail_closed(spark):
    source = spark.range(5).selectExpr("id as doc")
    wanted = spark.createDataFrame([(1,), (9,)], "idx bigint")
    with pytest.raises(relational.GateError):
        relational.positional_join(wanted, source, ["doc"])
    assert relational.positional_join(wanted, source, ["doc"], strict=False).count() == 1
    with pytest.raises(relational.GateError):
        relational.joined_or_fail(spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int"), "k")


def test_range_join_with_many_intervals(spark):
    intervals = spark.range(6000).selectExpr("id as s", "id * 3 as lo", "id * 3 + 3 as hi")
    points = spark.range(0, 18000, 7).selectExpr("id as p")
    got = relational.range_join(points, intervals, "p", "lo", "hi").select("p", "s").collect()
    assert len(got) == points.count() and all(r["s"] == r["p"] // 3 for r in got)


@pytest.mark.parametrize(("vol", "hub", "only", "action"), [(1, 1, 0, "skip"), (1, 0, 0, "push_from_vol"), (0, 1, 1, "skip"), (0, 1, 0, "pack"), (0, 0, 1, "pack")])
def test_resume_action(spark, vol, hub, only, action):
    s = spark.createDataFrame([("x",)], "k string")
    got = relational.resume_action(s, s if vol else s.limit(0), s if hub else s.limit(0), "k", bool(only)).first()["action"]
    assert got == action


def test_greedy_batches_of_nothing(spark):
    """Items without size make no place where a batch could begin."""
    df = spark.range(200_000).selectExpr("id", "if(id % 50000 = 7, 30, 0) as n")
    got = order.greedy_batches(df, "n", 50, "id").groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in got} == {0: 50007, 1: 50000, 2: 50000, 3: 49993}


def test_range_join_with_one_long_interval(spark):
    intervals = spark.createDataFrame([("long", 0, 10**12)] + [(f"s{k}", 10**12 + 3 * k, 10**12 + 3 * k + 2) for k in range(50)] + [("none", 5, 5)], "s string, lo bigint, hi bigint")
    points = spark.createDataFrame([(0,), (5,), (10**12 - 1,), (10**12,), (10**12 + 2,), (10**12 + 4,), (-1,), (None,)], "p bigint")
    got = {(r["p"], r["s"]) for r in relational.range_join(points, intervals, "p", "lo", "hi").collect()}
    assert got == {(0, "long"), (5, "long"), (10**12 - 1, "long"), (10**12, "s0"), (10**12 + 4, "s1")}
