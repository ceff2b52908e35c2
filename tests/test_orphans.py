import pytest

from tensorloom.operators.orphans import ForeignKey, asof_state, image_of, orphan_cascade


def cascade(spark, tables, keys, ids):
    return {(r["table_name"], r["row_id"]): (r["orphan"], r["via"], r["round"]) for r in orphan_cascade(tables, keys, ids).collect()}


def test_direct_and_inherited(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    b = spark.createDataFrame([(10, "x", "p"), (11, "gone", "q"), (12, None, "r"), (13, "gone", "p")], "id int, a string, k string")
    c = spark.createDataFrame([(100, "p"), (101, "q"), (102, "r"), (103, "none"), (104, None)], "id int, b string")
    keys = [ForeignKey("b", "a", "a", "k"), ForeignKey("c", "b", "b", "k")]
    got = cascade(spark, {"a": a, "b": b, "c": c}, keys, {"a": "id", "b": "id", "c": "id"})
    # p is held by an orphan and by a live row, so it lives; q only by an orphan
    assert got == {("b", "11"): ("direct", "a", 0), ("b", "13"): ("direct", "a", 0), ("c", "101"): ("inherited", "b", 1), ("c", "103"): ("direct", "b", 0)}


def test_chain_and_cycle_reach_the_fixpoint(spark):
    rows = [(i, str(i), str(i - 1) if i else "lost") for i in range(6)] + [(7, "7", "8"), (8, "8", "7")]
    t = spark.createDataFrame(rows, "id int, k string, up string")
    got = cascade(spark, {"t": t}, [ForeignKey("t", "up", "t", "k")], {"t": "id"})
    assert {k[1]: v[2] for k, v in got.items()} == {str(i): i for i in range(6)}  # the closed cycle stays


def test_nulls_repeats_empty_and_clashing_columns(spark):
    child = spark.createDataFrame([(None, "x", 1), (1, "x", 2), (1, "x", 2), (2, None, 3)], "row_id int, ref string, via int")
    parent = spark.createDataFrame([], "row_id int, ref string, via int")
    got = orphan_cascade({"c": child, "p": parent}, [ForeignKey("c", "ref", "p", "ref")], {"c": "row_id", "p": "row_id"}).collect()
    assert sorted(str(r["row_id"]) for r in got) == ["1", "None"]
    assert orphan_cascade({"c": child}, [], {"c": "row_id"}).count() == 0
    assert cascade(spark, {"c": parent, "p": child}, [ForeignKey("c", "ref", "p", "ref")], {"c": "row_id", "p": "row_id"}) == {}


def test_hot_key(spark):
    child = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as ref")
    parent = spark.range(0, 3000, 2).selectExpr("id", "cast(id as string) as ref")
    got = orphan_cascade({"c": child, "p": parent}, [ForeignKey("c", "ref", "p", "ref")], {"c": "id", "p": "id"})
    assert got.count() == 1000 + sum(1 for i in range(3000) if i % 3 and i % 2)


def test_asof_state(spark):
    events = spark.sql("select * from values ('a', timestamp_ntz'2025-01-01 10:00:00', 0, 'pack'), ('a', timestamp_ntz'2025-01-01 10:30:00', 1, 'delete'), ('a', timestamp_ntz'2025-01-01 10:30:00', 0, 'pack') as t(image, at, event_order, event)")
    refs = spark.sql(
        "select * from values (1, 'a', timestamp_ntz'2025-01-01 09:59:59', 'z'), (2, 'a', timestamp_ntz'2025-01-01 10:00:00', 'z'), (3, 'a', timestamp_ntz'2025-01-01 10:30:00', 'z'), (4, 'a', timestamp_ntz'2025-03-01 00:00:00', 'z'),"
        " (5, 'b', timestamp_ntz'2025-01-01 10:00:00', 'z'), (6, null, timestamp_ntz'2025-01-01 10:00:00', 'z'), (7, 'a', null, 'z') as t(id, image, at, event)"
    )
    got = {r["id"]: r["event"] for r in asof_state(refs, events).collect()}
    assert got == {1: None, 2: "pack", 3: "delete", 4: "delete", 5: None, 6: None, 7: None}
    assert asof_state(refs.limit(0), events).count() == 0
    assert asof_state(refs, events.limit(0)).where("event is not null").count() == 0


def test_image_of(spark):
    h = "0123456789abcdef0123"
    texts = [f"embeddings/{h}.pt", f" /data/{h.upper()}.PT ", h, h + "4", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(image_of("t").alias("i"))
    assert [r["i"] for r in df.collect()] == [h, h, h, None, None, None, None]


def test_deep_chain_is_followed_to_its_end(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 8)], "id bigint, up bigint")
    keys = [ForeignKey("t", "up", "t", "id")]
    got = {r["row_id"]: r["round"] for r in orphan_cascade({"t": chain}, keys, {"t": "id"}).collect()}
    assert got == {str(i): i - 1 for i in range(1, 8)}
    with pytest.raises(RuntimeError):
        orphan_cascade({"t": chain}, keys, {"t": "id"}, max_rounds=3)
