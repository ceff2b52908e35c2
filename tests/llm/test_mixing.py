import pytest

from tensorloom.llm import mixing
from tensorloom.llm.mixing import SourceClassifier, count_tokens, mix


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats bigint")


def text(word, n):
    return " ".join([word] * n)


def test_tokens():
    assert count_tokens(["Hello world", "", None, "<|endoftext|>"])[:3] == [2, 0, 0]
    assert count_tokens(["<|endoftext|>"])[0] > 1  # ordinary text


def test_shares_and_caps(spark):
    rows = [(i, text("apple", 20 + i % 30), "Fruit ") for i in range(300)] + [(1000 + i, text("stone", 30), "ROCK") for i in range(100)] + [(2000 + i, text("water", 25), None) for i in range(30)] + [(3000, text("x", 9), "other"), (3001, None, "fruit"), (3002, "", "rock")]
    docs = documents(spark, rows)
    chosen, report = mix(docs, targets(spark, [("fruit", 0.5, 1), ("rock", 0.3, 4), ("none", 0.2, 2)]))
    r = {x["source"]: x for x in report.collect()}
    assert r["none"]["reached_share"] == 0 and r["none"]["fitted_share"] == 0
    assert r["fruit"]["fitted_share"] == pytest.approx(0.625, abs=0.02) and r["rock"]["fitted_share"] == pytest.approx(0.375, abs=0.02)
    sums = {x["source"]: x["t"] for x in chosen.where("labelled").groupBy("source").agg({"*": "count", "tokens": "sum"}).withColumnRenamed("sum(tokens)", "t").collect()}
    assert set(sums) == {"fruit", "rock"} and sum(x["reached_share"] for x in r.values()) == pytest.approx(1)
    used = {x["doc_id"]: x["repeats"] for x in chosen.collect()}
    assert max(used.values()) <= 4 and all(used.get(i, 0) <= 1 for i in range(300)) and not {3000, 3001, 3002} & set(used)
    again, _ = mix(docs, targets(spark, [("fruit", 0.5, 1), ("rock", 0.3, 4), ("none", 0.2, 2)]))
    assert {x["doc_id"]: x["repeats"] for x in again.collect()} == used


def test_posteriors_follow_labels(spark):
    rows = [(i, text("apple", 20), "fruit") for i in range(200)] + [(300 + i, text("stone", 20), "rock") for i in range(200)] + [(600 + i, text("stone" if i % 2 else "apple", 20), None) for i in range(40)]
    chosen, _ = mix(documents(spark, rows), targets(spark, [("fruit", 0.5, 1), ("rock", 0.5, 1)]))
    for x in chosen.where("not labelled").collect():
        assert x["source"] == ("rock" if x["doc_id"] % 2 else "fruit")


def test_classifier_accuracy_and_defined_cases(spark):
    c = SourceClassifier([text("a", 5), text("b", 5)] * 50, ["x", "y"] * 50, ["x", "y", "z"])
    assert c.accuracy > 0.95 and c.posterior(None).sum() == pytest.approx(1) and c.posterior("a a")[2] == 0
    empty = documents(spark, [])
    chosen, report = mix(empty, targets(spark, [("fruit", 1.0, 2)]))
    assert chosen.count() == 0 and report.first()["reached_share"] == 0
    chosen, report = mix(documents(spark, [(1, "a", "x")]), targets(spark, []))
    assert chosen.count() == 0 and report.count() == 0
    chosen, report = mix(documents(spark, [(None, "a b", "x"), (1, "a b", "x"), (1, "a b", "x")]), targets(spark, [("x", None, 2), (None, 0.5, 1), ("x", 0.5, None)]))
    assert report.count() == 1 and chosen.count() == 3


def test_fit_is_the_same_on_driver_and_cluster(spark, monkeypatch):
    rows = [(i, text("apple", 20 + i % 7), "fruit") for i in range(60)] + [(300 + i, text("stone", 20), "rock") for i in range(60)] + [(600 + i, text("stone apple" if i % 2 else "apple", 20), None) for i in range(20)]
    args = documents(spark, rows), targets(spark, [("fruit", 0.6, 2), ("rock", 0.4, 2)])
    one = sorted(map(tuple, mix(*args)[1].select("source", "fitted_share", "reached_share", "converged").collect()))
    monkeypatch.setattr(mixing, "MOST_CELLS", 0)
    monkeypatch.setattr(mixing, "MAX_STEPS", 6)
    other = sorted(map(tuple, mix(*args)[1].select("source", "fitted_share", "reached_share", "converged").collect()))
    monkeypatch.setattr(mixing, "MOST_CELLS", 50_000)
    same = sorted(map(tuple, mix(*args)[1].select("source", "fitted_share", "reached_share", "converged").collect()))
    assert [r[0] for r in one] == [r[0] for r in other] and all(a[:1] == b[:1] and a[1:3] == pytest.approx(b[1:3]) for a, b in zip(same, other, strict=True))
    assert all(r[3] for r in one)
