import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import compare, metrics, monitor, prepare, sampling
from rankloom.schema import MissingColumns


def measured(spark, ranking, judged, k=10):
    rankings = spark.createDataFrame(
        [("m", q, d, 1.0, i + 1) for q, ids in ranking.items() for i, d in enumerate(ids)],
        "method string, query_id string, doc_id string, score double, rank int",
    )
    qrels = spark.createDataFrame(
        [(q, d, g) for q, grades in judged.items() for d, g in grades.items()],
        "query_id string, doc_id string, rel int",
    )
    queries = spark.createDataFrame([(q,) for q in judged], "query_id string")
    rows = metrics.per_query(rankings, queries, qrels, ["m"], k).collect()
    return {r["query_id"]: r for r in rows}


def test_metrics_by_hand(spark):
    got = measured(
        spark,
        {"q": ["B", "X", "A"], "none": ["A"]},
        {"q": {"A": 3, "B": 2, "C": 0, "D": 1}, "none": {"A": 0}, "unanswered": {"A": 3}},
    )
    q = got["q"]
    assert q["precision"] == pytest.approx(0.2)
    assert q["recall"] == pytest.approx(2 / 3)
    assert q["ndcg"] == pytest.approx(0.735007, abs=1e-6)
    assert q["ap"] == pytest.approx(0.555556, abs=1e-6)
    assert q["rr"] == 1.0
    none = got["none"]
    assert none["precision"] == 0 and [none[m] for m in metrics.METRICS[1:]] == [None] * 4
    assert [got["unanswered"][m] for m in metrics.METRICS] == [0.0] * 5


def test_ideal_gain_with_more_judgments_than_places(spark):
    grades = {f"d{i}": 3 if i < 4 else 1 for i in range(30)}
    got = measured(spark, {"q": [f"d{i}" for i in range(29, 9, -1)]}, {"q": grades})["q"]
    ideal = sum((3 if i <= 4 else 1) / math.log2(i + 1) for i in range(1, 11))
    found = sum(1 / math.log2(i + 1) for i in range(1, 11))
    assert got["ndcg"] == pytest.approx(found / ideal)
    assert got["recall"] == pytest.approx(10 / 30)


def test_means_skip_undefined_values(spark):
    df = spark.createDataFrame([("a", 0.5, None), ("a", None, None)], "method string, x double, y double")
    row = metrics.by_method(df, ("x", "y")).first()
    assert row["x"] == 0.5 and row["y"] == 0.0


@pytest.fixture(scope="module")
def two_methods(spark):
    rows = [
        ("a", "q1", 0.0, 0.0),
        ("b", "q1", 0.5, 0.4),
        ("a", "q2", 1.0, 0.9),
        ("b", "q2", 1.0, 0.9),
        ("a", "q3", 1.0, 0.8),
        ("b", "q3", 0.5, 0.2),
        ("a", "q4", None, None),
        ("b", "q4", None, None),
    ]
    return spark.createDataFrame(rows, "method string, query_id string, recall double, ndcg double")


def test_comparisons(two_methods):
    assert [r["query_id"] for r in compare.fails_and_succeeds(two_methods, "a", "b").collect()] == ["q1"]
    assert [r["query_id"] for r in compare.beats(two_methods, "a", "b").collect()] == ["q3"]
    changed = compare.changes(two_methods, "a", "b")
    counts = {r["outcome"]: (r["queries"], r["share"]) for r in compare.outcome_counts(changed).collect()}
    assert counts == {o: (1, pytest.approx(1 / 3)) for o in ("improved", "unchanged", "worsened")}
    assert [r["query_id"] for r in compare.most_moved(changed, 2).collect()] == ["q3", "q1"]
    assert [r["query_id"] for r in compare.largest(changed, "worsened").collect()] == ["q3"]


def test_relative_change_guards_zero(spark):
    means = spark.createDataFrame([("new", "x", 0.3), ("old", "x", 0.2), ("zero", "x", 0.0)], "method string, metric string, value double")
    got = {r["method"]: r["change_pct"] for r in compare.relative_change(means, "new").collect()}
    assert got["old"] == pytest.approx(50.0) and math.isnan(got["zero"])


def test_grading_locale_and_text(spark):
    df = spark.createDataFrame(
        [("1", "q", "p1", "US", "E"), ("2", "q", "p1", "us", "S"), ("3", "q", "p2", "de", "C"), ("4", "q", "p3", None, "?")],
        "example_id string, query string, product_id string, product_locale string, esci_label string",
    )
    assert prepare.keep_locale(df).count() == 2
    assert prepare.keep_locale(df, "fr").count() == 4
    graded = prepare.grade(df)
    assert sorted(r["relevance_score"] for r in graded.collect()) == [1, 2, 3]
    assert prepare.qrels(graded).filter("doc_id = 'p1'").first()["rel"] == 3
    goods = spark.createDataFrame([("p1", " Tin\tbox ", None), ("p2", None, None)], "product_id string, product_title string, product_brand string")
    texts = prepare.drop_empty_text(prepare.add_product_text(goods)).collect()
    assert [(r["product_id"], r["product_text"]) for r in texts] == [("p1", "Tin box")]
    with pytest.raises(MissingColumns):
        prepare.join_catalog(df.drop("product_id"), goods)


@pytest.mark.parametrize("n", [1, 37, 500, 1000, 5000])
def test_positions_equal_a_global_sort(spark, n):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("k"))
    placed = sampling.with_position(df, "k", at_most=F.lit(n)).collect()
    order = [r["k"] for r in df.orderBy(sampling.hash_key("k"), "k").collect()]
    assert [r["k"] for r in sorted(placed, key=lambda r: r["position"])] == order[:n]


def test_balanced_sample_sizes(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 50, 0).otherwise(F.col("id") % 3 + 1).alias("g"), "id")
    sizes = {r["g"]: r["count"] for r in sampling.balanced_sample(df, "g", "id", 400).groupBy("g").count().collect()}
    assert sizes == {0: 50, 1: 100, 2: 100, 3: 100}
    topped = sampling.topped_up_sample(df, "g", "id", 400)
    assert topped.count() == 400 and topped.select("id").distinct().count() == 400


def test_split_is_disjoint_and_sized(spark):
    queries = spark.range(100).select(F.concat(F.lit("q"), "id").alias("query"))
    rows = sampling.split_queries(queries).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in rows} == {"train": 64, "validation": 11, "test": 25}


@pytest.mark.parametrize("accuracy", [5, 50, 10_000])
def test_medians_are_exact(spark, accuracy):
    import random
    import statistics

    rng = random.Random(1)
    rows = [("a", rng.choice([1.0, 2.0, 2.5, rng.random() * 5])) for _ in range(501)]
    rows += [("b", rng.random()) for _ in range(400)] + [("c", 4.0), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in monitor.exact_medians(df, ("g",), "v", accuracy).collect()}
    for g in "abcd":
        assert got[g] == pytest.approx(statistics.median(v for k, v in rows if k == g))
