"""The shop's steps spread over all tasks, run once, and leave the judgments where they lie."""

import pytest
from pyspark.sql import functions as F

from rankloom.operators import hybrid, metrics
from rankloom.operators.ranking import result_rows, with_grades
from rankloom.plans import inputs
from rankloom.plans.inputs import Shop

WORDS = ["large", "hot", "ring", "bolt", "steel", "blue"]


@pytest.fixture(scope="module")
def shop_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop"))
    word = F.array(*[F.lit(w) for w in WORDS])
    place = F.col("id") % len(WORDS)
    spark.range(300).select(
        F.col("id").alias("p_partkey"),
        F.concat_ws(" ", word[place.cast("int")], word[((place + 2) % 6).cast("int")]).alias("p_name"),
        F.concat(F.lit("Brand#"), F.col("id") % 3).alias("p_brand"),
        word[(F.col("id") % 4).cast("int")].alias("p_type"),
    ).coalesce(1).write.parquet(f"{folder}/part.parquet")
    spark.range(900).select(
        F.col("id").alias("l_orderkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (F.col("id") * 7 % 300).alias("l_partkey"),
        (F.col("id") % 12).alias("l_suppkey"),
        F.lit(1.0).alias("l_quantity"),
        F.lit("A").alias("l_returnflag"),
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_a_catalog_in_one_split_is_dealt_out(spark, shop_dir):
    shop = Shop(spark, shop_dir)
    assert len(spark.read.parquet(f"{shop_dir}/part.parquet").inputFiles()) == 1
    assert len(shop.corpus.inputFiles()) > 1 and len(shop.vectors.inputFiles()) > 1
    assert shop.corpus.count() == shop.vectors.count() == 300


def test_candidates_are_searched_once(spark, shop_dir, monkeypatch):
    calls = []
    found = hybrid.candidates
    monkeypatch.setattr(hybrid, "candidates", lambda *a, **b: calls.append(1) or found(*a, **b))
    shop = Shop(spark, shop_dir)
    methods = {r["method"] for r in shop.all_methods().select("method").distinct().collect()}
    assert methods == {"tfidf", "bm25", "embedding", "hybrid", "rerank"}
    assert shop.training_rows().count() > 0 and len(calls) == 1


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("m", "q", "a", 1.0, 1), ("m", "q", "b", 0.5, 2), ("m", None, "a", 0.5, 1), ("n", "q", "a", 1.0, 1), ("n", "p", None, 1.0, 1)]
    rankings = spark.createDataFrame(rows, "method string, query_id string, doc_id string, score double, rank int")
    grades = [("q", "a", 3), ("q", "c", 2), ("p", "z", 1), (None, "a", 2), ("p", None, 1)]
    return rankings, spark.createDataFrame(grades, "query_id string, doc_id string, rel int")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_grades_of_short_lists_do_not_move_the_judgments(spark, judged, tmp_path):
    rankings, qrels = judged
    qrels.write.parquet(str(tmp_path / "qrels"))
    stored = spark.read.parquet(str(tmp_path / "qrels"))
    assert rows(with_grades(rankings, stored, True)) == rows(with_grades(rankings, qrels))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        text = with_grades(rankings, stored, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "BroadcastHashJoin" in text and "LeftSemi" in text


def test_metrics_and_result_rows_with_short_lists(spark, judged):
    rankings, qrels = judged
    queries = spark.createDataFrame([("q",), ("p",), (None,)], "query_id string").withColumn("text", F.col("query_id"))
    few, many = (metrics.per_query(rankings, queries, qrels, ["m", "n"], small=s) for s in (True, False))
    assert rows(few) == rows(many)
    assert rows(result_rows(rankings, queries, qrels, True)) == rows(result_rows(rankings, queries, qrels))


def test_counts_of_grades_move_numbers_and_count_null_and_repeated_keys(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    parts = [(1, "hot ring", "B#1", "LARGE"), (1, "hot ring", "B#1", "LARGE"), (2, "hot bolt", "B#1", "LARGE")]
    parts += [(3, "bolt", None, "SMALL"), (4, "ring", "B#2", None), (5, "unasked", "B#9", "SMALL"), (None, "x", "B#7", "BIG")]
    parts_schema = "p_partkey long, p_name string, p_brand string, p_type string"
    spark.createDataFrame(parts, parts_schema).write.parquet(f"{folder}/part.parquet")
    lines = [(1, 1, 10, 1), (1, 2, 10, 2), (2, 1, 10, 2), (2, 3, None, 1), (3, 1, 10, 3), (4, 2, 10, 4), (5, 2, 11, 4)]
    lines += [(6, None, 12, 1), (7, 1, 13, None), (8, 1, 13, 99)]
    lines = [(o, n, p, s, 1.0, "A") for o, n, p, s in lines]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string"
    ).write.parquet(f"{folder}/lineitem.parquet")
    written, write = [], inputs.materialize
    monkeypatch.setattr(inputs, "materialize", lambda df, label="table": written.append(label) or write(df, label))
    shop, plain = Shop(spark, folder), inputs.qrels(spark, folder)
    assert rows(shop.grades) == rows(metrics.grade_counts(plain)) and len(rows(plain)) == 5
    assert rows(shop.qrels) == rows(plain)
    asked = inputs.judgments(spark, folder).select(F.col("query").alias("query_id")).distinct()
    assert rows(shop.queries.df.select("query_id")) == rows(asked)
    assert "grades" in written and "qrels" not in written  # the judgments are not written once more


def test_listed_products_are_told_by_key_before_judgments_get_texts(spark, tmp_path):
    folder = str(tmp_path)
    parts = [(1, "hot ring", "B#1", "LARGE"), (2, "hot bolt", "B#2", "LARGE"), (None, "x", "B#7", "BIG")]
    spark.createDataFrame(
        parts, "p_partkey long, p_name string, p_brand string, p_type string"
    ).write.parquet(f"{folder}/part.parquet")
    lines = [(1, 10, 1), (2, 10, 1), (3, 10, 2), (3, 11, 1), (2, None, 1), (1, 12, 2), (2, 12, None)]
    spark.createDataFrame(lines, "l_linenumber int, l_partkey long, l_suppkey long").write.parquet(
        f"{folder}/lineitem.parquet"
    )
    listed = spark.createDataFrame([("10",), ("10",), ("13",), (None,), ("no key",)], "doc_id string")
    shop = Shop(spark, folder)
    found = shop.qrels_of(listed, 10)
    assert rows(found) == rows(shop.qrels.filter("doc_id = '10'")) and found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi, (l_partkey") > plan.index("Join Inner")
    shop.queries.limit = 0
    assert rows(shop.qrels_of(listed, 10)) == rows(shop.qrels)
