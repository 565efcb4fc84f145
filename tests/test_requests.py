import datetime
import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import token_cosine
from rankloom.functions.vectors import letter_vector
from rankloom.operators import search
from rankloom.operators.features import FEATURES
from rankloom.operators.forest import Forest, Tree
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.schema import LOG_RECORD, REQUESTS
from rankloom.sources import reports, tables
from rankloom.sources.scores import ScoreStore
from rankloom.streaming.monitor import read_log, windowed
from rankloom.streaming.requests import read_requests, serve

GOODS = [
    ("g1", "Oak desk", "Nordwood", "brown", "Oak desk with two drawers"),
    ("g2", "Pine shelf", "Nordwood", "white", "Pine shelf for books"),
    ("g3", "Desk lamp", "Lumo", "black", "Lamp for the desk with a metal arm"),
    ("g4", "Wool rug", "Weft", "red", "Soft rug of pure wool"),
    ("g5", "Oak chair", "Nordwood", "brown", "Chair of solid oak"),
]


@pytest.fixture(scope="module")
def index(spark):
    goods = spark.createDataFrame(GOODS, "doc_id string, title string, brand string, color string, text string")
    by_pair_score = Tree([0, -1, -1], [0.3, 0, 0], [1, -1, -1], [2, -1, -1], [0, -0.5, 0.75], [1.0, 0, 0])
    return search.SearchIndex(
        catalog=goods,
        text_index=TextIndex.build(goods),
        tfidf_index=TfidfIndex.fit(goods),
        vectors=goods.select("doc_id", letter_vector(F.col("text")).alias("vec")),
        encode=lambda df: df.withColumn("vec", letter_vector(F.col("text"))),
        scorer=token_cosine,
        forest=Forest([by_pair_score], FEATURES),
    )


def requests(spark, *rows):
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], REQUESTS)


@pytest.mark.parametrize(
    "row, error",
    [
        (("   ", "bm25", None, None, None, None), "empty_query"),
        ((None, "bm25", None, None, None, None), "empty_query"),
        (("x" * 5000, "bm25", None, None, None, None), "query_too_long"),
        (("desk", "bm25", 0, None, None, None), "invalid_parameter"),
        (("desk", "bm25", 100000, None, None, None), "invalid_parameter"),
        (("desk", "magic", None, None, None, None), "unsupported_method"),
        (("desk", "hybrid", None, -0.5, None, None), "invalid_parameter"),
        (("desk", "hybrid", None, None, 1.5, None), "invalid_parameter"),
        (("desk", "rerank", None, None, None, 100000), "invalid_parameter"),
        (("desk", "ltr", None, None, None, 0), "invalid_parameter"),
        (("  padded desk  ", " LTR ", 3, None, None, 5), None),
    ],
)
def test_validation(spark, row, error):
    got = search.validate(requests(spark, row)).first()
    assert got["error"] == error
    if error is None:
        assert (got["query"], got["method"], got["top_k"], got["candidate_depth"]) == ("padded desk", "ltr", 3, 5)


def test_all_six_methods(spark, index):
    asked = requests(spark, *[("oak desk", m, 3, None, None, 4) for m in index.options.methods])
    asked = search.accepted(search.validate(asked))
    rows = search.responses(asked, search.items(search.answer(asked, index), index.catalog)).collect()
    assert len(rows) == 6
    for row in rows:
        items = row["results"]
        assert [i["rank"] for i in items] == list(range(1, row["count"] + 1)) and 1 <= row["count"] <= 3
        assert all(0 <= i["confidence"] <= 1 and i["title"] for i in items)
        if row["ranking_method"] != "embedding":
            assert items[0]["product_id"] == "g1", row


def test_equal_queries_with_different_settings(spark, index):
    asked = requests(
        spark,
        ("oak desk", "hybrid", 2, 1.0, 0.0, None),
        ("oak desk", "hybrid", 4, 0.0, 1.0, None),
        ("oak desk", "rerank", 10, None, None, 2),
        ("oak desk", "rerank", 10, None, None, 5),
    )
    found = search.answer(search.accepted(search.validate(asked)), index)
    counts = {r["request_id"]: r["count"] for r in found.groupBy("request_id").count().collect()}
    # A second stage returns no more rows than its depth.
    assert counts == {0: 2, 1: 4, 2: 2, 3: 5}


def test_known_pair_scores_are_reused(spark, index, tmp_path):
    from dataclasses import replace

    store = ScoreStore(spark, str(tmp_path / "scores"), "test model")
    text = dict((g[0], g[4]) for g in GOODS)["g4"]
    pairs = spark.createDataFrame([("oak desk", "g4", text)], "query_text string, doc_id string, doc_text string")
    nine = lambda q, d: F.lit(9.0)
    assert store.score_missing(pairs, nine).new_pairs == 1
    again = store.score_missing(pairs, nine)
    assert (again.new_pairs, again.reused_pairs, again.pairs_per_second) == (0, 1, None)
    stored = spark.read.parquet(store.path)
    stored.write.mode("append").partitionBy("signature").parquet(store.path)  # a lost commit, run again
    asked = search.accepted(search.validate(requests(spark, ("oak desk", "rerank", 5, None, None, 5))))
    got = search.answer(asked, replace(index, known_scores=store)).orderBy("rank").collect()
    assert got[0]["doc_id"] == "g4" and got[0]["score"] == 9.0 and len(got) == 5


def test_awkward_requests_are_rejected_alone(spark, index):
    from dataclasses import replace

    rows = [(1, "oak desk", "bm25"), (1, "wool rug", "bm25"), (None, "oak", "bm25"), (2, "oak desk", "ltr"), (3, "oak desk", "rerank"), (4, "oak desk", "bm25")]
    asked = spark.createDataFrame([(*r, None, None, None, None) for r in rows], REQUESTS)
    bare = replace(index, scorer=None, forest=None)
    checked = search.validate(asked, bare.options, bare.ready)
    errors = sorted((r["request_id"] or 0, r["error"]) for r in search.rejected(checked).collect())
    assert errors == [(0, "missing_request_id"), (1, "repeated_request_id"), (1, "repeated_request_id"), (2, "not_ready"), (3, "not_ready")]
    got = search.answer(search.accepted(checked), bare)
    assert {r["request_id"] for r in got.collect()} == {4}
    # Unchecked requests for a method without its model get no rows; the others are answered.
    loose = search.answer(search.accepted(search.validate(asked)), bare)
    assert {r["request_id"] for r in loose.collect()} == {4}
    only_forest_missing = replace(index, forest=None)
    assert "rerank" in only_forest_missing.ready and "ltr" not in only_forest_missing.ready


def test_popular_query_is_delivered_to_everyone(spark, index):
    asked = spark.createDataFrame([(i, "oak desk" if i % 3 else f"oak {i}", "bm25", 2, None, None, None) for i in range(300)], REQUESTS)
    got = search.answer(search.accepted(search.validate(asked)), index)
    assert got.filter("rank = 1").count() == 300


def test_scratch_tables_are_deleted(spark, tmp_path):
    from pathlib import Path

    from rankloom.runtime import materialize, scratch

    with scratch(spark):
        path = materialize(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
        assert Path(path).exists()
    assert not Path(path).parent.exists()


def test_stored_postings_read_only_their_buckets(spark, index, tmp_path):
    index.text_index.write(str(tmp_path / "i"))
    stored = TextIndex.read(spark, str(tmp_path / "i"))
    found = stored.postings_of(spark.createDataFrame([("oak",)], "term string"))
    plan = found._jdf.queryExecution().toString()
    assert "term_bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "IN" in plan.upper()
    assert {r["doc_id"] for r in found.collect()} == {"g1", "g5"}


def test_request_stream_equals_the_batch(spark, index, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("oak desk", "bm25"), ("wool", "tfidf"), ("", "bm25"), ("pine shelf", "hybrid")]
    for i, (query, method) in enumerate(rows):
        (source / f"{i}.json").write_text(json.dumps({"request_id": i, "query": query, "method": method}) + "\n")
    out = str(tmp_path / "out")
    stream = read_requests(spark, str(source), files_per_batch=2)
    serve(stream, index, out, str(tmp_path / "state"), once=True).awaitTermination()
    answers = spark.read.parquet(f"{out}/answers")
    batch = search.accepted(search.validate(spark.read.schema(REQUESTS).json(str(source))))
    want = search.items(search.answer(batch, index), index.catalog)
    assert answers.select(want.columns).exceptAll(want).isEmpty() and answers.count() == want.count()
    assert answers.select("batch_id").distinct().count() == 2
    assert [r["request_id"] for r in spark.read.parquet(f"{out}/rejected").collect()] == [2]


def test_log_stream_drops_late_rows(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()

    def write(name, *rows):
        lines = [{"time": t, "path": "/s", "latency_ms": ms, "status_code": code} for t, ms, code in rows]
        (source / name).write_text("".join(json.dumps(x) + "\n" for x in lines))

    def run():
        query = (
            windowed(read_log(spark, str(source)))
            .writeStream.format("parquet")
            .outputMode("append")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    write("1.json", ("2024-01-01T00:00:10", 10.0, 200), ("2024-01-01T00:00:40", 30.0, 503), ("2024-01-01T00:30:00", 5.0, 200))
    run()
    write("2.json", ("2024-01-01T00:00:50", 99.0, 200), ("2024-01-01T01:30:00", 1.0, 200))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    first = rows[0]
    assert first["window_start"] == datetime.datetime(2024, 1, 1, 0, 0)
    assert (first["requests"], first["mean_ms"], first["max_ms"], first["errors"]) == (2, 20.0, 30.0, 1)
    assert [r["requests"] for r in rows[1:]] == [1]
    assert LOG_RECORD is not None


def test_report_numbers(spark, tmp_path):
    (tmp_path / "r.txt").write_text(
        "| bm25 | cold | 90.0 | 1.0 |\n| bm25 | cold | 120.50 | 118.00 |\n| bm25 | warm | 0.03 | 0.03 |\n"
        "Average rerank time (cold): 2100.5 ms\nAverage rerank time (cold): 9000 ms\nRSS peak during load: 2,100 MB\nCorpus indexed : 48,114\n~ 4,000x faster\n"
    )
    lines = reports.read_lines(spark, str(tmp_path / "r.txt"))
    row = reports.latency_table(lines).first()
    assert (row["method"], row["cold"], row["warm"]) == ("bm25", 120.5, 0.03)
    got = {r["name"]: r["value"] for r in reports.numbers(lines).collect()}
    assert got["rerank"] == 2100.5 and got["corpus"] == 48114 and got["cache_speedup_x"] == 4000


def test_tables_are_read_checked_and_written(spark, tmp_path):
    with pytest.raises(tables.TableNotFound):
        tables.read_parquet(spark, str(tmp_path / "nothing"))
    sample = spark.createDataFrame([("q", "p", "t", 3)], "query string, product_id string, product_text string, relevance_score int")
    tables.write_sample(sample, str(tmp_path / "sample"))
    assert tables.read_sample(spark, str(tmp_path / "sample")).count() == 1
    tables.write_sample(sample.drop("product_text"), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_sample(spark, str(tmp_path / "bad"))
    quoted = spark.createDataFrame([('say "hi", twice', "b", "", 1), ("a", "p", "t", 3)], sample.schema)
    tables.write_preview(quoted, str(tmp_path / "preview"), "query", 1)
    assert tables.read_csv(spark, str(tmp_path / "preview"), sample.schema).first()["query"] == "a"
    tables.write_results(quoted, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"), sample.schema)
    assert {r["query"] for r in back.collect()} == {'say "hi", twice', "a"}
