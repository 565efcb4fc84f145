"""Rules for scale: no one-task sorts, measured broadcasts, NULL groups, bounded folders."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom import runtime
from rankloom.functions.text import preview
from rankloom.operators import dense, monitor, tfidf
from rankloom.runtime import QuerySet
from rankloom.sources import reports
from rankloom.streaming.monitor import windowed


def test_a_cluster_session_without_a_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_scans_are_not_moved_without_the_setting(spark):
    scan = spark.range(5)
    assert runtime.spread(scan, "id") is scan
    spark.conf.set("spark.rankloom.scanPartitions", "3")
    try:
        assert "Exchange" in runtime.spread(scan, "id")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.rankloom.scanPartitions")


def log(spark, n=4000):
    rng = random.Random(5)
    rows = [
        (rng.choice(["a", "b", None]), rng.choice(["cold", None]), None if rng.random() < 0.05 else float(rng.randrange(50)))
        for _ in range(n)
    ]
    return rows, spark.createDataFrame(rows, "method string, phase string, latency_ms double")


def exact(values):
    values, n = sorted(values), len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_medians_of_null_groups_and_narrow_bands(spark, accuracy):
    rows, df = log(spark)
    groups = {}
    for method, phase, ms in rows:
        if ms is not None:
            groups.setdefault((method, phase), []).append(ms)
    got = monitor.exact_medians(df, ("method", "phase"), "latency_ms", accuracy).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {k: exact(v) for k, v in groups.items()}


def test_latency_report_keeps_null_groups(spark):
    rows, df = log(spark)
    got = monitor.latency(df).collect()
    assert len(got) == len({r[:2] for r in rows})
    assert all(r["median_ms"] is not None for r in got)


def test_median_log_is_not_shuffled_by_group(spark):
    _, df = log(spark)
    bounds = spark.createDataFrame([("a", None, 1)], "method string, phase string, n int")
    plan = monitor._matched(df, bounds, ("method", "phase"), "inner")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("n", [0, 1, 7, 50, 99, 100, 500])
def test_most_frequent_terms(spark, n):
    rng = random.Random(n)
    counted = {f"t{i:03d}": rng.randrange(1, 9) for i in range(100)}
    df = spark.createDataFrame(list(counted.items()), "term string, total long")
    want = sorted(counted, key=lambda t: (-counted[t], t))[:n]
    assert sorted(r["term"] for r in tfidf.most_frequent(df, n).collect()) == sorted(want)


def test_sliced_queries_find_the_same(spark):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(8)]
    queries = spark.createDataFrame([(i, vec()) for i in range(40)], "query_id long, vec array<double>")
    docs = spark.createDataFrame([(i, vec()) for i in range(300)], "doc_id long, vec array<double>")
    whole = sorted(map(tuple, dense.retrieve(QuerySet(queries), docs, 5).collect()))
    for limit in (0, 300, 1000):
        cut = sorted(map(tuple, dense.retrieve(QuerySet(queries, limit=limit), docs, 5).collect()))
        assert [x[:2] + x[3:] for x in cut] == [x[:2] + x[3:] for x in whole]
        assert all(abs(a[2] - b[2]) < 1e-12 for a, b in zip(cut, whole))


def test_long_query_texts_do_not_fit_a_broadcast(spark):
    long = spark.createDataFrame([(i, "word " * 1000) for i in range(20)], "query_id long, text string")
    assert not QuerySet(long, limit=50_000).texts_fit and QuerySet(long, limit=200_000).texts_fit
    by_text = long.select(F.col("text").alias("query_id"), "text")
    assert QuerySet(long, limit=50_000).rows_fit(1)
    assert not QuerySet(by_text, limit=50_000).rows_fit(1)


def test_p95_is_within_the_sketch_bounds(spark):
    rng = random.Random(4)
    values = [rng.expovariate(0.1) for _ in range(3000)]
    df = spark.createDataFrame([(v, "/s", 200) for v in values], "latency_ms double, path string, status_code int")
    row = windowed(df.withColumn("time", F.lit("2024-01-01").cast("timestamp")), "1 hour").first()
    values.sort()
    assert values[int(0.94 * 3000)] <= row["p95_ms"] <= values[int(0.96 * 3000)]


def test_preview_collapses_white_space(spark):
    row = spark.createDataFrame([("  a \n\t b  " + "c" * 80,), (None,)], "t string")
    assert [r[0] for r in row.select(preview(F.col("t"), 10)).collect()] == ["a b ccccc…", ""]


def test_first_and_last_numbers_of_reports(spark, tmp_path):
    lines = ["RSS peak during load : 5.0 MB", "noise", "RSS peak during load : 9.0 MB", "| x | warm | 7 |", "| x | warm | 3 |", "| x | hot | 1 |", "~ 1,200x faster than cold", "| y | cold | n/a |"]
    (tmp_path / "r.txt").write_text("\n".join(lines))
    read = reports.read_lines(spark, str(tmp_path / "r.txt"))
    found = {r["name"]: r["value"] for r in reports.numbers(read).collect()}
    assert found == {"rss_peak_mb": 5.0, "cache_speedup_x": 1200.0}
    assert [tuple(r) for r in reports.latency_table(read).collect()] == [("x", None, 3.0)]
    assert Counter(r["unit"] for r in reports.measures(read).collect()) == {"MB": 2, "x": 1}
