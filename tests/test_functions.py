import math
import re

import pytest
from pyspark.sql import functions as F

from rankloom.config import SearchOptions
from rankloom.functions import scores, text, vectors


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()
    return row["x"]


def test_tokens_split_like_python(spark):
    probe = "A b　C\x1cd  e\tf g\x85h\n"
    assert one(spark, text.tokens(F.col("t")), t=probe) == probe.lower().split()


def test_words_follow_the_unicode_word_rule(spark):
    probe = "Ab²c éx ﬁ_9 a Café x1 日本"
    want = [w for w in re.findall(r"\b\w\w+\b", probe.lower())]
    assert one(spark, text.words(F.col("t")), t=probe) == want


def test_missing_text_has_no_tokens(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(text.tokens(F.col("t")).alias("a"), text.words(F.col("t")).alias("b")).first()
    assert row["a"] == [] and row["b"] == []


def test_ngrams_are_the_same_exploded_and_as_array(spark):
    df = spark.createDataFrame([(1, ["x1", "y1", "z1"]), (2, ["solo"]), (3, [])], "id int, w array<string>")
    exploded = sorted((r[0], r[1]) for r in text.explode_ngrams(df, "w", "id").collect())
    arrays = df.select("id", text.ngram_array(F.col("w")).alias("g")).collect()
    assert exploded == sorted((r["id"], g) for r in arrays for g in r["g"])
    assert (1, "y1 z1") in exploded and len(exploded) == 6


def test_preview_cut_strip_squeeze(spark):
    assert one(spark, text.preview(F.col("t"), 5), t="abcdefgh") == "abcd…"
    assert one(spark, text.preview(F.col("t"), 5), t="abcde") == "abcde"
    assert one(spark, text.cut(F.col("t"), 3), t="abcdef") == "abc"
    assert one(spark, text.strip(F.col("t")), t="  a b \n") == "a b"
    assert one(spark, text.squeeze(F.col("t")), t="  a \n\t b　c ") == "a b c"


def test_unit_vector_and_products(spark):
    assert one(spark, vectors.unit_vector(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vectors.unit_vector(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], ["a", "b"])
    row = df.select(
        vectors.inner_product(F.col("a"), F.col("b")).alias("p"), vectors.cosine(F.col("a"), F.col("b")).alias("c")
    ).first()
    assert row["p"] == 11.0
    assert row["c"] == pytest.approx(11 / math.sqrt(125))


@pytest.mark.parametrize(
    "values, want",
    [([2.0, 4.0, 6.0], [0.0, 0.5, 1.0]), ([5.0, 5.0], [0.0, 0.0]), ([7.0], [0.0])],
)
def test_min_max(spark, values, want):
    df = spark.createDataFrame([("q", v) for v in values], ["query_id", "s"])
    got = df.select("s", scores.min_max("s").alias("x")).orderBy("s").collect()
    assert [r["x"] for r in got] == want


@pytest.mark.parametrize(
    "method, score, want",
    [
        ("ltr", 0.3608, 0.589234),
        ("rerank", 100.0, 1.0),
        ("bm25", 8.0, 0.5),
        ("bm25", -1.0, 0.0),
        ("hybrid", 1.3, 1.0),
        ("tfidf", -0.2, 0.0),
        ("embedding", 0.25, 0.25),
    ],
)
def test_confidence(spark, method, score, want):
    column = scores.confidence(F.col("s"), F.col("m"))
    assert one(spark, column, s=score, m=method) == pytest.approx(want, abs=5e-6)


@pytest.mark.parametrize("ms", [0.05, 12.25, 999.94, 1005.0, 1245.0, 2014.1])
def test_labels_round_like_python(spark, ms):
    want = f"{ms:.1f} ms" if ms < 1000 else f"{ms / 1000:.2f} s"
    assert one(spark, scores.duration_label(F.col("v")), v=ms) == want
    assert one(spark, scores.percent_label(F.col("v")), v=ms / 1000) == f"{ms / 1000 * 100:.1f}%"


@pytest.mark.parametrize(
    "wrong",
    [
        {"default_top_k": 200},
        {"candidate_depth": 101},
        {"alpha": 1.5},
        {"min_query_length": 300},
        {"bm25_saturation": 0.0},
    ],
)
def test_options_are_checked(wrong):
    with pytest.raises(ValueError):
        SearchOptions(**wrong)
