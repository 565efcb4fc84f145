"""Commits, buckets and merges of the pair-score store."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import token_cosine
from rankloom.sources import scores
from rankloom.sources.scores import ScoreStore

PAIRS = "query_text string, doc_id string, doc_text string"


@pytest.fixture
def store(spark, tmp_path):
    return ScoreStore(spark, str(tmp_path / "scores"), "overlap")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(f"q{i % 5}", f"d{i}", f"text {i} q{i % 5}") for i in range(40)], PAIRS)


def found(df):
    return sorted((r["query_text"], r["doc_id"], r["ce_score"]) for r in df.collect())


def test_merged_commits_hold_the_same_scores(spark, store, pairs, monkeypatch):
    want = found(pairs.withColumn("ce_score", token_cosine(F.col("query_text"), F.col("doc_text"))))
    assert found(store.scores(pairs, token_cosine, chunks=4)) == want
    before = store.commits()
    assert len(before) == 4
    store.merge()
    assert len(store.commits()) == 1 and found(store.lookup(pairs)) == want
    assert all(Path(x).exists() for x in before)  # for readers that still use them
    assert store.sweep() == before and not any(Path(x).exists() for x in before)
    assert found(store.lookup(pairs)) == want
    monkeypatch.setattr(scores, "MERGE_AFTER", 0)
    more = spark.createDataFrame([("q9", "d9", "text q9")], PAIRS)
    assert store.score_missing(more, token_cosine).new_pairs == 1
    assert store.score_missing(more, token_cosine).reused_pairs == 1 and len(store.commits()) == 1


def test_a_chunk_that_was_cut_short_does_not_count(spark, store, pairs, monkeypatch):
    store.score_missing(pairs.limit(10), token_cosine)
    written = store.read().count()

    def lost(*args, **kwargs):
        raise OSError("lost")

    monkeypatch.setattr(type(spark), "createDataFrame", lost)  # between the data and the entry
    with pytest.raises(OSError):
        store.score_missing(pairs, token_cosine)
    monkeypatch.undo()
    assert store.read().count() == written and len(store.commits()) == 1
    assert store.score_missing(pairs, token_cosine).new_pairs == 40 - written
    assert store.read().count() == 40


def test_a_look_up_reads_its_buckets_only(spark, store, pairs):
    store.score_missing(pairs, token_cosine)
    plan = store.lookup(pairs.limit(1))._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters and filters.count(",") <= 1
    other = ScoreStore(spark, store.path, "other model")
    assert other.read() is None and other.commits() == [] and other.sweep() == []
