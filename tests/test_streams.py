"""Streams: every id once, new index versions between batches, scratch tables per thread."""

import json
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import token_cosine
from rankloom.functions.vectors import letter_vector
from rankloom.operators import search
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.runtime import materialize, scratch
from rankloom.sources.versions import Versions
from rankloom.streaming.requests import read_requests, serve

GOODS = "doc_id string, title string, brand string, color string, text string"


def encode(df):
    return df.withColumn("vec", letter_vector(F.col("text")))


def index_of(spark, *rows):
    goods = spark.createDataFrame([(i, t, "b", "c", t) for i, t in rows], GOODS)
    return search.SearchIndex(
        catalog=goods,
        text_index=TextIndex.build(goods),
        tfidf_index=TfidfIndex.fit(goods),
        vectors=goods.select("doc_id", letter_vector(F.col("text")).alias("vec")),
        encode=encode,
        scorer=token_cosine,
    )


def send(folder, name, *requests):
    lines = [json.dumps({"request_id": i, "query": q, "method": "bm25"}) for i, q in requests]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_ids_are_answered_once_and_versions_change_between_batches(spark, tmp_path):
    source, versions = tmp_path / "in", Versions(spark, str(tmp_path / "index"))
    source.mkdir()
    with pytest.raises(LookupError):
        versions.current()

    def current():
        return search.SearchIndex.read(spark, versions.current(), encode, scorer=token_cosine)

    def run():
        stream = read_requests(spark, str(source))
        serve(stream, current, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out" / "answers")).collect()
        return sorted((r["request_id"], r["title"]) for r in rows)

    assert versions.publish(index_of(spark, ("a", "oak desk"), ("b", "pine shelf")).write) == 1
    send(source, "1.json", (1, "oak"), (2, "pine"), (2, "pine"), (None, "oak"), (None, "oak"))
    first = [(1, "oak desk"), (2, "pine shelf")]
    assert run() == first
    served = versions.current()
    assert versions.publish(index_of(spark, ("a", "old oak"), ("c", "oak bed")).write) == 2
    assert Path(served).exists()  # its readers are not disturbed
    send(source, "2.json", (1, "oak"), (3, "bed"), (2, "shelf"))
    assert run() == first + [(3, "oak bed")]
    rejected = spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()
    assert [(r["request_id"], r["error"]) for r in rejected] == [(None, "missing_request_id")]

    versions.publish(index_of(spark, ("d", "elm")).write)
    assert versions.retire(keep=2) == [1] and not Path(served).exists()
    assert current().catalog.first()["title"] == "elm"


def test_a_version_that_was_cut_short_is_not_read(spark, tmp_path):
    versions = Versions(spark, str(tmp_path))
    versions.publish(lambda path: spark.range(1).write.parquet(path))
    good = versions.current()

    def fails(path):
        spark.range(2).write.parquet(path)
        raise OSError("lost")

    with pytest.raises(OSError):
        versions.publish(fails)
    assert versions.current() == good


def test_threads_do_not_delete_each_others_tables(spark):
    inside, written, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.append(materialize(spark.range(5), "other"))
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with scratch(spark):
        own = materialize(spark.range(3), "own").inputFiles()[0].removeprefix("file://")
        inside.set()
        written.wait(60)
    thread.join()
    assert not Path(own).exists() and kept[0].count() == 5
