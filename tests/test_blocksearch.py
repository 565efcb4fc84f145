"""Many queries over a forward index give the rows of the path for few, without moving pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import blocksearch, bm25, tfidf
from rankloom.operators.blocksearch import Block, Slice
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.runtime import QuerySet

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 30 + ["of"] * 15


def made(seed, n, most=30):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, k=rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module", params=["long", "string"])
def tables(request, spark):
    key = (lambda i: i) if request.param == "long" else (lambda i: f"é{i:04}")
    texts = made(1, 250)
    texts[10:40] = [texts[10]] * 30  # equal documents tie
    docs = spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], f"doc_id {request.param}, text string")
    asked = [(i, t) for i, t in enumerate(made(2, 60, 6))] + [(98, "absent"), (99, None)]
    return docs.repartition(3).persist(), spark.createDataFrame(asked, "query_id long, text string").persist()


def triples(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


@pytest.mark.parametrize("limit", [0, 20_000])
def test_bm25(tables, limit):
    docs, queries = tables
    index = TextIndex.build(docs)
    want = triples(bm25.retrieve(QuerySet(queries), index, 7))
    assert triples(bm25.retrieve(QuerySet(queries, limit=limit), index, 7)) == want


def test_stored_forward_index(spark, tables, tmp_path):
    docs, queries = tables
    index = TextIndex.build(docs)
    want = triples(bm25.retrieve(QuerySet(queries), index, 7))
    for forward in (True, False):
        path = str(tmp_path / str(forward))
        index.write(path, forward=forward)
        stored = TextIndex.read(spark, path)
        assert (stored.rows is not None) == forward
        assert triples(bm25.retrieve(QuerySet(queries, limit=20_000), stored, 7)) == want


def test_tfidf_in_both_layouts(spark, tables, tmp_path):
    docs, queries = tables
    index = TfidfIndex.fit(docs, 200)
    want = triples(tfidf.retrieve(QuerySet(queries), index, 7))
    assert triples(tfidf.retrieve(QuerySet(queries, limit=20_000), index, 7)) == want
    index.write(str(tmp_path / "tfidf"))
    stored = TfidfIndex.read(spark, str(tmp_path / "tfidf"))
    for limit in (20_000, 10**9):
        assert triples(tfidf.retrieve(QuerySet(queries, limit=limit), stored, 7)) == want


def test_weights_of_a_large_vocabulary(tables, monkeypatch):
    docs, queries = tables
    want = triples(tfidf.retrieve(QuerySet(queries), TfidfIndex.fit(docs, 200), 7))
    monkeypatch.setattr(tfidf, "BROADCAST_TERMS", 10)
    assert triples(tfidf.retrieve(QuerySet(queries), TfidfIndex.fit(docs, 200), 7)) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairs_and_no_texts_cross_an_exchange(spark, tables, tmp_path):
    docs, queries = tables
    text = plan(bm25.retrieve(QuerySet(queries, limit=0), TextIndex.build(docs), 7))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == text.count("hashpartitioning(query_id")
    TfidfIndex.fit(docs, 200).write(str(tmp_path / "tfidf"))
    index = TfidfIndex.read(spark, str(tmp_path / "tfidf"))
    few = plan(tfidf.retrieve(QuerySet(queries), index, 7))
    assert "PartitionFilters: [term_bucket" in few and "text:string" not in few.split("FileScan")[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    assert bm25.retrieve(QuerySet(queries, limit=0), TextIndex.build(docs), 5).count() == 0
    assert tfidf.retrieve(QuerySet(queries, limit=0), TfidfIndex.fit(docs), 5).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = queries.limit(0)
    assert bm25.retrieve(QuerySet(none, limit=0), TextIndex.build(some), 5).count() == 0


def value(amount, dl):
    return amount / (1.0 + dl)


def test_bounds_skip_queries_without_changing_the_best(monkeypatch):
    rng = np.random.default_rng(5)
    table = pa.table(
        {
            "query_id": [q for q in range(50) for _ in range(4)],
            "term": [f"w{rng.integers(40)}" for _ in range(200)],
            "weight": rng.normal(1.0, 1.0, 200),
        }
    )
    asked = Slice.of(table)
    scored = []
    monkeypatch.setattr(Block, "_scored", (lambda f: lambda self, q, *a: scored.append(len(q)) or f(self, q, *a))(Block._scored))
    docs = [(i, t.split()) for i, t in enumerate(made(3, 600, 200))]
    docs.sort(key=lambda x: len(x[1]))  # short documents have the large values
    least, best = np.full(50, -np.inf), {}
    for start in range(0, 600, 50):
        part = docs[start : start + 50]
        batch = pa.record_batch(
            {"doc_id": [i for i, _ in part], "dl": pa.array([len(t) for _, t in part], pa.int32()), "terms": [t for _, t in part]}
        )
        block = Block.of(batch, asked.vocabulary, value)
        for q, place, score in block.best(asked, least, 5):
            for a, b, c in zip(q, block.ids.take(pa.array(place)).to_pylist(), score):
                best.setdefault(asked.ids[int(a)].as_py(), []).append((-np.rint(c * 1e9), b))
    assert sum(scored) < 0.8 * 50 * 12
    weights = {}
    for q, t, w in zip(*(table.column(c).to_pylist() for c in table.column_names)):
        weights.setdefault(q, []).append((t, w))
    for q, pairs in weights.items():
        want = []
        for i, t in docs:
            hits = [(w, t.count(x)) for x, w in pairs if x in t]
            if hits:
                want.append((-np.rint(sum(w * n / (1 + len(t)) for w, n in hits) * 1e9), i))
        assert [i for _, i in sorted(best[q])[:5]] == [i for _, i in sorted(want)[:5]]


def test_slices_follow_the_written_weights(spark):
    """Ten long texts that repeat two words have twenty weights: one slice, not one per query."""
    queries = QuerySet(spark.createDataFrame([(i, "the of " * 500) for i in range(10)], "query_id long, text string"), limit=2000)
    assert queries.term_slices == 10
    index = TextIndex.build(spark.createDataFrame([(1, "the x"), (2, "of y"), (3, "z")], "doc_id long, text string"))
    assert blocksearch._slices(bm25._weights(queries, index), queries) == 1


def test_pair_scores_do_not_multiply_postings(spark, tables, tmp_path):
    docs, queries = tables
    index = TextIndex.build(docs)
    index.write(str(tmp_path / "pairs"), forward=True)
    stored = TextIndex.read(spark, str(tmp_path / "pairs"))
    some = docs.select("doc_id").orderBy("doc_id").limit(60)
    unknown = some.limit(1).withColumn("doc_id", F.lit("-7").cast(docs.schema["doc_id"].dataType))
    pairs = queries.select("query_id").crossJoin(some.union(unknown)).withColumn("note", F.lit("é"))
    few = QuerySet(queries)

    def rows(df):
        assert df.columns == ["query_id", "doc_id", "note", "score"]
        return sorted((r[0], r[1], r[2], round(r[3], 9)) for r in df.collect())

    want = rows(bm25.pair_scores(pairs, few, stored))  # from the term buckets
    assert len(want) == 62 * 61 and any(r[3] for r in want)
    for known, asked in ((index, few), (stored, QuerySet(queries, limit=2_000))):
        found = bm25.pair_scores(pairs, asked, known)
        assert rows(found) == want
        assert "term" not in found.columns and "Generate explode(terms" not in plan(found)


def test_repeated_ids_are_summed_as_before(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a c"), (3, "d")], "doc_id long, text string")
    queries = QuerySet(spark.createDataFrame([(1, "a")], "query_id long, text string"))
    assert [r["doc_id"] for r in bm25.retrieve(queries, TextIndex.build(docs), 5).orderBy("rank").collect()] == [1, 2]
