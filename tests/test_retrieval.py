import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, dense, hybrid, tfidf
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.runtime import QuerySet

WORDS = "oak elm fir ash yew bay fig gum the the the tea sap log".split()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))) for i in range(60)]
    docs += [(60, ""), (61, "quartz")]
    queries = [(0, "the oak oak"), (1, "fig tea log"), (2, "absent"), (3, "quartz the")]
    return docs, queries


@pytest.fixture(scope="module")
def tables(spark, texts):
    docs, queries = texts
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(queries, "query_id long, text string"),
    )


def triples(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def best(scored, k):
    rows = []
    for query, pairs in scored.items():
        order = sorted(pairs.items(), key=lambda p: (-round(p[1], 9), p[0]))[:k]
        rows += [(query, i + 1, d, round(s, 9)) for i, (d, s) in enumerate(order)]
    return sorted(rows)


def brute_bm25(docs, queries):
    bags = {d: Counter(t.split()) for d, t in docs}
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    out = {}
    for q, text in queries:
        out[q] = {}
        for d, bag in bags.items():
            hits = [w for w in text.split() if w in bag]
            if hits:
                dl = sum(bag.values())
                out[q][d] = sum(
                    idf[w] * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * dl / mean)) for w in hits
                )
    return out


def test_bm25_equals_direct_evaluation(tables, texts):
    docs, queries = tables
    got = triples(bm25.retrieve(QuerySet(queries), TextIndex.build(docs), 10))
    assert got == best(brute_bm25(*texts), 10)


def test_bm25_many_query_path_and_stored_index_agree(spark, tables, tmp_path):
    docs, queries = tables
    index = TextIndex.build(docs)
    want = triples(bm25.retrieve(QuerySet(queries), index, 10))
    assert triples(bm25.retrieve(QuerySet(queries, limit=0), index, 10)) == want
    index.write(str(tmp_path / "index"))
    stored = TextIndex.read(spark, str(tmp_path / "index"))
    assert triples(bm25.retrieve(QuerySet(queries), stored, 10)) == want


def test_hot_terms_are_cut_without_changing_scores(tables, texts, monkeypatch):
    from rankloom.operators import textindex

    monkeypatch.setattr(textindex, "HOT_TERM_ROWS", 5)
    docs, queries = tables
    got = triples(bm25.retrieve(QuerySet(queries, limit=0), TextIndex.build(docs), 10))
    assert got == best(brute_bm25(*texts), 10)


def test_fill_completes_short_lists(tables):
    docs, queries = tables
    got = bm25.retrieve(QuerySet(queries), TextIndex.build(docs), 5, fill=docs).collect()
    by_query = {q: sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q) for q in range(4)}
    assert all([r for r, _, _ in rows] == [1, 2, 3, 4, 5] for rows in by_query.values())
    assert [(d, s) for _, d, s in by_query[2]] == [(i, 0.0) for i in range(5)]


def test_equal_document_frequencies_give_zero_scores(spark):
    docs = spark.createDataFrame(
        [("a", "grey wool coat"), ("b", "grey wool scarf knitted"), ("c", "tin box"), ("d", "iron pan")],
        "doc_id string, text string",
    )
    queries = spark.createDataFrame([(1, "grey wool"), (2, "grey scarf")], "query_id int, text string")
    got = triples(bm25.retrieve(QuerySet(queries), TextIndex.build(docs), 3))
    assert [(r, d, s) for q, r, d, s in got if q == 1] == [(1, "a", 0.0), (2, "b", 0.0)]
    assert [d for q, r, d, s in got if q == 2 and r == 1] == ["b"]


def test_tfidf_equals_direct_evaluation(tables, texts):
    docs, queries = texts

    def grams(text):
        w = text.split()
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    limit = 30
    bags = {d: Counter(grams(t)) for d, t in docs}
    total = Counter()
    for bag in bags.values():
        total.update(bag)
    vocabulary = {w for w, _ in sorted(total.items(), key=lambda p: (-p[1], p[0]))[:limit]}
    df = Counter(w for b in bags.values() for w in b if w in vocabulary)
    idf = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in df.items()}

    def unit(bag):
        w = {t: c * idf[t] for t, c in bag.items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}

    rows = {d: unit(b) for d, b in bags.items()}
    scored = {}
    for q, text in queries:
        asked = unit(Counter(grams(text)))
        scored[q] = {
            d: sum(asked[t] * row[t] for t in asked if t in row)
            for d, row in rows.items()
            if set(asked) & set(row)
        }
    fitted = TfidfIndex.fit(tables[0], limit)
    assert triples(tfidf.retrieve(QuerySet(tables[1]), fitted, 10)) == best(scored, 10)
    assert triples(tfidf.retrieve(QuerySet(tables[1], limit=0), fitted, 10)) == best(scored, 10)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_dense_search_is_exact_on_both_paths(spark, ids):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 6)).round(3)
    vecs = np.concatenate([base, base[:10]])  # equal vectors tie
    key = (lambda i: i) if ids == "long" else (lambda i: f"d{i:03}")
    docs = spark.createDataFrame([(key(i), v.tolist()) for i, v in enumerate(vecs)], f"doc_id {ids}, vec array<double>")
    asked = rng.normal(size=(5, 6)).round(3)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, vec array<double>")
    scored = {q: {key(i): float(v @ asked[q]) for i, v in enumerate(vecs)} for q in range(5)}
    assert triples(dense.retrieve(QuerySet(queries), docs.repartition(3), 7)) == best(scored, 7)
    assert triples(dense.retrieve(QuerySet(queries, limit=100), docs, 7)) == best(scored, 7)


@pytest.fixture(scope="module")
def pool(spark, tables):
    docs, queries = tables
    rng = np.random.default_rng(5)
    vecs = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(62)], "doc_id long, vec array<double>")
    asked = queries.join(
        spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(4)], "query_id long, vec array<double>"),
        "query_id",
    )
    return hybrid.candidates(QuerySet(asked), TextIndex.build(docs), vecs, pool=12).persist()


def test_pool_is_the_union_with_both_scores(pool, texts):
    rows = pool.collect()
    exact = brute_bm25(*texts)
    for r in rows:
        assert r["bm25"] == pytest.approx(exact[r["query_id"]].get(r["doc_id"], 0.0))
        assert 0 <= r["bm25_norm"] <= 1 and 0 <= r["emb_norm"] <= 1
        assert r["bm25_rank"] is not None or r["emb_rank"] is not None
    assert len({(r["query_id"], r["doc_id"]) for r in rows}) == len(rows)


def test_one_sided_weights_give_the_pure_order(pool):
    lexical = triples(hybrid.pure(pool, "bm25", 5))
    fused = triples(hybrid.fuse(pool, 1.0, 0.0, 5))
    with_hits = {q for q, *_ in lexical if q != 2}
    for q in with_hits:
        want = [d for x, _, d, s in lexical if x == q and s > 0][:5]
        assert [d for x, _, d, _ in fused if x == q][: len(want)] == want


def test_sweep_matches_single_fusions(pool):
    swept = hybrid.sweep(pool, k=5).collect()
    for i, (a, b) in enumerate(hybrid.WEIGHT_GRID):
        mine = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in swept if r["method"] == str(i))
        assert mine == triples(hybrid.fuse(pool, a, b, 5))


def test_top_k_is_cut_before_the_shuffle_and_stays_in_the_jvm(tables):
    docs, queries = tables
    plan = bm25.retrieve(QuerySet(queries), TextIndex.build(docs), 10)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") >= 2
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert F is not None


def test_a_block_of_scores_stays_small():
    """However many queries there are, a task holds few scores at once."""
    rng = np.random.default_rng(1)
    docs, asked = rng.normal(size=(10_000, 8)), rng.normal(size=(2_000, 8))
    tracemalloc.start()
    rows = sum(len(q) for q, _, _ in dense._best_of_block(np.arange(10_000), docs, np.arange(2_000), asked, 10))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 20_000 and peak < 60_000_000


def test_later_blocks_hand_on_only_scores_that_reach_the_kth():
    rng = np.random.default_rng(9)
    vecs, asked, k = rng.integers(-3, 4, (600, 5)).astype(float), rng.integers(-3, 4, (20, 5)).astype(float), 4
    kept, least, rows = dense.Kept(20, k), np.full(20, -np.inf), []
    for at in range(0, 600, 50):
        block = dense._best_of_block(np.arange(at, at + 50), vecs[at : at + 50], np.arange(20), asked, k, kept, least)
        rows += [row for part in block for row in zip(*(x.tolist() for x in part))]
    assert len(rows) < 12 * 20 * k  # as many as every block for itself would give
    scores = asked @ vecs.T
    for q in range(20):
        best = sorted((-s, d) for query, d, s in rows if query == q)[:k]
        assert best == sorted((-s, d) for d, s in enumerate(scores[q].tolist()))[:k]
