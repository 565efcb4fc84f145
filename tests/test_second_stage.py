import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.functions.text import token_cosine
from rankloom.operators import ltr
from rankloom.operators.features import FEATURES, MONOTONE, features
from rankloom.operators.forest import importance
from rankloom.operators.rerank import model_scorer, rerank
from rankloom.sources.models import load_forest, save_forest
from rankloom.sources.scores import ScoreStore
from rankloom.sources.vectors import ensure_vectors, id_differences, read_vectors


def overlap_scorer():
    """A stand-in pair model: shared words over words of the query."""

    def load():
        def score(queries, texts):
            pairs = [(set(q.split()), set(t.split())) for q, t in zip(queries, texts)]
            return np.array([len(a & b) / max(1, len(a)) for a, b in pairs])

        return score

    return model_scorer(load)


@pytest.fixture(scope="module")
def lists(spark):
    cands = spark.createDataFrame(
        [("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "a", 1)], "query_id string, doc_id string, rank int"
    )
    queries = spark.createDataFrame([("q", "red cup"), ("r", "lamp")], "query_id string, text string")
    corpus = spark.createDataFrame([("a", "blue plate"), ("b", "cup of red clay")], "doc_id string, text string")
    return cands, queries, corpus


@pytest.mark.parametrize("scorer", [token_cosine, overlap_scorer()])
def test_rerank_orders_and_keeps_ties(lists, scorer):
    got = rerank(*lists, scorer).collect()
    order = [(r["query_id"], r["rank"], r["doc_id"]) for r in got]
    assert sorted(order) == [("q", 1, "b"), ("q", 2, "a"), ("q", 3, "c"), ("r", 1, "a")]


def test_rerank_cuts_texts_when_asked(lists):
    got = {r["doc_id"]: r["score"] for r in rerank(*lists, token_cosine, max_chars=3).collect() if r["query_id"] == "q"}
    assert got["b"] == pytest.approx(1 / np.sqrt(2))


def test_score_store_resumes_and_keys_on_text(spark, tmp_path):
    pairs = spark.createDataFrame(
        [("q1", f"d{i}", f"text {i} q1") for i in range(20)], "query_text string, doc_id string, doc_text string"
    )
    store = ScoreStore(spark, str(tmp_path / "scores"), "overlap")
    store.score_missing(pairs.filter("doc_id < 'd15'"), token_cosine, chunks=3)
    half = store.read().count()
    assert 0 < half < 20
    whole = {(r["doc_id"], r["ce_score"]) for r in store.scores(pairs, token_cosine, chunks=2).collect()}
    fresh = ScoreStore(spark, str(tmp_path / "fresh"), "overlap")
    assert whole == {(r["doc_id"], r["ce_score"]) for r in fresh.scores(pairs, token_cosine).collect()}
    assert store.read().count() == 20 and store.missing(pairs).count() == 0
    changed = pairs.withColumn("doc_text", F.concat("doc_text", F.lit(" more")))
    assert store.missing(changed).count() == 20
    assert ScoreStore(spark, str(tmp_path / "scores"), "overlap", 10).missing(pairs).count() == 20
    assert store.lookup(changed).filter("ce_score IS NOT NULL").count() == 0


def test_vectors_are_encoded_once(spark, tmp_path):
    path = str(tmp_path / "vecs")
    length = lambda text: F.array(F.length(text).cast("double"), F.lit(1.0))
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "doc_id long, text string")
    ensure_vectors(spark, docs.filter("doc_id < 3"), path, length)
    assert ensure_vectors(spark, docs, path, length).count() == 3
    assert read_vectors(spark, path).count() == 3
    row = id_differences(docs, read_vectors(spark, path)).first()
    assert row["same_ids"] and row["only_in_a"] == 0


def test_features_by_hand(spark):
    cands = spark.createDataFrame(
        [("q", "a", 0.9, 0.7, 1, 0.5, 0.25), ("q", "b", 0.95, 0.6, 2, 0.1, 0.2)],
        "query_id string, doc_id string, ce_score double, hybrid_score double, hybrid_rank int, bm25_norm double, emb_norm double",
    )
    queries = spark.createDataFrame([("q", "steel kettle")], "query_id string, text string")
    goods = spark.createDataFrame(
        [("a", "Big steel KETTLE with whistle", "Kettle Works", None, "one two three"), ("b", None, "nan", "Steel", None)],
        "doc_id string, title string, brand string, color string, text string",
    )
    got = {r["doc_id"]: r for r in features(cands, queries, goods, True).collect()}
    a, b = got["a"], got["b"]
    assert (a["ce_rank"], b["ce_rank"]) == (2.0, 1.0)
    assert (a["query_len"], a["title_len"], a["title_overlap_count"], a["title_overlap_ratio"]) == (2, 5, 2, 1)
    assert a["title_exact_contains"] == 1 and a["brand_match"] == 1 and a["color_match"] == 0
    assert a["text_len_log"] == pytest.approx(np.log(4)) and a["bm25_emb_gap"] == pytest.approx(0.25)
    assert (b["title_len"], b["brand_match"], b["color_match"], b["text_len_log"]) == (0, 0, 1, 0)


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(11)
    rows = []
    for q in range(60):
        split = "validation" if q < 12 else "train"
        x = rng.normal(size=(20, len(FEATURES)))
        grade = np.clip(np.round(x[:, 0] + 0.5 * x[:, 3] + 0.2 * rng.normal(size=20)) + 1, 0, 3).astype(int)
        for i in range(20):
            rows.append((f"q{q}", f"d{i:02}", split, int(grade[i]), *[float(v) for v in x[i]]))
    names = ", ".join(f"{f} double" for f in FEATURES)
    return spark.createDataFrame(rows, f"query_id string, doc_id string, split string, label int, {names}")


@pytest.fixture(scope="module")
def forest(training):
    params = ltr.LtrParams(n_estimators=6, learning_rate=0.3, max_bin=63, min_child_samples=20, rebase_every=2)
    return ltr.train(training, params)


def test_training_improves_validation_lists(training, forest):
    rows = training.filter("split = 'validation'").toPandas()
    x = rows[list(FEATURES)].to_numpy()
    rows["score"] = forest.predict(x)
    trained = [ltr.list_ndcg(g["label"].to_numpy(float), g["score"].to_numpy(), 10) for _, g in rows.groupby("query_id")]
    flat = [ltr.list_ndcg(g["label"].to_numpy(float), np.zeros(len(g)), 10) for _, g in rows.groupby("query_id")]
    assert 1 <= len(forest.trees) <= 6
    assert np.mean(trained) > np.mean(flat) + 0.1
    assert all(sum(f < 0 for f in t.feature) <= 15 for t in forest.trees)


def test_forest_respects_directions(forest):
    rng = np.random.default_rng(2)
    for f, name in enumerate(FEATURES):
        x = np.repeat(rng.normal(size=(30, len(FEATURES))), 9, axis=0)
        x[:, f] = np.tile(np.linspace(-3, 3, 9), 30)
        steps = np.diff(forest.predict(x).reshape(30, 9), axis=1)
        if MONOTONE[name] > 0:
            assert (steps >= -1e-12).all()
        elif MONOTONE[name] < 0:
            assert (steps <= 1e-12).all()


def test_model_table_round_trip_and_importance(spark, training, forest, tmp_path):
    save_forest(spark, forest, str(tmp_path / "model"))
    loaded = load_forest(spark, str(tmp_path / "model"))
    x = np.random.default_rng(4).normal(size=(50, len(FEATURES)))
    assert np.allclose(loaded.predict(x), forest.predict(x))
    gains = importance(forest.table(spark)).collect()
    assert len(gains) == 15 and gains[0]["feature"] == "ce_score"
    assert [r["gain"] for r in gains] == sorted((r["gain"] for r in gains), reverse=True)
    ranked = ltr.rank(training, loaded, 5)
    assert ranked.groupBy("query_id").count().filter("count <> 5").isEmpty()


def test_lambda_gradients_against_plain_loops():
    rng = np.random.default_rng(8)
    labels, scores = rng.integers(0, 4, 12).astype(float), rng.normal(size=12).round(2)
    order = sorted(range(12), key=lambda i: (-scores[i], i))
    place = {row: i for i, row in enumerate(order)}
    gains = [2**y - 1 for y in labels]
    ideal = sum(g / np.log2(i + 2) for i, g in enumerate(sorted(gains, reverse=True)[:5]))
    grad, total = np.zeros(12), 0.0
    for i in range(12):
        for j in range(12):
            if labels[i] > labels[j] and min(place[i], place[j]) < 5:
                gap = abs(1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2))
                margin = scores[i] - scores[j]
                push = (gains[i] - gains[j]) * gap / ideal / (0.01 + abs(margin)) / (1 + np.exp(margin))
                grad[i] += push
                grad[j] -= push
                total += 2 * push
    got, curve = ltr.lambda_gradients(labels, scores, 5)
    assert np.allclose(got, grad * np.log2(1 + total) / total)
    assert (curve >= 0).all()
