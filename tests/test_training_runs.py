"""Stored training runs, and the registered rankers at full strength."""

import json

import pytest

from rankloom.operators import ltr
from rankloom.operators.features import FEATURES, MONOTONE
from rankloom.plans.inputs import Shop, training_runs
from rankloom.plans.registry import METHODS, QUERIES
from rankloom.runtime import materialize
from rankloom.sources.models import TrainingRuns

SF = "/root/testdata/sf0.001"
SMALL = ltr.LtrParams(n_estimators=3, max_bin=31, min_child_samples=20, learning_rate=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    return materialize(Shop(spark, SF).training_rows(), "training")


def test_a_finished_run_is_read_and_a_cut_one_made_again(spark, rows, tmp_path):
    runs, calls = TrainingRuns(spark, str(tmp_path)), []

    def train(data, params):
        calls.append(params)
        return ltr.train(data, params)

    first = runs.get(rows, SMALL, train)
    again = runs.get(rows.orderBy("doc_id"), SMALL, train)
    assert calls == [SMALL] and again.trees == first.trees and again.history == first.history
    assert 1 <= len(first.trees) <= 3 and [t for t, _ in first.history] == [0, 1, 2]
    version = runs.version(rows, SMALL, train)
    about = spark.read.parquet(runs.path(version, "run")).first()
    assert json.loads(about["params"])["max_bin"] == 31 and about["rows"] == rows.count()
    other = ltr.LtrParams(n_estimators=1)
    assert len({version, runs.version(rows, other, train), runs.version(rows, SMALL, ltr.train)}) == 3
    assert not runs.finished(runs.version(rows, other, train))
    forest = runs.get(rows, other, train)
    runs.save("cut", forest, other, 1)
    spark.createDataFrame([], "version string").write.mode("overwrite").parquet(runs.path("cut", "run"))
    assert not runs.finished("cut")


def test_near_ties_do_not_depend_on_the_order_of_sums():
    import pandas as pd

    def sums(noise):
        cells = [(0, b, g, 1.0, 60.0) for b, g in ((0, -5.0), (1, 5.0))]
        cells += [(3, b, g * (1 + noise), 1.0, 60.0) for b, g in ((0, -5.0), (4, 5.0))]
        return pd.DataFrame(cells, columns=["feature", "bin", "g", "h", "n"])

    chosen = {ltr._best_split(sums(x), ltr._Leaf(0), [0, 3], ltr.LtrParams())[1] for x in (0, 1e-13, -1e-13)}
    assert chosen == {0}


def leaves(tree, node=0, path=()):
    if tree.feature[node] < 0:
        return [(path, tree.value[node])]
    f, t = tree.feature[node], tree.threshold[node]
    return leaves(tree, tree.left[node], (*path, (f, t, 0))) + leaves(tree, tree.right[node], (*path, (f, t, 1)))


def test_registered_ranker(spark, rows):
    """One full training (600 trees at most, early stop) serves the three queries that read it."""
    six = {r["method"]: r.asDict() for r in QUERIES["heldout_six_methods"](spark, SF).collect()}
    assert sorted(six) == sorted([*METHODS, "ltr"])
    five = {r["method"]: r.asDict() for r in QUERIES["heldout_comparison"](spark, SF).collect()}
    assert {m: six[m] for m in METHODS} == five
    assert all(0 <= six["ltr"][c] <= 1 for c in ("precision", "recall", "ndcg", "ap", "rr"))

    forest = training_runs(spark).get(rows, ltr.LtrParams(), ltr.train)
    measured = dict(forest.history)
    best = max(measured, key=lambda t: (round(measured[t], 12), -t))
    assert len(forest.trees) in (max(1, best), len(measured) - 1, len(measured))
    assert len(measured) <= best + ltr.LtrParams().early_stopping + 1
    for tree in forest.trees:
        ends = leaves(tree)
        assert 2 <= len(ends) <= 15 and all(g > 0 for f, g in zip(tree.feature, tree.gain) if f >= 0)
        # The directions hold over every split: all leaves on its better side are at least as high.
        for node, f in enumerate(tree.feature):
            sign = MONOTONE[FEATURES[f]] if f >= 0 else 0
            if sign:
                low = [v for _, v in leaves(tree, tree.left[node])]
                high = [v for _, v in leaves(tree, tree.right[node])]
                assert sign * (min(high) - max(low)) >= -1e-12 if sign > 0 else min(low) - max(high) >= -1e-12

    gains = {r["feature"]: r["gain"] for r in QUERIES["ltr_importance"](spark, SF).collect()}
    want = dict.fromkeys(FEATURES, 0.0)
    for tree in forest.trees:
        for f, g in zip(tree.feature, tree.gain):
            if f >= 0:
                want[FEATURES[f]] += g
    assert gains == pytest.approx(want, abs=1e-5)

    top = QUERIES["ltr_topk"](spark, SF).collect()
    by_query = {}
    for r in sorted(top, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append(r)
    held = {r["query_id"] for r in rows.filter("split = 'test'").select("query_id").distinct().collect()}
    assert set(by_query) == held
    for found in by_query.values():
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1)) and len(found) <= 10
        assert all(a["score"] >= b["score"] for a, b in zip(found, found[1:]))
