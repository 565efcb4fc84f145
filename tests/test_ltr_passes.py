"""The passes over a tree's leaves: plain jobs over kept gradients, summed as on one machine."""

import numpy as np
import pytest

from rankloom.operators import ltr
from rankloom.operators.features import FEATURES
from rankloom.operators.forest import Tree

WIDTH = len(FEATURES)


@pytest.fixture(scope="module")
def lists(spark):
    rng = np.random.default_rng(3)
    rows = []
    for q in range(40):
        n = int(rng.integers(1, 12))
        labels, bins = rng.integers(0, 4, n).tolist(), rng.integers(0, 8, n * WIDTH).tolist()
        split = "validation" if q % 5 == 0 else "train"
        rows.append((f"q{q}", split, [f"d{i}" for i in range(n)], labels, bins, [0.0] * n))
    schema = "query_id string, split string, doc_ids array<string>, labels array<int>, bins array<int>, scores array<double>"
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("partitions", [1, 7, 60])
def test_sums_do_not_depend_on_partitions_and_plan_no_query(lists, partitions, monkeypatch):
    rows, df = lists
    monkeypatch.setattr(ltr, "materialize", None)  # no table is written for a tree
    p, allowed = ltr.LtrParams(max_bin=7, subsample=1.0), [0, 3, 14]
    tree = Tree()
    tree.feature[0], tree.threshold[0], tree.left[0], tree.right[0] = 3, 4.0, tree.add_leaf(), tree.add_leaf()
    plain, ndcgs = {n: np.zeros((3, 3, 8)) for n in (1, 2)}, []
    for _, split, _, labels, bins, scores in rows:
        y, s = np.array(labels, float), np.array(scores)
        if split == "validation":
            ndcgs.append(ltr.list_ndcg(y, s, p.eval_at))
            continue
        g, h = ltr.lambda_gradients(y, s, p.truncation)
        for i, x in enumerate(np.array(bins).reshape(-1, WIDTH)):
            for f, feature in enumerate(allowed):
                plain[1 if x[3] <= 4 else 2][:, f, x[feature]] += g[i], h[i], 1.0
    graded = ltr._graded(df.repartition(partitions), [], 0, p)
    found = ltr._histograms(graded, tree, [1, 2], allowed, p)
    assert sorted(found) == [1, 2]
    for node, sums in plain.items():
        np.testing.assert_allclose(found[node], sums, atol=1e-12)
    known = [x for x in ndcgs if x is not None]
    assert ltr._mean_ndcg(graded) == pytest.approx(sum(known) / len(known))
    graded.unpersist()


def test_no_lists_give_no_sums(lists):
    _, df = lists
    graded = ltr._graded(df.filter("query_id = ''"), [], 0, ltr.LtrParams())
    assert ltr._histograms(graded, Tree(), [0], [0, 1], ltr.LtrParams()) == {}
    assert ltr._mean_ndcg(graded) is None
    assert ltr._best_split(ltr._sums_table(None, [0, 1]), ltr._Leaf(0), [0, 1], ltr.LtrParams()) is None
