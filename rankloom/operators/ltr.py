"""LambdaMART trained by Spark jobs.

Training rows are kept as one row per query: a candidate list of bounded length with its
labels, binned features and current scores. Once per tree that table is turned into lambda
gradients, which the executors keep (lost ones are made again from the table). A pass over those adds
them to gradient histograms per partition, and partitions are summed by a tree reduction. The driver
only sees those sums, whose number depends on the model's size and not on the data, and picks the
splits. A tree takes about ten passes, so each is a plain RDD job without a query to be planned.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.features import FEATURES, MONOTONE
from rankloom.operators.forest import Forest, Tree, score_rows
from rankloom.operators.ranking import top_k
from rankloom.runtime import materialize, scratch



@dataclass(frozen=True)
class LtrParams:
    """Fixed values as defaults; every one can be overridden."""

    n_estimators: int = 600
    learning_rate: float = 0.03
    num_leaves: int = 15
    min_child_samples: int = 50
    min_child_hessian: float = 1e-3
    subsample: float = 0.8
    colsample: float = 0.8
    reg_lambda: float = 5.0
    min_split_gain: float = 0.0
    max_bin: int = 1023
    seed: int = 42
    early_stopping: int = 50
    eval_at: int = 10
    truncation: int = 30
    rebase_every: int = 10


@dataclass
class _Leaf:
    node: int
    low: float = -math.inf
    high: float = math.inf
    split: tuple | None = None


def bin_edges(rows: DataFrame, max_bin: int, features=FEATURES) -> list[np.ndarray]:
    """Cut points of each feature from Spark's quantile sketch (one pass, at most max_bin each)."""
    shares = [i / max_bin for i in range(1, max_bin)]
    cuts = rows.approxQuantile(list(features), shares, 1.0 / (4 * max_bin))
    return [np.unique(np.array(c, dtype=np.float64)) for c in cuts]


def pack(rows: DataFrame, edges: list[np.ndarray], features=FEATURES) -> DataFrame:
    """query_id, split, doc_ids, labels, bins (row-major), scores: one row per query.

    `rows` are candidate lists cut at a fixed depth, which bounds every collected list.
    """
    width = len(features)
    listed = (
        rows.select("query_id", "split", "doc_id", "label", F.array(*features).alias("x"))
        .groupBy("query_id", "split")
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", "label", "x"))).alias("list"))
        .select(
            "query_id",
            "split",
            F.col("list.doc_id").alias("doc_ids"),
            F.col("list.label").alias("labels"),
            F.flatten("list.x").alias("x"),
        )
    )

    def to_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins, scores = [], []
            for values in batch.pop("x"):
                x = np.asarray(values, dtype=np.float64).reshape(-1, width)
                # A row's bin is the number of cut points below its value.
                columns = [np.searchsorted(cuts, x[:, f], "left") for f, cuts in enumerate(edges)]
                bins.append(np.stack(columns, axis=1).ravel().astype(np.int32))
                scores.append(np.zeros(len(x)))
            yield batch.assign(bins=bins, scores=scores)

    kind, doc_kind = (rows.schema[c].dataType.simpleString() for c in ("query_id", "doc_id"))
    schema = (
        f"query_id {kind}, split string, doc_ids array<{doc_kind}>, labels array<int>, "
        "bins array<int>, scores array<double>"
    )
    return listed.mapInPandas(to_bins, schema)


def lambda_gradients(labels, scores, truncation: int):
    """Gradient and curvature of each row of one list (maximisation sign)."""
    n = len(labels)
    grad, hess = np.zeros(n), np.zeros(n)
    gains = np.exp2(labels) - 1.0
    best = np.sort(gains)[::-1][:truncation]
    ideal = float((best / np.log2(np.arange(2, len(best) + 2))).sum())
    if ideal <= 0 or n < 2:
        return grad, hess
    order = np.argsort(-scores, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    discount = 1.0 / np.log2(place + 2.0)
    spread = scores.max() != scores.min()
    total = 0.0
    for i in np.nonzero(place < truncation)[0]:
        # Each unordered pair once: partners below i in the current order.
        mates = np.nonzero((place > place[i]) & (labels != labels[i]))[0]
        if not len(mates):
            continue
        sign = np.where(labels[i] > labels[mates], 1.0, -1.0)
        margin = sign * (scores[i] - scores[mates])
        worth = np.abs(gains[i] - gains[mates]) * np.abs(discount[i] - discount[mates]) / ideal
        if spread:
            worth = worth / (0.01 + np.abs(margin))
        wrong = 1.0 / (1.0 + np.exp(np.clip(margin, -50, 50)))
        push, curve = wrong * worth, wrong * (1.0 - wrong) * worth
        grad[i] += (sign * push).sum()
        grad[mates] -= sign * push
        hess[i] += curve.sum()
        hess[mates] += curve
        total += 2.0 * push.sum()
    if total > 0:
        scale = math.log2(1.0 + total) / total
        grad, hess = grad * scale, hess * scale
    return grad, hess


def list_ndcg(labels, scores, k: int) -> float | None:
    """NDCG with exponential gain, as training judges a validation list; None if no gain."""
    gains = np.exp2(labels) - 1.0
    discount = 1.0 / np.log2(np.arange(2, k + 2))
    best = np.sort(gains)[::-1][:k]
    ideal = (best * discount[: len(best)]).sum()
    if ideal <= 0:
        return None
    top = gains[np.argsort(-scores, kind="stable")][:k]
    return float((top * discount[: len(top)]).sum() / ideal)


def _graded(packed: DataFrame, pending: list[Tree], t: int, p: LtrParams) -> RDD:
    """(bins, g, h, ndcgs) per Arrow batch of lists for tree t: the training rows in the tree's
    sample with their gradients, and the NDCG of the validation lists under the finished trees.
    Kept by the executors, so that the passes over a tree's leaves compute no gradient again."""
    width = len(FEATURES)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins_of, grads, curves, ndcgs = [], [], [], []
            for query_id, split, labels, bins, scores in zip(
                batch["query_id"], batch["split"], batch["labels"], batch["bins"], batch["scores"]
            ):
                x = np.asarray(bins, dtype=np.int32).reshape(-1, width)
                y = np.asarray(labels, dtype=np.float64)
                s = np.array(scores, dtype=np.float64)
                for done in pending:
                    s = s + done.predict(x)
                if split == "validation":
                    value = list_ndcg(y, s, p.eval_at)
                    if value is not None:
                        ndcgs.append(value)
                    continue
                g, h = lambda_gradients(y, s, p.truncation)
                draw = np.random.default_rng([p.seed, t, zlib.crc32(str(query_id).encode())])
                taken = draw.random(len(y)) < p.subsample
                bins_of.append(x[taken])
                grads.append(g[taken])
                curves.append(h[taken])
            x = np.concatenate([np.zeros((0, width), np.int32), *bins_of])
            block = x, np.concatenate([[], *grads]), np.concatenate([[], *curves]), np.array(ndcgs)
            yield pd.DataFrame({"block": [pickle.dumps(block)]})

    blocks = packed.mapInPandas(grade, "block binary").rdd
    return blocks.map(lambda row: pickle.loads(row[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _mean_ndcg(graded: RDD) -> float | None:
    """Mean NDCG of the validation lists, None without any."""
    parts = graded.map(lambda block: (float(block[3].sum()), len(block[3])))

    def both(a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]

    total, n = parts.treeAggregate((0.0, 0), both, both)
    return total / n if n else None


def _histograms(
    graded: RDD, tree: Tree, nodes: list[int], allowed: list[int], p: LtrParams
) -> dict[int, np.ndarray]:
    """By leaf of the tree being grown the sums of g, h and rows: an array (3, allowed features,
    bins). Partitions are summed in the executors first; a leaf without rows is left out."""
    wanted, size = sorted(nodes), p.max_bin + 1
    shift = np.arange(len(allowed)) * size

    def scan(blocks: Iterator[tuple]) -> Iterator[dict[int, np.ndarray]]:
        sums: dict[int, np.ndarray] = {}
        for x, g, h, _ in blocks:
            leaf = tree.leaf_of(x)
            for node in wanted:
                rows = np.nonzero(leaf == node)[0]
                if not len(rows):
                    continue
                table = sums.setdefault(node, np.zeros((3, len(allowed) * size)))
                cell = (x[np.ix_(rows, allowed)] + shift).ravel()
                for i, weight in enumerate((g[rows], h[rows], np.ones(len(rows)))):
                    table[i] += np.bincount(cell, np.repeat(weight, len(allowed)), len(allowed) * size)
        yield sums

    def both(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        return {n: a[n] + b[n] if n in a and n in b else a.get(n, b.get(n)) for n in {*a, *b}}

    found = graded.mapPartitions(scan).treeAggregate({}, both, both)
    return {node: table.reshape(3, len(allowed), size) for node, table in found.items()}


def _sums_table(table: np.ndarray | None, allowed: list[int]) -> pd.DataFrame:
    """feature, bin, g, h, n of the bins in which a leaf has rows, in this order."""
    if table is None:
        table = np.zeros((3, len(allowed), 1))
    feature, bin_ = np.nonzero(table[2])
    g, h, n = table[:, feature, bin_]
    return pd.DataFrame({"feature": np.array(allowed)[feature], "bin": bin_, "g": g, "h": h, "n": n})


def first_gradients(packed: DataFrame, truncation: int = 30) -> DataFrame:
    """query_id, doc_id, label, grad, hess of the first round, in which all scores are equal."""
    kinds = packed.schema["query_id"].dataType, packed.schema["doc_ids"].dataType.elementType
    schema = "query_id {}, doc_id {}, label int, grad double, hess double".format(
        *(k.simpleString() for k in kinds)
    )

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query_id, docs, labels in zip(batch["query_id"], batch["doc_ids"], batch["labels"]):
                y = np.asarray(labels, dtype=np.float64)
                g, h = lambda_gradients(y, np.zeros(len(y)), truncation)
                yield pd.DataFrame(
                    {"query_id": query_id, "doc_id": list(docs), "label": labels, "grad": g, "hess": h}
                )

    return packed.mapInPandas(grade, schema)


def _output(g, h, p: LtrParams, low: float, high: float):
    return np.clip(g / (h + p.reg_lambda), low, high)


def _worth(g, h, out, p: LtrParams):
    return 2.0 * g * out - (h + p.reg_lambda) * out * out


# Gains that differ by less than this share tie; the first feature and bin win. Sums of floats
# differ that much with the order of their terms, so the choice does not depend on partitions.
TIE = 1e-9


def _best_split(sums: pd.DataFrame, leaf: _Leaf, allowed: list[int], p: LtrParams):
    """(gain, feature, bin, left output, right output) or None."""
    best = None
    order = np.lexsort((sums["bin"], sums["feature"]))
    features, bins, *amounts = (sums[c].to_numpy()[order] for c in ("feature", "bin", "g", "h", "n"))
    for feature in allowed:
        begin, end = np.searchsorted(features, [feature, feature + 1])
        if end - begin < 2:
            continue
        g, h, n = (a[begin:end].cumsum() for a in amounts)
        gl, hl, nl = g[:-1], h[:-1], n[:-1]
        gr, hr, nr = g[-1] - gl, h[-1] - hl, n[-1] - nl
        left = _output(gl, hl, p, leaf.low, leaf.high)
        right = _output(gr, hr, p, leaf.low, leaf.high)
        whole = _output(g[-1], h[-1], p, leaf.low, leaf.high)
        gain = (
            _worth(gl, hl, left, p) + _worth(gr, hr, right, p) - _worth(g[-1], h[-1], whole, p)
        )
        fine = (nl >= p.min_child_samples) & (nr >= p.min_child_samples)
        fine &= (hl >= p.min_child_hessian) & (hr >= p.min_child_hessian)
        direction = MONOTONE[FEATURES[feature]]
        if direction:
            fine &= direction * (right - left) >= 0
        gain = np.where(fine, gain, -np.inf)
        most = gain.max()
        if not np.isfinite(most):
            continue
        at = int(np.argmax(gain >= most - TIE * abs(most)))
        floor = max(p.min_split_gain, 1e-12)
        if gain[at] > (floor if best is None else best[0] + TIE * abs(best[0])):
            bin_ = int(bins[begin + at])
            best = (float(gain[at]), feature, bin_, float(left[at]), float(right[at]))
    return best


def _divide(tree: Tree, leaf: _Leaf) -> tuple[_Leaf, _Leaf]:
    gain, feature, bin_, out_left, out_right = leaf.split
    n = leaf.node
    tree.feature[n], tree.threshold[n], tree.gain[n] = feature, float(bin_), gain
    tree.left[n], tree.right[n] = tree.add_leaf(out_left), tree.add_leaf(out_right)
    low, high = _Leaf(tree.left[n], leaf.low, leaf.high), _Leaf(tree.right[n], leaf.low, leaf.high)
    middle = (out_left + out_right) / 2.0
    direction = MONOTONE[FEATURES[feature]]
    if direction > 0:
        low.high, high.low = min(low.high, middle), max(high.low, middle)
    elif direction < 0:
        low.low, high.high = max(low.low, middle), min(high.high, middle)
    return low, high


def _grow(packed: DataFrame, pending: list[Tree], t: int, p: LtrParams):
    """One tree, best leaf first.

    The next choice needs the best splits of the leaves just made. To keep the number of
    passes near the depth of the tree, a pass measures the children of every leaf that may
    still be chosen; those that never are get cut off in the end.
    """
    rng = np.random.default_rng([p.seed, t])
    n_features = max(1, round(p.colsample * len(FEATURES)))
    allowed = sorted(rng.choice(len(FEATURES), n_features, replace=False).tolist())
    tree = Tree()
    graded = _graded(packed, pending, t, p)
    try:
        metric = _mean_ndcg(graded)
        chosen = _split_leaves(graded, tree, allowed, p)
    finally:
        graded.unpersist()
    return _prune(tree, chosen, p.learning_rate), metric


def _split_leaves(graded: RDD, tree: Tree, allowed: list[int], p: LtrParams) -> set[int]:
    """Divide the leaves of a tree of one leaf; the nodes whose splits are to be kept."""

    def measure(leaves: list[_Leaf]) -> None:
        sums = _histograms(graded, tree, [x.node for x in leaves], allowed, p)
        for leaf in leaves:
            leaf.split = _best_split(_sums_table(sums.get(leaf.node), allowed), leaf, allowed, p)

    root = _Leaf(0)
    measure([root])
    frontier, children, chosen = [root], {}, set()
    while len(frontier) < p.num_leaves:
        splittable = sorted((x for x in frontier if x.split), key=lambda x: -x.split[0])
        if not splittable:
            break
        best = splittable[0]
        if best.node not in children:
            fresh: list[_Leaf] = []
            for leaf in splittable[: p.num_leaves - len(frontier)]:
                if leaf.node not in children:
                    children[leaf.node] = _divide(tree, leaf)
                    fresh += children[leaf.node]
            if len(frontier) + 1 < p.num_leaves:
                measure(fresh)
        frontier.remove(best)
        frontier += children[best.node]
        chosen.add(best.node)
    return chosen


def _prune(tree: Tree, chosen: set[int], rate: float) -> Tree:
    """Only the chosen splits, renumbered from the root, with shrunken leaf values."""
    kept = Tree()
    todo = [(0, 0)]
    while todo:
        old, new = todo.pop()
        kept.value[new] = tree.value[old] * rate
        if old in chosen:
            kept.feature[new], kept.threshold[new] = tree.feature[old], tree.threshold[old]
            kept.gain[new] = tree.gain[old]
            kept.left[new], kept.right[new] = kept.add_leaf(), kept.add_leaf()
            todo += [(tree.left[old], kept.left[new]), (tree.right[old], kept.right[new])]
    return kept


def _rebase(packed: DataFrame, pending: list[Tree]) -> DataFrame:
    """Fold finished trees into the stored scores and cut the lineage with a written table."""
    width = len(FEATURES)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores = []
            for bins, old in zip(batch["bins"], batch["scores"]):
                x = np.asarray(bins, dtype=np.int64).reshape(-1, width)
                s = np.array(old, dtype=np.float64)
                for tree in pending:
                    s = s + tree.predict(x)
                scores.append(s)
            yield batch.assign(scores=scores)

    return materialize(packed.mapInPandas(add, packed.schema), "boost")


def _with_values(tree: Tree, edges: list[np.ndarray]) -> Tree:
    """The same tree with thresholds in feature units instead of bin numbers."""
    threshold = [
        float(edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold)
    ]
    return Tree(tree.feature, threshold, tree.left, tree.right, tree.value, tree.gain)


def first_tree(rows: DataFrame, edges: list[np.ndarray], params: LtrParams) -> Forest:
    """The first tree over all `rows`, with given cut points in place of the sketch's. The same
    passes as in `train`, for results that can be followed by hand."""
    with scratch(rows.sparkSession):
        packed = materialize(pack(rows.withColumn("split", F.lit("train")), edges), "packed")
        tree, _ = _grow(packed, [], 0, params)
    return Forest([_with_values(tree, edges)])


def train(rows: DataFrame, params: LtrParams = LtrParams()) -> Forest:
    """Fit on `rows(query_id, doc_id, split, label, <features>)`; rows of split `validation`
    stop the training, other splits than these two are ignored. The forest's history holds the
    validation NDCG before every tree. The tables of the rounds are deleted at the end."""
    with scratch(rows.sparkSession):
        return _train(rows, params)


def _train(rows: DataFrame, p: LtrParams) -> Forest:
    used = materialize(rows.filter(F.col("split").isin("train", "validation")), "rows")
    edges = bin_edges(used.filter(F.col("split") == "train"), p.max_bin)
    packed = materialize(pack(used, edges), "packed")
    trees: list[Tree] = []
    pending: list[Tree] = []
    history: list[tuple[int, float]] = []
    best_metric, best_size = -math.inf, None
    for t in range(p.n_estimators):
        tree, metric = _grow(packed, pending, t, p)
        # The metric measured while growing tree t belongs to the t trees before it.
        if metric is not None:
            history.append((t, metric))
            if metric > best_metric + 1e-12:
                best_metric, best_size = metric, t
            elif t - best_size >= p.early_stopping:
                break
        if len(tree.feature) == 1:
            break
        trees.append(tree)
        pending.append(tree)
        if len(pending) >= p.rebase_every:
            packed, pending = _rebase(packed, pending), []
    if best_size is not None and len(trees) > best_size:
        final = _validation_metric(packed, pending, p)
        kept = len(trees) if final is not None and final > best_metric + 1e-12 else max(1, best_size)
        trees = trees[:kept]
    return Forest([_with_values(tree, edges) for tree in trees], history=history)


def _validation_metric(packed: DataFrame, pending: list[Tree], p: LtrParams) -> float | None:
    held = packed.filter(F.col("split") == "validation")
    graded = _graded(held, pending, 0, p)
    try:
        return _mean_ndcg(graded)
    finally:
        graded.unpersist()


def rank(rows: DataFrame, forest: Forest, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank of feature rows, best first."""
    scored = score_rows(rows, forest, "score").select("query_id", "doc_id", "score", "hybrid_rank")
    return top_k(scored, k, tie="hybrid_rank").select("query_id", "doc_id", "score", "rank")
