"""Regression forests as tables of nodes, and their application to rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.features import FEATURES
from rankloom.schema import TREE_NODES


@dataclass
class Tree:
    """Parallel lists, one entry per node; node 0 is the root, a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def add_leaf(self, value: float = 0.0) -> int:
        for column, start in (
            (self.feature, -1),
            (self.threshold, 0.0),
            (self.left, -1),
            (self.right, -1),
            (self.value, value),
            (self.gain, 0.0),
        ):
            column.append(start)
        return len(self.feature) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf index of each row of a matrix (a row goes left when x <= threshold)."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                return node
            at, here = rows[inner], node[inner]
            goes_left = x[at, feature[here]] <= threshold[here]
            node[inner] = np.where(goes_left, left[here], right[here])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


@dataclass
class Forest:
    trees: list[Tree]
    features: tuple[str, ...] = FEATURES
    history: list[tuple[int, float]] = field(default_factory=list)  # trees so far, NDCG

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.predict(x)
        return total

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows (tree, node, ...): a few dozen per tree."""
        rows = [
            (
                t,
                n,
                self.features[tree.feature[n]] if tree.feature[n] >= 0 else None,
                float(tree.threshold[n]),
                int(tree.left[n]),
                int(tree.right[n]),
                float(tree.value[n]),
                float(tree.gain[n]),
            )
            for t, tree in enumerate(self.trees)
            for n in range(len(tree.feature))
        ]
        return spark.createDataFrame(rows, TREE_NODES)

    @staticmethod
    def from_table(nodes: DataFrame, features: tuple[str, ...] = FEATURES) -> Forest:
        trees: dict[int, Tree] = {}
        for row in nodes.orderBy("tree", "node").collect():
            if row["node"] == 0:
                tree = trees[row["tree"]] = Tree()
            else:
                tree = trees[row["tree"]]
                tree.add_leaf()
            n = row["node"]
            tree.feature[n] = features.index(row["feature"]) if row["feature"] else -1
            tree.threshold[n], tree.value[n], tree.gain[n] = (
                row["threshold"],
                row["value"],
                row["gain"],
            )
            tree.left[n], tree.right[n] = row["left"], row["right"]
        return Forest([trees[t] for t in sorted(trees)], features)


def score_rows(rows: DataFrame, forest: Forest, name: str = "ltr_score") -> DataFrame:
    """Add the forest's score to rows that carry its feature columns."""
    columns = list(forest.features)

    @F.pandas_udf("double")
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(forest.predict(batch[columns].to_numpy(dtype=np.float64)))

    return rows.withColumn(name, walk(F.struct(*columns)))


def importance(nodes: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """feature, gain: total gain of the splits on each feature, unused ones with 0."""
    gains = nodes.filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.sum("gain").alias("g"))
    names = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return (
        names.join(F.broadcast(gains), "feature", "left")
        .select("feature", F.coalesce("g", F.lit(0.0)).alias("gain"))
        .orderBy(F.col("gain").desc(), "feature")
    )
