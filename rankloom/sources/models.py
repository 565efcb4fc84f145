"""Trained rankers as tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.forest import Forest
from rankloom.schema import TREE_NODES, TRAINING_HISTORY, TRAINING_RUN


def save_forest(spark: SparkSession, forest: Forest, path: str) -> None:
    forest.table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_forest(spark: SparkSession, path: str) -> Forest:
    return Forest.from_table(spark.read.schema(TREE_NODES).parquet(path))


@dataclass(frozen=True)
class TrainingRuns:
    """Training runs in one folder, each under the hash of its rows, parameters and trainer.

    A run is `nodes` (the forest), `history` (validation NDCG before every tree) and `run` (its
    parameters and counts). `run` is written last: a run without it was cut short and is made
    again.
    """

    spark: SparkSession
    folder: str

    def version(self, rows: DataFrame, params, train: Callable) -> str:
        """The same for equal rows, in whatever order, equal parameters and the same trainer.
        Numbers count to 9 decimals, because sums of floats differ beyond that from run to run."""
        cells = [F.round(c, 9) if t == "double" else F.col(c) for c, t in sorted(rows.dtypes)]
        row = rows.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*cells).cast("decimal(38,0)"))
        ).first()
        trainer = f"{train.__module__}.{train.__qualname__}"
        about = json.dumps([trainer, asdict(params), sorted(rows.dtypes), row[0], str(row[1])])
        return hashlib.sha256(about.encode()).hexdigest()[:32]

    def path(self, version: str, part: str) -> str:
        return f"{self.folder}/version={version}/{part}"

    def finished(self, version: str) -> bool:
        try:
            return not self.spark.read.parquet(self.path(version, "run")).isEmpty()
        except AnalysisException:
            return False

    def get(self, rows: DataFrame, params, train: Callable[[DataFrame, object], Forest]) -> Forest:
        """The run of these rows and parameters, trained now if there is none."""
        version = self.version(rows, params, train)
        if not self.finished(version):
            self.save(version, train(rows, params), params, rows.count())
        forest = load_forest(self.spark, self.path(version, "nodes"))
        history = self.spark.read.parquet(self.path(version, "history")).orderBy("trees")
        return Forest(forest.trees, forest.features, [tuple(r) for r in history.collect()])

    def save(self, version: str, forest: Forest, params, n_rows: int) -> None:
        save_forest(self.spark, forest, self.path(version, "nodes"))
        history = self.spark.createDataFrame(forest.history, TRAINING_HISTORY)
        history.coalesce(1).write.mode("overwrite").parquet(self.path(version, "history"))
        about = [(version, json.dumps(asdict(params)), n_rows, len(forest.trees))]
        run = self.spark.createDataFrame(about, TRAINING_RUN)
        run.coalesce(1).write.mode("overwrite").parquet(self.path(version, "run"))
