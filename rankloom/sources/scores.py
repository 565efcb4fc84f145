"""Store of pair scores: resumable, and never shared between different models or texts.

Scores lie in commits, one per scored chunk, each cut into buckets by the hash of the pair. A
commit counts once it is entered in the manifest, so a chunk that was cut short is not there at
all. A look-up reads the buckets of its pairs only. Many small commits are merged into one, which
replaces them in the manifest; readers of the old ones are not disturbed.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.rerank import Scorer, score_pairs
from rankloom.runtime import delete, materialize
from rankloom.schema import SCORE_COMMITS

KEYS = ["query_text", "doc_id", "text_hash"]
BUCKETS = 64
# More commits than this are merged before the next run.
MERGE_AFTER = 16


@dataclass(frozen=True)
class ScoringRun:
    """Numbers of one scoring run."""

    new_pairs: int
    reused_pairs: int
    seconds: float

    @property
    def pairs_per_second(self) -> float | None:
        return self.new_pairs / self.seconds if self.new_pairs and self.seconds > 0 else None


def _bucket() -> Column:
    return F.pmod(F.xxhash64("query_text", F.col("doc_id").cast("string")), F.lit(BUCKETS)).cast("int")


class ScoreStore:
    """Scores under one signature (model and text limit).

    A row is keyed by the query text, the document and the hash of the text that was scored,
    so a changed text is scored again. Scoring runs in chunks; each chunk is committed before
    the next starts, and a restarted job scores only what is missing.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, max_chars: int | None = None):
        self.spark = spark
        self.path = path
        self.signature = hashlib.sha256(f"{model}|{max_chars}".encode()).hexdigest()[:16]

    @property
    def _manifest(self) -> str:
        return f"{self.path}/_manifest/signature={self.signature}"

    def commits(self) -> list[str]:
        """The folders that count: entered, and not replaced by a merged one."""
        try:
            rows = self.spark.read.schema(SCORE_COMMITS).parquet(self._manifest).collect()
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        replaced = {name for row in rows for name in row["replaces"]}
        return sorted(row["folder"] for row in rows if row["folder"] not in replaced)

    def _commit(self, scored: DataFrame, replaces: list[str]) -> str:
        """Write rows of KEYS and ce_score, then enter them."""
        folder = f"{self.path}/signature={self.signature}/commit={uuid.uuid4().hex}"
        (
            scored.select(*KEYS, "ce_score", _bucket().alias("bucket"))
            .repartition("bucket")
            .write.partitionBy("bucket")
            .parquet(folder)
        )
        entry = self.spark.createDataFrame([(folder, replaces)], SCORE_COMMITS)
        entry.coalesce(1).write.mode("append").parquet(self._manifest)
        return folder

    def _stored(self, buckets: list[int] | None = None) -> DataFrame | None:
        commits = self.commits()
        if not commits:
            return None
        rows = self.spark.read.option("basePath", self.path).parquet(*commits)
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(buckets))
        # Two runs at once may have stored a pair twice.
        return rows.groupBy(*KEYS).agg(F.max("ce_score").alias("ce_score"))

    def read(self) -> DataFrame | None:
        """All scores, None if there is no commit."""
        return self._stored()

    def merge(self) -> None:
        """One commit in place of all that count now."""
        commits = self.commits()
        if len(commits) > 1:
            self._commit(self._stored(), commits)

    def sweep(self) -> list[str]:
        """Delete the folders of replaced commits, for when no reader uses them any more."""
        try:
            rows = self.spark.read.schema(SCORE_COMMITS).parquet(self._manifest).collect()
        except AnalysisException:
            return []
        replaced = sorted({name for row in rows for name in row["replaces"]})
        for folder in replaced:
            delete(self.spark, folder)
        return replaced

    @staticmethod
    def keyed(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("text_hash", F.sha2("doc_text", 256))

    def _stored_for(self, keyed: DataFrame) -> DataFrame | None:
        """The scores in the buckets of these pairs; their numbers (at most BUCKETS) become
        literals that prune the folders."""
        found = keyed.select(_bucket().alias("b")).distinct().collect()
        return self._stored([row["b"] for row in found])

    def missing(self, pairs: DataFrame) -> DataFrame:
        """Pairs (query_text, doc_id, doc_text) without a stored score."""
        wanted = self.keyed(pairs).dropDuplicates(KEYS)
        stored = self._stored_for(wanted)
        return wanted if stored is None else wanted.join(stored.select(*KEYS), KEYS, "left_anti")

    def score_missing(self, pairs: DataFrame, scorer: Scorer, chunks: int = 1) -> ScoringRun:
        """Score what is missing, chunk by chunk; the pairs are cut by the hash of their key."""
        if len(self.commits()) > MERGE_AFTER:
            self.merge()
        asked = self.keyed(pairs).select(*KEYS).distinct().count()
        new_pairs, started = 0, time.monotonic()
        for chunk in range(chunks):
            part = pairs
            if chunks > 1:
                place = F.pmod(F.xxhash64("query_text", "doc_id"), F.lit(chunks))
                part = pairs.filter(place == chunk)
            missing = materialize(self.missing(part), "unscored")
            count = missing.count()
            if not count:
                continue
            new_pairs += count
            self._commit(score_pairs(missing, scorer), [])
        return ScoringRun(new_pairs, asked - new_pairs, time.monotonic() - started)

    def scores(self, pairs: DataFrame, scorer: Scorer, chunks: int = 1) -> DataFrame:
        """The given pairs with `ce_score`; new scores are stored on the way."""
        self.score_missing(pairs, scorer, chunks)
        return self.lookup(pairs)

    def lookup(self, pairs: DataFrame) -> DataFrame:
        """Read only: the pairs with `ce_score`, NULL where none is stored."""
        keyed = self.keyed(pairs)
        stored = self._stored_for(keyed)
        if stored is None:
            return pairs.withColumn("ce_score", F.lit(None).cast("double"))
        return keyed.join(stored, KEYS, "left").drop("text_hash")
