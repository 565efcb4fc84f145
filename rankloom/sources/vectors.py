"""Stored vectors: valid only for the ids they were made for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators.dense import encode_texts


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    vectors.select("doc_id", "vec").write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored (doc_id, vec) table, None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def id_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids only in a, ids only in b, and whether the two id sets are the same."""
    left = a.select("doc_id").distinct().withColumn("in_a", F.lit(1))
    right = b.select("doc_id").distinct().withColumn("in_b", F.lit(1))
    joined = left.join(right, "doc_id", "full")
    only_a = F.count(F.when(F.col("in_b").isNull(), 1))
    only_b = F.count(F.when(F.col("in_a").isNull(), 1))
    return joined.agg(
        only_a.alias("only_in_a"),
        only_b.alias("only_in_b"),
        ((only_a == 0) & (only_b == 0)).alias("same_ids"),
    )


def ensure_vectors(
    spark: SparkSession, docs: DataFrame, path: str, encoder: Callable[[Column], Column]
) -> DataFrame:
    """Vectors of `docs(doc_id, text)`: stored ones are reused, only missing ids are encoded."""
    stored = read_vectors(spark, path)
    missing = docs if stored is None else docs.join(stored.select("doc_id"), "doc_id", "left_anti")
    write_vectors(encode_texts(missing, encoder), path, "append")
    return read_vectors(spark, path).join(docs.select("doc_id"), "doc_id", "left_semi")
