"""Top-k per group: the last step of every retriever."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import tie_key


def top_k(
    df: DataFrame,
    k: int,
    by: tuple[str, ...] = ("query_id",),
    score: str = "score",
    tie: str = "doc_id",
    rank: str = "rank",
) -> DataFrame:
    """Rank from 1 by score (ties by `tie`), keep ranks up to `k`.

    The filter sits directly on the window, so Spark cuts every input partition to k rows
    per group before the shuffle.
    """
    order = Window.partitionBy(*by).orderBy(tie_key(F.col(score)).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def rank_by(score: str, tie: str, by: tuple[str, ...] = ("query_id",)) -> Column:
    """Position of a row by another score; for groups of bounded size (candidate lists)."""
    return F.row_number().over(
        Window.partitionBy(*by).orderBy(tie_key(F.col(score)).desc(), F.col(tie))
    )


def as_ranking(df: DataFrame, method: str) -> DataFrame:
    return df.select(F.lit(method).alias("method"), "query_id", "doc_id", "score", "rank")


def with_grades(rows: DataFrame, qrels: DataFrame, small: bool = False) -> DataFrame:
    """Add `rel`, NULL where a (query, document) pair is not judged.

    `small`: the rows were checked to fit a broadcast. Their pairs then thin out the judgments
    where these lie, so that the large table is neither shuffled nor sorted.
    """
    keys = ["query_id", "doc_id"]
    if small:
        qrels = qrels.join(F.broadcast(rows.select(*keys).distinct()), keys, "left_semi")
    return rows.join(qrels, keys, "left")


def result_rows(
    rankings: DataFrame, queries: DataFrame, qrels: DataFrame, small: bool = False
) -> DataFrame:
    """The flat result table: text of the query, score at 6 decimals, grade or 0."""
    return (
        with_grades(rankings, qrels, small)
        .join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        .select(
            "method",
            "query",
            F.col("doc_id").alias("product_id"),
            F.round("score", 6).alias("score"),
            "rank",
            F.coalesce("rel", F.lit(0)).alias("relevance_score"),
        )
    )
