"""Ranking metrics per query and per method."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import discount_sums, discounted
from rankloom.operators.ranking import with_grades

METRICS = ("precision", "recall", "ndcg", "ap", "rr")


def grade_counts(qrels: DataFrame, query: str = "query_id") -> DataFrame:
    """query_id, rel, n: how often each grade occurs."""
    return qrels.groupBy(query, "rel").agg(F.count(F.lit(1)).alias("n"))


def judged_totals(grades: DataFrame, k: int = 10, threshold: int = 1) -> DataFrame:
    """query_id, n_relevant, ideal_dcg.

    The ideal order only needs how often each grade occurs, so judgments are counted per
    (query, grade) before anything moves; a query with very many judgments costs no more than
    any other.
    """
    down = (
        Window.partitionBy("query_id")
        .orderBy(F.col("rel").desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    sums = F.array(*[F.lit(x) for x in discount_sums(k)])
    last = F.least(F.col("upto"), F.lit(k)).cast("int")
    before = F.least(F.col("upto") - F.col("n"), F.lit(k)).cast("int")
    gain = F.col("rel") * (sums[last] - sums[before])
    return (
        grades.withColumn("upto", F.sum("n").over(down))
        .groupBy("query_id")
        .agg(
            F.sum(F.when(F.col("rel") >= threshold, F.col("n")).otherwise(0)).alias("n_relevant"),
            F.sum(gain).alias("ideal_dcg"),
        )
    )


def per_query(
    rankings: DataFrame,
    queries: DataFrame,
    qrels: DataFrame,
    methods: list[str],
    k: int = 10,
    threshold: int = 1,
    small: bool = False,
    grades: DataFrame | None = None,
) -> DataFrame:
    """method, query_id and the five metrics at k.

    Starts from the query list, so a query that got nothing back counts as 0. Precision
    divides by k; the other four are NULL where no judged item can be found. `small`: the
    ranked rows were checked to fit a broadcast; `grades`: the `grade_counts` of `qrels`, where
    they were counted before.
    """
    grades = grade_counts(qrels) if grades is None else grades
    hit = (F.col("rel") >= threshold).cast("int")
    so_far = (
        Window.partitionBy("method", "query_id")
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    top = rankings.filter(F.col("rank") <= k).select("method", "query_id", "doc_id", "rank")
    found = (
        with_grades(top, qrels, small)
        .withColumn("rel", F.coalesce("rel", F.lit(0)))
        .withColumn("hit", hit)
        .withColumn("hits_so_far", F.sum("hit").over(so_far))
        .groupBy("method", "query_id")
        .agg(
            F.sum("hit").alias("hits"),
            F.sum(discounted(F.col("rel"), F.col("rank"))).alias("dcg"),
            F.sum(F.col("hit") * F.col("hits_so_far") / F.col("rank")).alias("precisions"),
            F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_hit"),
        )
    )
    every = queries.select("query_id").withColumn(
        "method", F.explode(F.array(*[F.lit(m) for m in methods]))
    )
    joined = every.join(found, ["method", "query_id"], "left").join(
        judged_totals(grades, k, threshold), "query_id", "left"
    )
    hits = F.coalesce("hits", F.lit(0))
    relevant = F.col("n_relevant")
    return joined.select(
        "method",
        "query_id",
        (hits / F.lit(float(k))).alias("precision"),
        F.when(relevant > 0, hits / relevant).alias("recall"),
        F.when(F.col("ideal_dcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal_dcg")).alias("ndcg"),
        F.when(
            relevant > 0, F.coalesce("precisions", F.lit(0.0)) / F.least(relevant, F.lit(k))
        ).alias("ap"),
        F.when(relevant > 0, F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0))).alias("rr"),
    )


def by_method(scores: DataFrame, metrics=METRICS) -> DataFrame:
    """Mean of each metric per method: undefined values are skipped, a mean of nothing is 0."""
    return scores.groupBy("method").agg(
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics]
    )


def unpivoted(means: DataFrame, metrics=METRICS) -> DataFrame:
    """method, metric, value."""
    return means.unpivot("method", list(metrics), "metric", "value")
