"""Comparisons of methods: relative change, wins and losses, case lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import tie_key

# Fixed value: a change smaller than this counts as none.
EPSILON = 1e-9


def best_method(means: DataFrame, metric: str, order: list[str]) -> DataFrame:
    """method, value: the highest mean; the earlier in `order` wins a tie."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("method"))
    return (
        means.select("method", F.col(metric).alias("value"))
        .orderBy(tie_key(F.col("value")).desc(), position)
        .limit(1)
    )


def relative_change(means_long: DataFrame, new: str) -> DataFrame:
    """metric, method, change in % of `new` against every other method; NaN over zero."""
    target = means_long.filter(F.col("method") == new).select("metric", F.col("value").alias("new"))
    old = F.col("value")
    change = F.when(old != 0, (F.col("new") - old) / old * 100.0).otherwise(F.lit(float("nan")))
    return (
        means_long.filter(F.col("method") != new)
        .join(F.broadcast(target), "metric")
        .select("metric", "method", change.alias("change_pct"))
    )


def side_by_side(scores: DataFrame, a: str, b: str, *metrics: str) -> DataFrame:
    """One row per query with columns a_<metric> and b_<metric>."""

    def of(method: str, metric: str) -> Column:
        return F.max(F.when(F.col("method") == method, F.col(metric)))

    columns = []
    for metric in metrics:
        columns += [of(a, metric).alias(f"a_{metric}"), of(b, metric).alias(f"b_{metric}")]
    wanted = scores.filter(F.col("method").isin(a, b))
    return wanted.groupBy("query_id").agg(*columns)


def fails_and_succeeds(scores: DataFrame, a: str, b: str, n: int = 5) -> DataFrame:
    """Queries where `a` finds nothing relevant and `b` does, largest NDCG gain first."""
    gain = F.coalesce("b_ndcg", F.lit(0.0)) - F.coalesce("a_ndcg", F.lit(0.0))
    return (
        side_by_side(scores, a, b, "recall", "ndcg")
        .filter((F.col("a_recall") == 0) & (F.col("b_recall") > 0))
        .withColumn("gain", gain)
        .orderBy(tie_key(F.col("gain")).desc(), "query_id")
        .limit(n)
    )


def beats(scores: DataFrame, winner: str, loser: str, n: int = 10) -> DataFrame:
    """Queries where one method ranks better than the other, by NDCG gain."""
    return (
        side_by_side(scores, winner, loser, "ndcg")
        .filter(tie_key(F.col("a_ndcg")) > tie_key(F.col("b_ndcg")))
        .withColumn("gain", F.col("a_ndcg") - F.col("b_ndcg"))
        .orderBy(tie_key(F.col("gain")).desc(), "query_id")
        .limit(n)
    )


def changes(scores: DataFrame, before: str, after: str) -> DataFrame:
    """query_id, before, after, diff, outcome; queries without a defined NDCG are left out."""
    diff = F.col("b_ndcg") - F.col("a_ndcg")
    outcome = (
        F.when(diff > EPSILON, "improved").when(diff < -EPSILON, "worsened").otherwise("unchanged")
    )
    return (
        side_by_side(scores, before, after, "ndcg")
        .dropna(subset=["a_ndcg", "b_ndcg"])
        .select(
            "query_id",
            F.col("a_ndcg").alias("before"),
            F.col("b_ndcg").alias("after"),
            diff.alias("diff"),
            outcome.alias("outcome"),
        )
    )


def outcome_counts(changed: DataFrame) -> DataFrame:
    """outcome, queries, share: always three rows."""
    names = ("improved", "unchanged", "worsened")
    one = changed.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count(F.when(F.col("outcome") == x, 1)).alias(x) for x in names],
    )
    rows = F.array(*[F.struct(F.lit(x).alias("outcome"), F.col(x).alias("queries")) for x in names])
    return one.select("total", F.explode(rows).alias("r")).select(
        "r.outcome",
        "r.queries",
        F.when(F.col("total") > 0, F.col("r.queries") / F.col("total")).otherwise(0.0).alias("share"),
    )


def largest(changed: DataFrame, outcome: str, n: int = 10) -> DataFrame:
    """The n most improved or most worsened queries."""
    size = tie_key(F.abs(F.col("diff")))
    return changed.filter(F.col("outcome") == outcome).orderBy(size.desc(), "query_id").limit(n)


def most_moved(changed: DataFrame, n: int = 6) -> DataFrame:
    return changed.orderBy(tie_key(F.abs(F.col("diff"))).desc(), "query_id").limit(n)


def top_lists(cases: DataFrame, rankings: DataFrame, methods: list[str], n: int = 5) -> DataFrame:
    """Add one array column per method: the ids of the top n (at most n per query)."""
    short = rankings.filter(F.col("rank") <= n).join(
        F.broadcast(cases.select("query_id")), "query_id", "left_semi"
    )
    lists = [
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("method") == m, F.struct("rank", "doc_id")))
            ),
            lambda x: x["doc_id"],
        ).alias(m)
        for m in methods
    ]
    return cases.join(short.groupBy("query_id").agg(*lists), "query_id", "left")


def known_judgments(cases: DataFrame, qrels: DataFrame) -> DataFrame:
    """Judged documents of a few queries, best grade first, as sorted rows (never as one list:
    a query may have any number of judgments)."""
    return (
        qrels.join(F.broadcast(cases.select("query_id")), "query_id", "left_semi")
        .select("query_id", "doc_id", "rel")
        .orderBy("query_id", F.col("rel").desc(), "doc_id")
    )
