"""Seeded samples and splits.

Rows are ordered by the md5 of seed and key: the same rows are drawn on any number of
executors. Exact positions come from counts of hash prefixes, so no group, however large, is
ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.runtime import hinted, materialize

SEED = 42
BROADCAST_ROWS = 500_000
PREFIX = 4  # hex digits: 65,536 evenly filled hash ranges


def hash_key(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def with_position(
    df: DataFrame,
    key: str,
    by: tuple[str, ...] = (),
    at_most: Column | None = None,
    seed: int = SEED,
    total: int | None = None,
) -> DataFrame:
    """Add `position`, 1.. in hash order within each `by` group (non-null columns).

    With `at_most`, only rows up to that position remain; hash ranges beyond it are dropped
    before rows are moved. `key` must be unique within a group.

    The table of ranges is broadcast where its size has a bound: 65,536 rows without groups,
    and with groups no more than the `total` rows that remain, since no range is empty.
    """
    hashed = df.withColumn("_h", hash_key(key, seed)).withColumn("_r", F.substring("_h", 1, PREFIX))
    counts = hashed.groupBy(*by, "_r").agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.withColumn("_before", F.sum("_n").over(up_to) - F.col("_n"))
    if at_most is not None:
        ranges = ranges.filter(F.col("_before") < at_most)
    within = Window.partitionBy(*by, "_r").orderBy("_h", key)
    bounded = not by or (total is not None and total <= BROADCAST_ROWS)
    placed = hashed.join(hinted(ranges.drop("_n"), bounded), [*by, "_r"]).withColumn(
        "position", F.row_number().over(within) + F.col("_before")
    )
    if at_most is not None:
        placed = placed.filter(F.col("position") <= at_most)
    return placed.drop("_h", "_r", "_before")


def balanced_sample(
    df: DataFrame, label: str, key: str, target: int = 50_000, seed: int = SEED
) -> DataFrame:
    """floor(target / number of labels) rows of each label, or all it has."""
    per_label = F.floor(F.lit(target) / df.select(F.count_distinct(label)).scalar())
    return with_position(df, key, (label,), per_label, seed, target).drop("position")


def topped_up_sample(
    df: DataFrame, label: str, key: str, target: int = 50_000, seed: int = SEED
) -> DataFrame:
    """The balanced sample, completed to `target` from the rows it left out."""
    df = materialize(df, "sampled-from")  # read four times below
    base = materialize(balanced_sample(df, label, key, target, seed), "sample")
    # The sample has at most `target` rows.
    rest = df.join(hinted(base.select(key), target <= BROADCAST_ROWS), key, "left_anti")
    need = F.lit(target) - base.select(F.count(F.lit(1))).scalar()
    extra = with_position(rest, key, (), need, seed).drop("position")
    return base.unionByName(extra)


def shuffled(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(hash_key(key, seed), key)


def pick(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows in hash order, for small fixed n (a display sample, an evaluation set)."""
    return df.orderBy(hash_key(key, seed), key).limit(n)


def evaluation_queries(
    qrels: DataFrame, query: str = "query", n: int = 3_000, threshold: int = 1, seed: int = SEED
) -> DataFrame:
    """Queries with at least one relevant judgment, up to n of them."""
    useful = qrels.groupBy(query).agg(F.max("rel").alias("best")).filter(F.col("best") >= threshold)
    return pick(useful.select(query), query, n, seed)


def split_queries(
    queries: DataFrame,
    key: str = "query",
    train: float = 0.75,
    validation: float = 0.15,
    seed: int = SEED,
) -> DataFrame:
    """Add `split`: a share of the queries trains (a part of it validates), the rest tests."""
    total = queries.select(F.count(F.lit(1))).scalar()
    n_train = F.floor(total * F.lit(train))
    n_validation = F.greatest(F.lit(1), F.floor(n_train * F.lit(validation)))
    place = F.col("position")
    split = (
        F.when((place <= n_validation) & (place <= n_train), "validation")
        .when(place <= n_train, "train")
        .otherwise("test")
    )
    return with_position(queries, key, seed=seed).withColumn("split", split).drop("position")
