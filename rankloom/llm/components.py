"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a minimum per node (combined before the shuffle) and a join of the edges with it,
so a node that holds a third of all edges is an ordinary skewed join and not a group in one
task. The number of rounds is logarithmic in the longest chain. Each round ends in a table in
the shared folder; nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.runtime import materialize


def _minimum(edges: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_minimum(both), "u").filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(low)
    moved = low.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """`edges(u, v)` of longs → `node, root` for every node that has an edge to another node;
    `root` is the smallest node of its component. Loops and repeated edges do no harm; rows with
    a null end are no edges. An empty table gives an empty table."""
    clean = edges.select("u", "v").filter("u <> v")
    now = materialize(
        clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        now = materialize(_small_star(_large_star(now)), "stars")
        after = _state(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
