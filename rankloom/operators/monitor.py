"""Reports over a search log: latency, averages, hit rate, throughput."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.runtime import hinted, materialize

BROADCAST_GROUPS = 200_000


def exact_medians(df: DataFrame, by: tuple[str, ...], value: str, accuracy: int = 10_000) -> DataFrame:
    """by..., median. Exact, without gathering a group in one task.

    A sketch gives bounds that enclose the median ranks of each group. Rows below the bounds
    are only counted; rows inside are counted per distinct value, before they are moved, and the
    middle values are read off the running counts of that narrow band. Should a band miss the
    middle, its group is measured again with a wider one, in the end with its whole range.
    A NULL in `by` is a group like any other.
    """
    log = df.filter(F.col(value).isNotNull())
    found = None
    for margin in (2.0 / accuracy, 20.0 / accuracy, 0.5):
        medians = materialize(_banded_medians(log, by, value, accuracy, margin), "medians")
        hit = medians.filter(F.col("median").isNotNull())
        found = hit if found is None else found.unionByName(hit)
        missed = medians.filter(F.col("median").isNull()).drop("median")
        if missed.isEmpty():
            break
        log = _matched(log, missed, by, "left_semi")
    return found


def _matched(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str) -> DataFrame:
    """Join a log with a table of one row per group, broadcast if its counted rows are few."""
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    joined = left.join(hinted(renamed, right.count() <= BROADCAST_GROUPS), same, how)
    return joined.drop(*(f"_{c}" for c in by))


def _banded_medians(
    df: DataFrame, by: tuple[str, ...], value: str, accuracy: int, margin: float
) -> DataFrame:
    """by..., median; NULL where the band does not hold the middle."""
    sketch = F.percentile_approx(
        value, F.array(F.lit(max(0.0, 0.5 - margin)), F.lit(min(1.0, 0.5 + margin))), F.lit(accuracy)
    )
    bounds = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("a"), F.max(value).alias("z"), sketch.alias("b")
    )
    whole = F.lit(margin >= 0.5)
    bounds = bounds.select(
        *by,
        "n",
        F.when(whole, F.col("a")).otherwise(F.col("b")[0]).alias("low"),
        F.when(whole, F.col("z")).otherwise(F.col("b")[1]).alias("high"),
    )
    v = F.col(value)
    # One row per group: the table of bounds is as small as the report itself.
    placed = _matched(df, materialize(bounds, "bounds"), by, "inner").filter(v <= F.col("high"))
    banded = placed.withColumn("v", F.when(v >= F.col("low"), v))
    counts = banded.groupBy(*by, "n", "v").agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy(*by).orderBy(F.col("v").asc_nulls_first())
    up_to = F.sum("c").over(running.rowsBetween(Window.unboundedPreceding, 0))
    lower, upper = F.ceil(F.col("n") / 2), F.floor(F.col("n") / 2) + 1

    def holds(position):
        return F.max(F.when((F.col("s") >= position) & (F.col("s") - F.col("c") < position), F.col("v")))

    return (
        counts.withColumn("s", up_to)
        .groupBy(*by)
        .agg(((holds(lower) + holds(upper)) / 2.0).alias("median"))
    )


def latency(log: DataFrame, by: tuple[str, ...] = ("method", "phase"), value: str = "latency_ms") -> DataFrame:
    """Calls, mean, median, smallest and largest latency per group."""
    plain = log.groupBy(*by).agg(
        F.count(value).alias("calls"),
        F.avg(value).alias("mean_ms"),
        F.min(value).alias("min_ms"),
        F.max(value).alias("max_ms"),
    )
    medians = exact_medians(log, by, value).withColumnRenamed("median", "median_ms")
    return _matched(plain, medians, by, "left")


def stage_averages(log: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Mean of the methods' cold means, and the flat mean over all warm calls."""
    means = log.groupBy("phase", "method").agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    cold = F.col("phase") == "cold"
    warm = F.col("phase") == "warm"
    return means.agg(
        F.avg(F.when(cold, F.col("m"))).alias("cold_mean_of_means"),
        (F.sum(F.when(warm, F.col("s"))) / F.sum(F.when(warm, F.col("n")))).alias("warm_mean"),
    )


def hit_rate(log: DataFrame, cached: str = "cached") -> DataFrame:
    """Share of calls answered from the cache, 4 decimals, 0 for an empty log."""
    hit = F.col(cached).cast("int")
    return log.agg(
        F.coalesce(F.sum(hit), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(1 - hit), F.lit(0)).alias("misses"),
        F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 4).alias("hit_rate"),
    )


def throughput(log: DataFrame, value: str = "latency_ms") -> DataFrame:
    """Per method: scored pairs, busy seconds, pairs per second and ms per pair."""
    seconds = F.sum(value) / 1000.0
    n = F.count(F.lit(1))
    return log.groupBy("method").agg(
        n.alias("pairs"),
        seconds.alias("seconds"),
        F.when(seconds > 0, n / seconds).alias("pairs_per_second"),
        (F.sum(value) / n).alias("ms_per_pair"),
    )
