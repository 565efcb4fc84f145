"""Numbers out of text reports, as a job over text lines.

A line is read in one of three ways: a table row of cells between bars, a label with a number
behind a colon, or a factor such as "~ 40x faster". Lines keep their file and place, so that the
first or the last mention of a number can be told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the labels of the known numbers begin with, in lower case.
LABELS = {
    "search": "average search time",
    "rerank": "average rerank time",
    "ltr": "average ltr time",
    "cached": "average cached",
    "rss_before_mb": "rss before load",
    "rss_after_mb": "rss after load",
    "rss_peak_mb": "rss peak",
    "load_footprint_mb": "load footprint",
    "startup_s": "startup",
    "logical_cpus": "logical cpus",
    "physical_cpus": "physical cpus",
    "corpus": "corpus indexed",
    "cache_speedup_x": "faster",
}
MEASURE = r"^([^:|]+):\s*~?\s*(\d[\d,]*(?:\.\d+)?)\s*([A-Za-z%]*)"
FACTOR = r"~\s*(\d[\d,]*(?:\.\d+)?)\s*x\s+([A-Za-z]+)"
PHASES = ("cold", "warm")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line; `place` grows with the line's position in its file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def measures(lines: DataFrame) -> DataFrame:
    """file, place, label (lower case), value, unit of every line that states a number."""

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract("line", pattern, i)

    stated = F.col("line").rlike(MEASURE)
    label = F.when(stated, group(MEASURE, 1)).otherwise(group(FACTOR, 2))
    value = F.when(stated, group(MEASURE, 2)).otherwise(group(FACTOR, 1))
    unit = F.when(stated, group(MEASURE, 3)).otherwise(F.lit("x"))
    return lines.filter(stated | F.col("line").rlike(FACTOR)).select(
        "file", "place", F.lower(F.trim(label)).alias("label"), _number(value).alias("value"), unit.alias("unit")
    )


def latency_table(lines: DataFrame) -> DataFrame:
    """method, cold, warm from the table rows of latency reports; a later row of the same
    method and phase replaces an earlier one."""
    cells = F.transform(F.split("line", r"\|"), lambda c: F.trim(c))
    rows = lines.select("file", "place", cells.alias("c")).select(
        "file",
        "place",
        F.get("c", F.lit(1)).alias("method"),
        F.get("c", F.lit(2)).alias("phase"),
        _number(F.get("c", F.lit(3))).alias("mean"),
    )
    known = rows.filter(
        F.col("phase").isin(*PHASES) & F.col("mean").isNotNull() & (F.col("method") != "")
    )
    last = F.max_by("mean", F.struct("file", "place"))
    return known.groupBy("method").pivot("phase", list(PHASES)).agg(last)


def numbers(lines: DataFrame) -> DataFrame:
    """name, value: the first number stated under each known label."""
    named = F.coalesce(
        *(F.when(F.startswith("label", F.lit(start)), F.lit(name)) for name, start in LABELS.items())
    )
    return (
        measures(lines)
        .withColumn("name", named)
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.min_by("value", F.struct("file", "place")).alias("value"))
    )
