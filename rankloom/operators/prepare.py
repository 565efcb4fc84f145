"""Profiling, cleaning and joining of the judgment and catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import joined_text, token_count
from rankloom.schema import require_columns

# Grade of each judgment label; text columns in reading order.
LABEL_GRADES = {"E": 3, "S": 2, "C": 1, "I": 0}
TEXT_COLUMNS = (
    "product_title",
    "product_description",
    "product_bullet_point",
    "product_brand",
    "product_color",
)


def profile(df: DataFrame) -> DataFrame:
    """column_name, n_nulls, n_rows for every column, in one pass."""
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"nulls_{c}") for c in df.columns],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"nulls_{c}").alias("n_nulls"))
            for c in df.columns
        ]
    )
    return one.select("n_rows", F.explode(rows).alias("r")).select(
        "r.column_name", "r.n_nulls", "n_rows"
    )


def first_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(key).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each value; NULL is a value of its own."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_counts(df: DataFrame, columns) -> DataFrame:
    """One row with the number of distinct non-null values of each column."""
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


def keep_locale(df: DataFrame, locale: str = "us", column: str = "product_locale") -> DataFrame:
    """Rows of one locale, whatever the case; all rows if the locale does not occur."""
    if column not in df.columns:
        return df
    matches = F.lower(F.col(column)) == locale.lower()
    present = df.select(F.coalesce(F.bool_or(matches), F.lit(False))).scalar()
    return df.filter(matches | ~present)


def grade(df: DataFrame, label: str = "esci_label") -> DataFrame:
    """Add relevance_score 0..3; rows with any other label are dropped."""
    value: Column = F.lit(None)
    for name, points in LABEL_GRADES.items():
        value = F.when(F.col(label) == name, points).otherwise(value)
    graded = df.withColumn("relevance_score", value.cast("int"))
    return graded.dropna(subset=["relevance_score"])


def drop_missing(df: DataFrame, columns=("query", "product_id", "esci_label")) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def join_catalog(judgments: DataFrame, catalog: DataFrame) -> DataFrame:
    """Inner join on product and locale, or on the product alone if a side has no locale."""
    require_columns(judgments, ["product_id"], "judgments")
    require_columns(catalog, ["product_id"], "catalog")
    keys = ["product_id"]
    if "product_locale" in judgments.columns and "product_locale" in catalog.columns:
        keys.append("product_locale")
    return judgments.join(catalog, keys, "inner")


def add_product_text(df: DataFrame) -> DataFrame:
    present = [c for c in TEXT_COLUMNS if c in df.columns]
    if not present:
        require_columns(df, TEXT_COLUMNS[:1])
    return df.withColumn("product_text", joined_text(present))


def drop_empty_text(df: DataFrame) -> DataFrame:
    kept = df.filter(F.length("product_text") > 0)
    return drop_missing(kept, ("query", "product_id", "esci_label", "product_text"))


def add_query_length(df: DataFrame) -> DataFrame:
    return df.withColumn("query_length", token_count(F.col("query")))


def query_length_stats(df: DataFrame) -> DataFrame:
    """Mean, smallest and largest number of words and the share (%) of three length classes."""
    n = F.col("query_length")

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 100.0).otherwise(0.0))

    return df.agg(
        F.avg(n).alias("mean_len"),
        F.min(n).alias("min_len"),
        F.max(n).alias("max_len"),
        share(n.between(1, 2)).alias("pct_1_2"),
        share(n.between(3, 5)).alias("pct_3_5"),
        share(n >= 6).alias("pct_6_plus"),
    )


def query_length_histogram(df: DataFrame, clip: int = 15) -> DataFrame:
    """Distinct queries per number of words; long ones share the last class."""
    lengths = df.select("query").distinct().select(
        F.least(token_count(F.col("query")), F.lit(clip)).alias("words")
    )
    return lengths.groupBy("words").agg(F.count(F.lit(1)).alias("n_queries"))


def corpus(df: DataFrame, order: str = "example_id", columns=("product_text",)) -> DataFrame:
    """One row per product: the first in `order`. A minimum with map-side combine, so a
    product that fills a third of the table is no burden to any task."""
    first = F.min_by(F.struct(*columns), F.struct(F.col(order), *columns)).alias("first")
    return df.groupBy(F.col("product_id").alias("doc_id")).agg(first).select("doc_id", "first.*")


def qrels(df: DataFrame) -> DataFrame:
    """query, doc_id, rel: the highest grade given to each (query, product)."""
    return df.groupBy("query", F.col("product_id").alias("doc_id")).agg(
        F.max("relevance_score").cast("int").alias("rel")
    )
