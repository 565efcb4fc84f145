"""Reading and writing of the project's tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rankloom.schema import SAMPLE_REQUIRED, require_columns


class TableNotFound(FileNotFoundError):
    pass


def _reading(path: str, name: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise TableNotFound(f"no {name} table at {path}") from error
        raise


def read_parquet(
    spark: SparkSession, path: str, name: str = "table", schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _reading(path, name, lambda: reader.parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, name: str = "table") -> DataFrame:
    """CSV with a header line and an explicit schema."""
    reader = spark.read.schema(schema).options(header=True, escape='"')
    return _reading(path, name, lambda: reader.csv(path))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The cleaned sample, checked for the columns every evaluation needs."""
    return require_columns(read_parquet(spark, path, "sample"), SAMPLE_REQUIRED, "sample")


def write_sample(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_preview(df: DataFrame, path: str, key: str, n: int = 100) -> None:
    """The first n rows by `key` as one CSV file."""
    _csv(df.orderBy(key).limit(n), path)


def write_results(rows: DataFrame, path: str) -> None:
    _csv(rows, path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric or comparison tables as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
