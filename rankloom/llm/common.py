"""Byte-level text helpers and Arrow batch plumbing shared by the corpus operators.

Texts travel as UTF-8 bytes. `bytes.lower` changes A-Z only, and `bytes.split` without an
argument splits on exactly space and \\t \\n \\v \\f \\r.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = b" \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Upper to lower case for A-Z; every ASCII character that is no digit or letter becomes a space.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and non-ASCII characters."""
    return text.translate(WORD_TABLE).split() if text else []


def binary(column: pa.Array) -> list[bytes | None]:
    """A string or binary Arrow column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def map_arrow(
    df: DataFrame, step: Callable[[pa.RecordBatch], dict[str, object]], schema: str
) -> DataFrame:
    """Apply `step` to every Arrow batch; it returns the columns of `schema` by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = step(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    c.cast(f.type)
                    if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray))
                    else pa.array(c, f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def on_safe_names(
    docs: DataFrame, run: Callable[[DataFrame, dict[str, str]], DataFrame]
) -> DataFrame:
    """`run(docs, names)` under column names that clash with nothing and need no quoting; `names`
    leads from the given names to those. Columns that `run` adds replace given ones of the same
    name, so an operator may be run again over its own result."""
    safe = [f"c{i}" for i in range(len(docs.columns))]
    back = dict(zip(safe, docs.columns))
    found = run(docs.toDF(*safe), dict(zip(docs.columns, safe)))
    added = {c.lower() for c in found.columns if c not in back}
    return found.select(
        *(
            F.col(c).alias(back.get(c, c))
            for c in found.columns
            if c not in back or back[c].lower() not in added
        )
    )


def blank_free(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def same(left: Column, right: Column) -> Column:
    """Equality under which NULL equals NULL."""
    return left.eqNullSafe(right)
