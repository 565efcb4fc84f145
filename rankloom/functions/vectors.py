"""Dense vector expressions over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it any number of times in `body`."""
    return F.transform(F.array(value), body)[0]


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vec: Column) -> Column:
    squares = F.transform(as_doubles(vec), lambda x: x * x)
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def unit_vector(vec: Column) -> Column:
    """Length 1; a vector of zeros stays as it is."""

    def scaled(v: Column) -> Column:
        return bound(
            norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))
        )

    return bound(as_doubles(vec), scaled)


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, inner_product(a, b) / size).otherwise(F.lit(0.0))


def letter_vector(text: Column) -> Column:
    """Unit vector of the counts of a to z: a model-free encoder for tests and examples. Letters
    are of one byte each, and the bytes of a text are known where its characters must be counted."""

    def counts(low: Column) -> Column:
        return F.array(
            *[
                (F.octet_length(low) - F.octet_length(F.replace(low, F.lit(chr(c))))).cast("double")
                for c in range(ord("a"), ord("z") + 1)
            ]
        )

    return unit_vector(bound(F.lower(F.coalesce(text, F.lit(""))), counts))
