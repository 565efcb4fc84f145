"""Score arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rankloom.config import SearchOptions

# Scores that differ by less than this many decimals tie.
TIE_DECIMALS = 9


def tie_key(score: Column) -> Column:
    """Score in units of the last significant decimal (cheaper than a decimal rounding)."""
    return F.rint(score * F.lit(10.0**TIE_DECIMALS))


def min_max(score: str, by: tuple[str, ...] = ("query_id",)) -> Column:
    """Stretch a score to [0, 1] within its group; a flat group becomes 0."""
    group = Window.partitionBy(*by)
    low, high = F.min(score).over(group), F.max(score).over(group)
    spread = high - low
    return F.when(spread < 1e-12, F.lit(0.0)).otherwise((F.col(score) - low) / spread)


def fused(bm25_norm: Column, emb_norm: Column, alpha, beta) -> Column:
    return alpha * bm25_norm + beta * emb_norm


def discounted(rel: Column, rank: Column) -> Column:
    """Gain of one result, linear in its grade."""
    return rel / F.log2(rank + F.lit(1.0))


def discount_sums(k: int) -> list[float]:
    """sums[m] = total discount of the ranks 1..m."""
    sums = [0.0]
    for rank in range(1, k + 1):
        sums.append(sums[-1] + 1.0 / math.log2(rank + 1))
    return sums


def confidence(score: Column, method: Column, options: SearchOptions = SearchOptions()) -> Column:
    """Map a raw score to [0, 1], each method in its own way."""
    clamped = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))
    logistic = F.lit(1.0) / (F.lit(1.0) + F.exp(-clamped))
    positive = F.greatest(F.lit(0.0), score)
    saturating = positive / (positive + F.lit(options.bm25_saturation))
    value = (
        F.when(method.isin("rerank", "ltr"), logistic)
        .when(method == "bm25", saturating)
        .otherwise(F.least(F.lit(1.0), positive))
    )
    return F.round(value, 6)


def _decimal(value: Column, pattern: str) -> Column:
    """Half-even on the exact binary value (`format_string` would round the printed digits)."""
    return F.call_function("format_number", value, F.lit(pattern))


def percent_label(share: Column) -> Column:
    return F.concat(_decimal(share * 100.0, "0.0"), F.lit("%"))


def duration_label(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(_decimal(ms, "0.0"), F.lit(" ms"))).otherwise(
        F.concat(_decimal(ms / 1000.0, "0.00"), F.lit(" s"))
    )
