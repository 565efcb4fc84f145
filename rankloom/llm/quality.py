"""Quality rules whose cutoffs carry a guarantee on false rejections.

Each rule compares one ratio of a text with a cutoff; cutoffs are chosen per stratum (language)
on labelled documents. For a cutoff, k of the stratum's n good documents would be rejected. The
cutoff is accepted if a true rejection rate above the limit would give k or fewer rejections with
probability at most delta: an exact binomial bound. Cutoffs are tried from the loosest on and the
last one before the first failure is taken (fixed-sequence testing, so the number of cutoffs
costs nothing); delta is the error level divided by strata x rules (Bonferroni), and the limit is
divided by the number of rules, so that with confidence 1 - error every stratum's total rate of
falsely rejected documents stays below the limit.

Counts of all labelled documents go into one histogram per stratum and rule, combined before the
shuffle; each stratum is decided in a group of at most rules x cutoffs rows.

Defined results: a null text has no words and fails the base rules; a stratum with too few good
labels gets no cutoff, so its rules reject nothing; a null language is a stratum of its own;
repeated labels of a document count as good only if all are; null labels do not count.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, binary, map_arrow, same, table
from rankloom.runtime import materialize

SYMBOLS = b"#*$%&|<>"
LIMIT = 0.05
ERROR = 0.05
MIN_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """Reject where `column` exceeds the cutoff; cutoffs go from the loosest to the strictest."""

    name: str
    column: str
    cutoffs: tuple[float, ...]


def grid(high: float, low: float, steps: int) -> tuple[float, ...]:
    return tuple(round(high - (high - low) * i / steps, 6) for i in range(steps + 1))


RULES = (
    Rule("symbols", "symbol_ratio", grid(2.0, 0.0, 200)),
    Rule("dup_lines", "dup_line_ratio", grid(1.0, 0.0, 100)),
    Rule("repeats", "repeat_ratio", grid(1.0, 0.0, 100)),
    Rule("capitals", "upper_ratio", grid(1.0, 0.0, 100)),
    Rule("long_words", "mean_word", grid(30.0, 3.0, 108)),
    Rule("short_words", "neg_mean_word", grid(-1.0, -8.0, 112)),
)


def measures(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word),
    n_upper of a whole text."""
    if not text:
        return (0,) * 7
    found = text.split()
    n = len(found)
    blanks = len(text) - len(text.translate(None, BLANKS))
    points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    repeated = 0
    if n >= 3:
        windows = list(zip(found, found[1:], found[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
            inside = np.zeros(n, bool)
            for shift in range(3):
                inside[shift : shift + len(windows)] |= twice
            repeated = int(inside.sum())
    return n, points - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def ratio(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def features(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang"
) -> DataFrame:
    """doc_id, stratum, the counts, the ratios and base_failed of every row."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [measures(t) for t in binary(batch.column(1))]
        columns = zip(COUNTS, np.array(rows, np.int64).reshape(-1, len(COUNTS)).T)
        return {"doc_id": batch.column(0), "stratum": batch.column(2)} | dict(columns)

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds[id_col]}, stratum {kinds[stratum_col]}, " + ", ".join(f"{c} long" for c in COUNTS)
    mean = ratio("word_chars", "n_words")
    return map_arrow(docs.select(id_col, text_col, stratum_col), step, schema).withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "upper_ratio": ratio("n_upper", "word_chars"),
            "mean_word": mean,
            "neg_mean_word": -mean,
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), by the regularised incomplete beta function."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1.0 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    # Continued fraction, evaluated from the front with the two recurrences of its convergents.
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(tiny, 1.0 - (a + b) * x / (a + 1))
    value, m = d, 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / ((1.0 + term * d) or tiny)
            c = (1.0 + term / c) or tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-13 or m > 100_000:
            return front * value / a
        m += 1


def cutoff(rejected: np.ndarray, n: int, limit: float, delta: float) -> int:
    """Index of the strictest acceptable cutoff, -1 for none. rejected[i]: good documents over
    cutoff i, loosest first."""
    best = -1
    for i, k in enumerate(rejected):
        if binomial_cdf(int(k), n, limit) > delta:
            break
        best = i
    return best


def calibrate(
    measured: DataFrame,
    labels: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    limit: float = LIMIT,
    error: float = ERROR,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """stratum, cutoffs (map rule → cutoff) of every stratum with a labelled good document."""
    good = (
        labels.filter(F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.min(label_col).alias("_good"))
        .filter("_good = 1")
    )
    held = measured.filter(~F.col("base_failed")).join(good, "doc_id")

    def over(rule: Rule) -> Column:
        """How many cutoffs, loosest first, the value does not exceed."""
        return F.size(F.filter(F.array(*map(F.lit, rule.cutoffs)), lambda c: F.col(rule.column) <= c))

    bins = F.array(
        *(F.struct(F.lit(i).alias("rule"), over(r).alias("bin")) for i, r in enumerate(rules))
    )
    counts = materialize(
        held.select("stratum", F.explode(bins).alias("x"))
        .groupBy("stratum", "x.rule", "x.bin")
        .agg(F.count(F.lit(1)).alias("n")),
        "histogram",
    )
    n_strata = max(1, counts.select("stratum").distinct().count())
    delta, share = error / (n_strata * len(rules)), limit / len(rules)

    def decide(data: pa.Table) -> pa.Table:
        found = {}
        frame: pd.DataFrame = data.select(["rule", "bin", "n"]).to_pandas()
        for i, rule in enumerate(rules):
            own = frame[frame["rule"] == i]
            per_bin = np.bincount(own["bin"], weights=own["n"], minlength=len(rule.cutoffs) + 1)
            # A value that does not exceed b cutoffs (the loosest b) exceeds cutoffs b, b + 1, ...
            rejected = np.cumsum(per_bin)[: len(rule.cutoffs)]
            best = cutoff(rejected, int(per_bin.sum()), share, delta)
            if best >= 0:
                found[rule.name] = rule.cutoffs[best]
        return pa.table(
            {
                "stratum": data.column("stratum").slice(0, 1),
                "cutoffs": pa.array([list(found.items())], pa.map_(pa.string(), pa.float64())),
            }
        )

    kind = dict(measured.dtypes)["stratum"]
    return counts.groupBy("stratum").applyInArrow(
        decide, f"stratum {kind}, cutoffs map<string,double>"
    )


def judged(measured: DataFrame, cutoffs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`measured` plus failed_rules (sorted names) and kept."""
    chosen = cutoffs.withColumnRenamed("stratum", "_stratum")
    failed = F.array_compact(
        F.array(
            *(
                F.when(F.col(r.column) > F.col("cutoffs")[r.name], F.lit(r.name))
                for r in sorted(rules, key=lambda r: r.name)
            )
        )
    )
    return (
        measured.join(chosen, same(F.col("stratum"), F.col("_stratum")), "left")
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_stratum", "cutoffs")
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(features(table(spark, sf_dir, "documents")), "features")
    cutoffs = materialize(calibrate(measured, table(spark, sf_dir, "labels")), "cutoffs")
    return judged(measured, cutoffs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
