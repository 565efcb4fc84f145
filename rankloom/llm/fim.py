"""Fill-in-the-middle examples by regular expressions with counted quantifiers.

A text is a row of units; a unit is whatever a short pattern matches, one code point by default.
`regexp_count` tells how many units a text has, two keyed numbers choose where it is cut, and a
pattern built for that row, possessive unit{a}+ and unit{b-a}+ groups and the rest, captures
prefix, middle and suffix in one match; the replacement puts them in the wanted order between
sentinels. Counting takes whole blocks of units first and the rest one by one, so a text of n
units gives n / 512 + 511 short strings at most. Every loop of these patterns runs over a single
unit and never backtracks, so neither the stack nor the time grows worse than the text.

Built-in functions in one stage: no shuffle, no Python, no state besides the row.

Defined results: a null text counts as an empty one; an empty text or one that holds a sentinel
stays plain; a null id is hashed as an empty one; repeated rows give repeated results (cuts
depend on the id alone); an empty table gives an empty one. Other columns are not read, so their
names do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import blank_free, quoted, table

CODE_POINT = "(?s:.)"
BLOCK = 512


@dataclass(frozen=True)
class FimParams:
    """`unit` must match every text piece by piece without gaps and have no capturing group; the
    shares are in percent."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = CODE_POINT
    seed: str = "1:"
    transformed: int = 90
    spm: int = 20


def count_units(text: Column, unit: str = CODE_POINT, block: int = BLOCK) -> Column:
    """How many units a text has, as a long."""
    whole = f"(?:{unit}){{{block}}}+"
    rest = F.regexp_replace(text, whole, "")
    return (
        F.regexp_count(text, F.lit(whole)).cast("long") * block
        + F.regexp_count(rest, F.lit(unit))
    )


def keyed(id_column: Column, seed: str) -> list[Column]:
    """Four numbers of 32 bits from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(seed), blank_free(id_column.cast("string"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_pattern(first: Column, second: Column, unit: str) -> Column:
    """The pattern of one row: `first` units, `second` units and the rest."""
    return F.concat(
        F.lit(rf"\A((?:{unit}){{"),
        first.cast("string"),
        F.lit(rf"}}+)((?:{unit}){{"),
        second.cast("string"),
        F.lit(r"}+)((?s:.*+))\z"),
    )


def _literal(text: str) -> str:
    """`text` as it is in a pattern."""
    return "".join(c if c.isalnum() else f"\\{c}" for c in text)


def _shapes(p: FimParams) -> dict[str, str]:
    """Replacements that order prefix ($1), middle ($2) and suffix ($3)."""
    return {
        "psm": f"{p.prefix}$1{p.suffix}$3{p.middle}$2",
        "spm": f"{p.suffix}$3{p.prefix}$1{p.middle}$2",
    }


def transform(
    docs: DataFrame, params: FimParams = FimParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n, form (plain, psm or spm), prefix_units, middle_units (null if plain), output."""
    h1, h2, h3, h4 = keyed(F.col("id"), params.seed)
    marks = F.lit(False)
    for mark in (params.prefix, params.suffix, params.middle):
        marks = marks | F.contains("text", F.lit(mark))
    form = (
        F.when((F.col("text") == "") | marks | (h3 % 100 >= params.transformed), "plain")
        .when(h4 % 100 < params.spm, "spm")
        .otherwise("psm")
    )
    counted = docs.select(
        F.col(quoted(id_col)).alias("id"), blank_free(F.col(quoted(text_col))).alias("text")
    ).withColumn("n", count_units(F.col("text"), params.unit))
    cut = counted.select(
        "id",
        "text",
        "n",
        form.alias("form"),
        F.least(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("a"),
        F.greatest(h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)).alias("b"),
    )
    shapes = _shapes(params)
    moved = F.regexp_replace(
        "text",
        cut_pattern(F.col("a"), F.col("b") - F.col("a"), params.unit),
        F.when(F.col("form") == "spm", shapes["spm"]).otherwise(shapes["psm"]),
    )
    plain = F.col("form") == "plain"
    return cut.select(
        F.col("id").alias(id_col),
        "n",
        "form",
        F.when(~plain, F.col("a")).alias("prefix_units"),
        F.when(~plain, F.col("b") - F.col("a")).alias("middle_units"),
        F.when(plain, F.col("text")).otherwise(moved).alias("output"),
    )


def restore(output: Column, form: Column, params: FimParams = FimParams()) -> Column:
    """The text from which an output was made. No sentinel occurs in a text that was cut, and
    none can arise where a part meets a sentinel, because its first character occurs once in it."""
    p, s, m = map(_literal, (params.prefix, params.suffix, params.middle))
    psm = rf"(?s)\A{p}(.*?){s}(.*?){m}(.*+)\z"
    spm = rf"(?s)\A{s}(.*?){p}(.*?){m}(.*+)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, psm, "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, spm, "$2$3$1"))
        .otherwise(output)
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13_SQL = """
WITH keyed AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
numbers AS (
    SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS k
    FROM keyed),
cut AS (
    SELECT doc_id, t, n, least(k[1] % (n + 1), k[2] % (n + 1)) AS a,
        greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
            OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
part AS (
    SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM part
"""
