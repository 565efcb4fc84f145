"""Text expressions. All of them stay in the JVM and inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators; runs of word characters.
SPACE = r"(?U)[\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]{2,}"


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def tokens(text: Column) -> Column:
    """Lower-cased pieces between white space; no text gives no tokens."""
    pieces = F.array_remove(F.split(F.lower(text), SPACE + "+"), "")
    return F.coalesce(pieces, _no_tokens())


def words(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), _no_tokens())


def ngram_array(words_array: Column) -> Column:
    """All words and all pairs of neighbouring words."""
    following = F.slice(words_array, 2, F.greatest(F.size(words_array), F.lit(1)))
    pairs = F.zip_with(words_array, following, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words_array, F.array_compact(pairs))


def explode_terms(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    """One row per non-null element of a computed array, as column `term`.

    The outer form keeps Spark from adding a filter on the array's size below the explode,
    which would compute the whole array a second time.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("term"))
    return rows.filter(F.col("term").isNotNull())


def explode_ngrams(df: DataFrame, words_col: str, *keep: str) -> DataFrame:
    """One row per word and per pair of neighbouring words, as column `term`."""
    w = F.col(words_col)
    following = F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))
    zipped = F.arrays_zip(w.alias("a"), following.alias("b"))
    pairs = df.select(*keep, F.explode_outer(zipped).alias("p"))
    both = F.array(F.col("p.a"), F.concat(F.col("p.a"), F.lit(" "), F.col("p.b")))
    return explode_terms(pairs, both, *keep)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def shared_tokens(left: Column, right: Column) -> Column:
    """How many distinct tokens two token arrays have in common."""
    return F.size(F.array_intersect(left, right))


def any_shared(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(left, right), F.lit(False))


def contains_query(title: Column, query: Column) -> Column:
    """The whole non-empty query occurs in the title, whatever the case."""
    found = F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lower(query))
    return F.coalesce((F.length(query) > 0) & found, F.lit(False))


def cut(text: Column, max_chars: int | None) -> Column:
    text = F.coalesce(text, F.lit(""))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def preview(text: Column, limit: int) -> Column:
    """At most `limit` characters, white space collapsed; a longer text ends in an ellipsis."""
    text = squeeze(F.coalesce(text, F.lit("")))
    short = F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(short)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def joined_text(columns) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return squeeze(F.concat_ws(" ", *parts))


def token_cosine(query: Column, text: Column) -> Column:
    """Overlap of two token sets as a cosine: a model-free pair scorer."""
    a, b = token_set(query), token_set(text)
    size = F.sqrt((F.size(a) * F.size(b)).cast("double"))
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))
