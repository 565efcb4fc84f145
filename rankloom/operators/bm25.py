"""Okapi BM25 for many queries at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.scores import tie_key
from rankloom.operators import blocksearch
from rankloom.operators.ranking import top_k
from rankloom.operators.textindex import TextIndex, pair_sums, sum_of_products
from rankloom.runtime import QuerySet, hinted

# Term saturation, length normalisation, share of the mean idf that replaces a
# negative one.
K1 = 1.5
B = 0.75
IDF_FLOOR = 0.25


def _plain_idf(n_docs: int) -> Column:
    df = F.col("df")
    return F.ln(F.lit(n_docs) - df + F.lit(0.5)) - F.ln(df + F.lit(0.5))


def idf_table(index: TextIndex) -> DataFrame:
    """term, df, idf. A word in more than half of the documents gets the floor."""
    idf = _plain_idf(index.n_docs)
    floor = F.lit(IDF_FLOOR) * index.terms.select(F.avg(idf)).scalar()
    return index.terms.select("term", "df", F.when(idf < 0, floor).otherwise(idf).alias("idf"))


def _average_length(index: TextIndex) -> float:
    return float((index.total_len / index.n_docs if index.n_docs else 1.0) or 1.0)


def _term_value(index: TextIndex) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(_average_length(index))))


def _weights(queries: QuerySet, index: TextIndex) -> DataFrame:
    said = hinted(index.query_terms(queries.texts), queries.terms_fit)
    return idf_table(index).join(said, "term").select(
        "query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight")
    )


def scores(queries: QuerySet, index: TextIndex) -> DataFrame:
    """query_id, doc_id, score of every document that shares a word with one of few queries."""
    return sum_of_products(
        index.postings_of,
        index.vocabulary_of(queries.texts),
        _weights(queries, index),
        _term_value(index),
    )


def _array_value(index: TextIndex) -> blocksearch.Value:
    """`_term_value` over arrays."""
    average = _average_length(index)

    def value(tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))

    return value


def _in_blocks(queries: QuerySet, index: TextIndex) -> bool:
    """A stored index answers few queries from its term buckets; texts are scanned in blocks
    however few the queries, unless ids repeat."""
    return not queries.terms_fit or index.texts is not None and index.unique


def _best(queries: QuerySet, index: TextIndex, k: int) -> DataFrame:
    if not _in_blocks(queries, index):
        return top_k(scores(queries, index), k)
    return blocksearch.retrieve(
        index.forward(), _weights(queries, index), queries, _array_value(index), k, index.rows is not None
    )


def pair_scores(
    pairs: DataFrame, queries: QuerySet, index: TextIndex, name: str = "score"
) -> DataFrame:
    """Add the BM25 score of each listed (query, doc) pair."""
    if _in_blocks(queries, index):
        return blocksearch.pair_sums(
            index.forward(), _weights(queries, index), queries, _array_value(index), pairs, name
        )
    return pair_sums(
        index.postings_of,
        index.postings,
        index.vocabulary_of(queries.texts),
        _weights(queries, index),
        pairs,
        queries,
        _term_value(index),
        name,
    )


def retrieve(
    queries: QuerySet, index: TextIndex, k: int = 10, fill: DataFrame | None = None
) -> DataFrame:
    """query_id, doc_id, score, rank.

    Only documents sharing a word are returned. With `fill` (the documents' ids) short lists
    are completed to k by score-0 documents in id order. Queries too many to broadcast are
    scored in blocks of documents.
    """
    ranked = _best(queries, index, k)
    return ranked if fill is None else fill_up(ranked, queries, fill, k)


def fill_up(ranked: DataFrame, queries: QuerySet, ids: DataFrame, k: int) -> DataFrame:
    """Complete every query's list to k rows.

    A list of m < k rows misses k - m; the first 2k ids hold at least k unlisted ones, so a
    fixed 2k ids per query suffice, whatever the size of the corpus.
    """
    first = ids.select("doc_id").orderBy("doc_id").limit(2 * k)
    spare = first.agg(F.array_sort(F.collect_list("doc_id"))).scalar()
    listed = ranked.groupBy("query_id").agg(F.collect_list("doc_id").alias("listed"))
    joined = queries.df.select("query_id").join(listed, "query_id", "left")
    empty = F.array().cast(ranked.select(F.collect_list("doc_id")).schema[0].dataType)
    have = F.coalesce("listed", empty)
    padding = (
        joined.withColumn("m", F.size(have))
        .filter(F.col("m") < k)
        .select("query_id", "m", F.posexplode(F.array_except(spare, have)).alias("i", "doc_id"))
        .filter(F.col("m") + F.col("i") < k)
        .select(
            "query_id",
            "doc_id",
            F.lit(0.0).alias("score"),
            (F.col("m") + F.col("i") + 1).cast("int").alias("rank"),
        )
    )
    filled = ranked.unionByName(padding)
    order = Window.partitionBy("query_id").orderBy(tie_key(F.col("score")).desc(), "rank")
    return filled.withColumn("rank", F.row_number().over(order))
