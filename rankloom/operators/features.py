"""The 15 features of a (query, candidate) pair and the training rows made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import any_shared, contains_query, shared_tokens, token_set, tokens
from rankloom.operators.ranking import rank_by, with_grades
from rankloom.operators.rerank import attach
from rankloom.runtime import hinted

# Feature order of the ranker, with the direction in which each may act on the
# score (1 = never down, -1 = never up, 0 = free).
MONOTONE = {
    "ce_score": 1,
    "ce_rank": -1,
    "hybrid_score": 1,
    "bm25_norm": 1,
    "emb_norm": 1,
    "bm25_emb_gap": 0,
    "hybrid_rank": -1,
    "query_len": 0,
    "title_len": 0,
    "text_len_log": 0,
    "title_overlap_count": 1,
    "title_overlap_ratio": 1,
    "title_exact_contains": 1,
    "brand_match": 1,
    "color_match": 1,
}
FEATURES = tuple(MONOTONE)


def features(
    cands: DataFrame, queries: DataFrame, catalog: DataFrame, small: bool, texts_fit: bool = False
) -> DataFrame:
    """query_id, doc_id and the 15 feature columns, all double.

    `cands` carries ce_score, hybrid_score, hybrid_rank, bm25_norm and emb_norm; `catalog` has
    doc_id, title, brand, color and text. Missing texts have no tokens.
    """
    facts = catalog.select(
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("brand", F.lit("")).alias("brand"),
        F.coalesce("color", F.lit("")).alias("color"),
        F.coalesce("text", F.lit("")).alias("doc_text"),
    )
    rows = attach(cands, facts, ("title", "brand", "color", "doc_text"), small)
    named = queries.select("query_id", F.col("text").alias("query_text"))
    rows = rows.join(hinted(named, texts_fit), "query_id").withColumns(
        {
            "ce_rank": rank_by("ce_score", "hybrid_rank"),
            "q_tokens": tokens(F.col("query_text")),
            "t_tokens": tokens(F.col("title")),
        }
    )
    query_len = F.greatest(F.size("q_tokens"), F.lit(1))
    shared = shared_tokens(F.col("q_tokens"), F.col("t_tokens"))

    def matches(name: str) -> Column:
        known = F.when(F.lower(F.col(name)) == "nan", F.lit("")).otherwise(F.col(name))
        return any_shared(F.col("q_tokens"), token_set(known)).cast("int")

    exprs = {
        "ce_score": F.col("ce_score"),
        "ce_rank": F.col("ce_rank"),
        "hybrid_score": F.col("hybrid_score"),
        "bm25_norm": F.col("bm25_norm"),
        "emb_norm": F.col("emb_norm"),
        "bm25_emb_gap": F.col("bm25_norm") - F.col("emb_norm"),
        "hybrid_rank": F.col("hybrid_rank"),
        "query_len": query_len,
        "title_len": F.size("t_tokens"),
        "text_len_log": F.log1p(F.size(tokens(F.col("doc_text")))),
        "title_overlap_count": shared,
        "title_overlap_ratio": shared / query_len,
        "title_exact_contains": contains_query(F.col("title"), F.col("query_text")).cast("int"),
        "brand_match": matches("brand"),
        "color_match": matches("color"),
    }
    columns = [exprs[name].cast("double").alias(name) for name in FEATURES]
    return rows.select("query_id", "doc_id", *columns)


def training_rows(
    feature_rows: DataFrame, qrels: DataFrame, splits: DataFrame, small: bool = False
) -> DataFrame:
    """Features plus `label` (0 where unjudged) and `split`; the group is the query id.

    `small`: the pairs were checked to fit a broadcast."""
    return (
        with_grades(feature_rows, qrels, small)
        .withColumn("label", F.coalesce("rel", F.lit(0)).cast("int"))
        .drop("rel")
        .join(splits.select("query_id", "split"), "query_id")
    )
