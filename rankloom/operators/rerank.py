"""Second stage: score (query, text) pairs with a model and reorder short candidate lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import cut
from rankloom.operators.ranking import top_k
from rankloom.runtime import hinted

# A pair scorer maps a query text column and a document text column to a score column.
Scorer = Callable[[Column, Column], Column]


def model_scorer(make_scorer: Callable, batch_size: int = 32) -> Scorer:
    """Wrap a pair model. `make_scorer()` loads it once per Python worker and returns a
    function of two text arrays; pairs of all queries share the Arrow batches."""
    return predict_batch_udf(make_scorer, return_type=T.DoubleType(), batch_size=batch_size)


def attach(pairs: DataFrame, table: DataFrame, columns: tuple[str, ...], small: bool) -> DataFrame:
    """Add text columns of a large table to a short pair list, '' where there is none.

    The list's ids first thin out the large table (without shuffling it when `small` says the
    list was checked to fit a broadcast); only the rows needed meet the list.
    """
    ids = pairs.select("doc_id").distinct()
    needed = table.select("doc_id", *columns).join(hinted(ids, small), "doc_id", "left_semi")
    joined = pairs.join(needed, "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in columns})


def text_pairs(
    cands: DataFrame, queries: DataFrame, corpus: DataFrame, max_chars: int | None, small: bool, texts_fit: bool = False
) -> DataFrame:
    """Candidates plus `query_text` and `doc_text` (cut to `max_chars` if given).

    `small`: the candidates' ids were checked to fit a broadcast; `texts_fit`: the query texts,
    by their measured bytes.
    """
    texts = corpus.select("doc_id", cut(F.col("text"), max_chars).alias("doc_text"))
    named = queries.select("query_id", F.col("text").alias("query_text"))
    return attach(cands, texts, ("doc_text",), small).join(hinted(named, texts_fit), "query_id")


def score_pairs(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    score = scorer(F.col("query_text"), F.col("doc_text"))
    return pairs.withColumn("ce_score", score.cast("double"))


def reorder(scored: DataFrame, k: int = 10) -> DataFrame:
    """Top k by pair score; equal scores keep the order of the first stage (`rank`)."""
    first = scored.withColumnRenamed("rank", "hybrid_rank").withColumn("score", F.col("ce_score"))
    return top_k(first, k, tie="hybrid_rank")


def rerank(
    cands: DataFrame,
    queries: DataFrame,
    corpus: DataFrame,
    scorer: Scorer,
    k: int = 10,
    max_chars: int | None = None,
    small: bool = False,
    texts_fit: bool = False,
) -> DataFrame:
    """query_id, doc_id, score, rank, hybrid_rank of ranked candidate lists."""
    pairs = text_pairs(
        cands.select("query_id", "doc_id", "rank"), queries, corpus, max_chars, small, texts_fit
    )
    return reorder(score_pairs(pairs, scorer), k).select(
        "query_id", "doc_id", "score", "rank", "hybrid_rank"
    )
