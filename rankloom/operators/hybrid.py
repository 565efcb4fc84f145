"""Candidate pools from two retrievers and their weighted fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.scores import fused, min_max, tie_key
from rankloom.operators import bm25, dense
from rankloom.operators.ranking import top_k
from rankloom.operators.textindex import TextIndex
from rankloom.runtime import QuerySet

# The (bm25, dense) weights that are compared, in order of preference.
WEIGHT_GRID = ((0.5, 0.5), (0.7, 0.3), (0.6, 0.4), (0.4, 0.6))


def candidates(
    queries: QuerySet, index: TextIndex, vectors: DataFrame, pool: int = 100
) -> DataFrame:
    """query_id, doc_id, bm25_rank, emb_rank, bm25, emb, bm25_norm, emb_norm.

    The pool of a query is the distinct union of both top lists (at most 2 * pool rows). Every
    member gets both raw scores; each is stretched to [0, 1] within the pool. The ranks are
    those of the pure lists, NULL where a list does not hold the document.
    """
    no_rank = F.lit(None).cast("int")
    lexical = bm25.retrieve(queries, index, pool).select(
        "query_id", "doc_id", F.col("rank").alias("bm25_rank"), no_rank.alias("emb_rank")
    )
    semantic = dense.retrieve(queries, vectors, pool).select(
        "query_id", "doc_id", no_rank.alias("bm25_rank"), F.col("rank").alias("emb_rank")
    )
    members = (
        lexical.unionByName(semantic)
        .groupBy("query_id", "doc_id")
        .agg(F.max("bm25_rank").alias("bm25_rank"), F.max("emb_rank").alias("emb_rank"))
    )
    scored = bm25.pair_scores(members, queries, index, "bm25")
    scored = dense.pair_scores(scored, queries, vectors, 2 * pool, "emb")
    return scored.withColumns({"bm25_norm": min_max("bm25"), "emb_norm": min_max("emb")})


def pure(cands: DataFrame, side: str, k: int = 10) -> DataFrame:
    """The top k of one retriever alone (`side` is `bm25` or `emb`), read off the pool."""
    rank = F.col(f"{side}_rank")
    return cands.filter(rank <= k).select(
        "query_id", "doc_id", F.col(side).alias("score"), rank.alias("rank")
    )


def fuse(cands: DataFrame, alpha: float, beta: float, k: int = 10) -> DataFrame:
    """Top k by alpha * bm25_norm + beta * emb_norm; the pool's columns are kept."""
    score = fused(F.col("bm25_norm"), F.col("emb_norm"), F.lit(alpha), F.lit(beta))
    return top_k(cands.withColumn("score", score), k)


def retrieve(
    queries: QuerySet,
    index: TextIndex,
    vectors: DataFrame,
    k: int = 10,
    alpha: float = 0.5,
    beta: float = 0.5,
    pool: int = 100,
) -> DataFrame:
    return fuse(candidates(queries, index, vectors, pool), alpha, beta, k)


def sweep(cands: DataFrame, grid=WEIGHT_GRID, k: int = 10) -> DataFrame:
    """One ranking per weight pair; `method` is the position in the grid."""
    settings = F.array(
        *[
            F.struct(
                F.lit(str(i)).alias("method"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")
            )
            for i, (a, b) in enumerate(grid)
        ]
    )
    tried = cands.withColumn("s", F.explode(settings)).withColumn(
        "score", fused(F.col("bm25_norm"), F.col("emb_norm"), F.col("s.alpha"), F.col("s.beta"))
    )
    tried = tried.select("query_id", "doc_id", "score", F.col("s.method").alias("method"))
    return top_k(tried, k, by=("method", "query_id"))


def best_weights(means: DataFrame, grid=WEIGHT_GRID) -> DataFrame:
    """One row (alpha, beta, ndcg): the first weight pair with the highest mean NDCG."""
    position = F.col("method").cast("int")
    alphas = F.array(*[F.lit(a) for a, _ in grid])
    betas = F.array(*[F.lit(b) for _, b in grid])
    return (
        means.orderBy(tie_key(F.col("ndcg")).desc(), position)
        .limit(1)
        .select(alphas[position].alias("alpha"), betas[position].alias("beta"), "ndcg")
    )
