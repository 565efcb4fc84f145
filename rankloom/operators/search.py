"""Batches of search requests: validation, the six methods, response rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import SearchOptions
from rankloom.functions.scores import confidence, fused
from rankloom.functions.text import strip
from rankloom.operators import bm25, dense, hybrid, ltr, tfidf
from rankloom.operators.features import features
from rankloom.operators.forest import Forest
from rankloom.operators.ranking import top_k
from rankloom.operators.rerank import Scorer, attach, score_pairs, text_pairs
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.runtime import BROADCAST_BYTES, QuerySet, materialize
from rankloom.sources.scores import ScoreStore

SINGLE_STAGE = ("tfidf", "bm25", "embedding")
# What a rejected request is told.
EMPTY_QUERY = "empty_query"
QUERY_TOO_LONG = "query_too_long"
INVALID_PARAMETER = "invalid_parameter"
UNSUPPORTED_METHOD = "unsupported_method"
NOT_READY = "not_ready"
MISSING_ID = "missing_request_id"
REPEATED_ID = "repeated_request_id"

# A query text that more than one in HOT_SHARE requests ask (there are fewer than HOT_SHARE of
# them) is delivered in HOT_PARTS parts.
HOT_SHARE = 256
HOT_PARTS = 64


@dataclass(frozen=True)
class SearchIndex:
    """Everything a batch of requests is answered from."""

    catalog: DataFrame  # doc_id, title, brand, color, text
    text_index: TextIndex
    tfidf_index: TfidfIndex
    vectors: DataFrame  # doc_id, vec
    encode: Callable[[DataFrame], DataFrame]  # adds `vec` to (query_id, text, ...)
    scorer: Scorer | None = None
    forest: Forest | None = None
    known_scores: ScoreStore | None = None
    options: SearchOptions = field(default_factory=SearchOptions)

    def write(self, path: str) -> None:
        """Store the tables; models and encoders are code or stored by themselves."""
        self.catalog.write.mode("overwrite").parquet(f"{path}/catalog")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")
        self.text_index.write(f"{path}/text")
        self.tfidf_index.write(f"{path}/tfidf")

    @staticmethod
    def read(spark: SparkSession, path: str, encode, **models) -> SearchIndex:
        """A stored index with the encoder and models of this process."""
        return SearchIndex(
            catalog=spark.read.parquet(f"{path}/catalog"),
            text_index=TextIndex.read(spark, f"{path}/text"),
            tfidf_index=TfidfIndex.read(spark, f"{path}/tfidf"),
            vectors=spark.read.parquet(f"{path}/vectors"),
            encode=encode,
            **models,
        )

    @property
    def ready(self) -> tuple[str, ...]:
        """Methods that this index has the models for."""
        missing = set()
        if self.scorer is None:
            missing |= {"rerank", "ltr"}
        if self.forest is None:
            missing.add("ltr")
        return tuple(m for m in self.options.methods if m not in missing)


def validate(
    requests: DataFrame,
    options: SearchOptions = SearchOptions(),
    ready: tuple[str, ...] | None = None,
) -> DataFrame:
    """Resolve defaults and add `error` (NULL for an accepted request).

    alpha and beta only matter to hybrid, the depth only to rerank and ltr. A request whose id
    is NULL or is used twice in the batch cannot be answered by id and is rejected; one whose
    method is not in `ready` (the index lacks its model) is rejected alone.
    """
    ready = options.methods if ready is None else ready
    repeated = requests.groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    requests = requests.join(repeated, "request_id", "left")
    query = strip(F.coalesce("query", F.lit("")))
    method = F.lower(strip(F.coalesce("method", F.lit("hybrid"))))
    k = F.coalesce("top_k", F.lit(options.default_top_k))
    alpha = F.coalesce("alpha", F.lit(options.alpha))
    beta = F.coalesce("beta", F.lit(options.beta))
    depth = F.coalesce("candidate_depth", F.lit(options.candidate_depth))

    def outside(value: Column, low: float, high: float) -> Column:
        return ~value.between(low, high) | F.isnan(value.cast("double"))

    weights_wrong = (method == "hybrid") & (outside(alpha, 0.0, 1.0) | outside(beta, 0.0, 1.0))
    depth_wrong = method.isin("rerank", "ltr") & outside(depth, 1, options.candidate_pool_size)
    error = (
        F.when(F.col("request_id").isNull(), MISSING_ID)
        .when(F.col("_n").isNotNull(), REPEATED_ID)
        .when(~method.isin(*options.methods), UNSUPPORTED_METHOD)
        .when(~method.isin(*ready), NOT_READY)
        .when(F.length(query) < options.min_query_length, EMPTY_QUERY)
        .when(F.length(query) > options.max_query_length, QUERY_TOO_LONG)
        .when(outside(k, 1, options.max_top_k), INVALID_PARAMETER)
        .when(weights_wrong | depth_wrong, INVALID_PARAMETER)
    )
    return requests.select(
        "request_id",
        query.alias("query"),
        method.alias("method"),
        k.cast("int").alias("top_k"),
        alpha.cast("double").alias("alpha"),
        beta.cast("double").alias("beta"),
        depth.cast("int").alias("candidate_depth"),
        error.alias("error"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error").isNull()).drop("error")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("error").isNotNull())


def answer(requests: DataFrame, index: SearchIndex) -> DataFrame:
    """request_id, method, doc_id, score, rank for accepted requests.

    Each distinct query text is searched once per stage it needs, however many requests share
    it; a request then reads its own top_k, weights and depth off the shared lists.
    """
    options = index.options
    asked = materialize(
        requests.filter(F.col("method").isin(*index.ready)).withColumn(
            "query_id", F.sha2("query", 256)
        ),
        "requests",
    )
    # One row per method: how deep its lists must be.
    depth = {
        row["method"]: row["k"]
        for row in asked.groupBy("method").agg(F.max("top_k").alias("k")).collect()
    }
    present = set(depth)
    parts = []

    def texts_for(methods) -> DataFrame:
        wanted = asked.filter(F.col("method").isin(*methods))
        return wanted.select("query_id", F.col("query").alias("text")).distinct()

    def deliver(ranking: DataFrame, methods) -> DataFrame:
        """Join shared per-query lists to the requests that read them."""
        of = asked.filter(F.col("method").isin(*methods)).select(
            "request_id", "query_id", "method", "top_k"
        )
        return _delivered(of, ranking.select("query_id", "doc_id", "score", "rank"), ["query_id"])

    if "tfidf" in present:
        found = tfidf.retrieve(QuerySet(texts_for(["tfidf"])), index.tfidf_index, depth["tfidf"])
        parts.append(deliver(found, ["tfidf"]))
    if "bm25" in present:
        found = bm25.retrieve(QuerySet(texts_for(["bm25"])), index.text_index, depth["bm25"])
        parts.append(deliver(found, ["bm25"]))
    if "embedding" in present:
        encoded = materialize(index.encode(texts_for(["embedding"])), "query-vectors")
        found = dense.retrieve(QuerySet(encoded), index.vectors, depth["embedding"])
        parts.append(deliver(found, ["embedding"]))
    staged = sorted(present & {"hybrid", "rerank", "ltr"})
    if staged:
        encoded = materialize(index.encode(texts_for(staged)), "query-vectors")
        queries = QuerySet(encoded)
        pool = options.candidate_pool_size
        cands = materialize(
            hybrid.candidates(queries, index.text_index, index.vectors, pool), "pool"
        )
        if "hybrid" in staged:
            parts.append(_hybrid(asked, cands, depth["hybrid"]))
        parts += _second_stage(asked, cands, queries, index, [m for m in staged if m != "hybrid"])
    if not parts:
        doc_type = index.catalog.schema["doc_id"].dataType.simpleString()
        return asked.limit(0).select(
            "request_id",
            "method",
            F.lit(None).cast(doc_type).alias("doc_id"),
            F.lit(0.0).alias("score"),
            F.lit(0).alias("rank"),
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    # Titles, responses and sinks all read the answers; the searches run once.
    return materialize(whole, "answers")


def _delivered(of: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    """request_id, method, doc_id, score, rank: each request's rows of the list with its keys.

    A list that more than one in HOT_SHARE requests read is copied HOT_PARTS times, and its
    requests are dealt out over the copies, so a popular query is not one task's work."""
    counts = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    popular = F.broadcast(
        counts.filter(F.col("n") * HOT_SHARE > of.count()).select(
            *keys, F.lit(HOT_PARTS).alias("parts")
        )
    )
    parts = F.coalesce("parts", F.lit(1))
    of = of.join(popular, keys, "left").withColumn(
        "part", F.pmod(F.xxhash64("request_id"), parts).cast("int")
    )
    lists = lists.join(popular, keys, "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    joined = of.drop("parts").join(lists.drop("parts"), [*keys, "part"])
    return joined.filter(F.col("rank") <= F.col("top_k")).select(
        "request_id", "method", "doc_id", "score", "rank"
    )


def _hybrid(asked: DataFrame, cands: DataFrame, max_top_k: int) -> DataFrame:
    """Fuse with each request's own weights. Equal (query, weights) are ranked once."""
    of = asked.filter(F.col("method") == "hybrid")
    keys = ["query_id", "alpha", "beta"]
    score = fused(F.col("bm25_norm"), F.col("emb_norm"), F.col("alpha"), F.col("beta"))
    settings = of.groupBy(*keys).agg(F.max("top_k").alias("deepest"))
    lists = top_k(
        cands.join(settings, "query_id").withColumn("score", score),
        max_top_k,
        by=tuple(keys),
    )
    lists = lists.filter(F.col("rank") <= F.col("deepest")).select(*keys, "doc_id", "score", "rank")
    return _delivered(of.select("request_id", "method", "top_k", *keys), lists, keys)


def _second_stage(
    asked: DataFrame, cands: DataFrame, queries: QuerySet, index: SearchIndex, methods: list[str]
) -> list[DataFrame]:
    """Re-rank (and, for ltr, score by the forest) the default-weight hybrid list.

    A pair is scored once, to the largest depth that a request of either method asks for; a
    request with depth d uses the first d pairs.
    """
    if not methods:
        return []
    options = index.options
    of = asked.filter(F.col("method").isin(*methods))
    depths = of.select("method", "query_id", "candidate_depth").distinct()
    deepest = options.candidate_pool_size
    first = hybrid.fuse(cands, options.alpha, options.beta, deepest)
    limits = depths.groupBy("query_id").agg(F.max("candidate_depth").alias("deepest"))
    first = first.join(limits, "query_id").filter(F.col("rank") <= F.col("deepest"))
    small = queries.rows_fit(deepest, 128)
    pairs = materialize(
        first.select("query_id", "doc_id", "rank", "score", "bm25_norm", "emb_norm"), "pairs"
    )
    # Written down, so that the model sees each pair once however often the scores are read.
    scored = materialize(
        _pair_scores(pairs, queries, index, small).withColumnRenamed("rank", "hybrid_rank"),
        "pair-scores",
    )
    by, found = ["query_id", "candidate_depth"], []
    for method in methods:
        mine = depths.filter(F.col("method") == method).drop("method")
        lists = mine.join(scored, "query_id").filter(F.col("hybrid_rank") <= F.col("candidate_depth"))
        if method == "rerank":
            lists = lists.withColumn("score", F.col("ce_score"))
        else:
            lists = _forest_scores(lists, queries, index, small)
        lists = top_k(lists, options.max_top_k, by=tuple(by), tie="hybrid_rank")
        readers = of.filter(F.col("method") == method).select("request_id", "method", "top_k", *by)
        found.append(_delivered(readers, lists.select(*by, "doc_id", "score", "rank"), by))
    return found


def _pair_scores(
    pairs: DataFrame, queries: QuerySet, index: SearchIndex, small: bool
) -> DataFrame:
    """ce_score of each pair: from the stored scores if known, else from the model."""
    named = text_pairs(
        pairs, queries.texts, index.catalog, index.options.pair_max_chars, small, queries.texts_fit
    )
    if index.known_scores is None:
        return score_pairs(named, index.scorer).drop("query_text", "doc_text")
    # Read once: the stored scores and the pairs that lack one come from the same lookup.
    looked = materialize(index.known_scores.lookup(named), "known-scores")
    known = looked.filter(F.col("ce_score").isNotNull())
    new = looked.filter(F.col("ce_score").isNull()).drop("ce_score")
    fresh = score_pairs(new, index.scorer)
    return known.unionByName(fresh).drop("query_text", "doc_text")


def _forest_scores(
    lists: DataFrame, queries: QuerySet, index: SearchIndex, small: bool
) -> DataFrame:
    """Features within each (query, depth) list, then the forest."""
    # A list is identified by query and depth: the pair-score rank depends on the depth.
    keyed = lists.withColumn("list_id", F.concat_ws("|", "query_id", "candidate_depth"))
    as_query = queries.texts.join(
        keyed.select("query_id", "list_id").distinct(), "query_id"
    ).select(F.col("list_id").alias("query_id"), "text")
    rows = features(
        keyed.select(
            F.col("list_id").alias("query_id"),
            "doc_id",
            "ce_score",
            F.col("score").alias("hybrid_score"),
            "hybrid_rank",
            "bm25_norm",
            "emb_norm",
        ),
        as_query,
        index.catalog,
        False,
    )
    scored = ltr.score_rows(rows, index.forest, "score").select(
        F.col("query_id").alias("list_id"), "doc_id", "score"
    )
    return keyed.drop("score").join(scored, ["list_id", "doc_id"])


def items(ranked: DataFrame, catalog: DataFrame, options: SearchOptions = SearchOptions()) -> DataFrame:
    """Flat response rows: title, score at 6 decimals, confidence. `ranked` is what `answer`
    wrote, so counting it is cheap and says whether its ids may be broadcast."""
    small = 64 * ranked.count() <= BROADCAST_BYTES
    titled = attach(ranked, catalog.select("doc_id", "title"), ("title",), small)
    return titled.select(
        "request_id",
        "method",
        "rank",
        F.col("doc_id").alias("product_id"),
        "title",
        F.round("score", 6).alias("score"),
        confidence(F.col("score"), F.col("method"), options).alias("confidence"),
    )


def responses(requests: DataFrame, response_items: DataFrame) -> DataFrame:
    """One row per request with its items as an array, in rank order (at most top_k each)."""
    item = F.struct("rank", "product_id", "title", "score", "confidence")
    lists = response_items.groupBy("request_id").agg(
        F.array_sort(F.collect_list(item)).alias("results")
    )
    joined = requests.join(lists, "request_id", "left")
    return joined.select(
        "request_id",
        "query",
        F.col("method").alias("ranking_method"),
        "top_k",
        F.coalesce(F.size("results"), F.lit(0)).alias("count"),
        "results",
    )
