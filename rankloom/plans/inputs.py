"""The library's input tables, derived from the given parquet tables.

Shop: judgments come from `lineitem`, the catalog from `part`, vectors from `embeddings`.
Texts: `documents` is the corpus, `benchmark` the query list.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import token_cosine
from rankloom.functions.vectors import letter_vector
from rankloom.operators import bm25, dense, hybrid, prepare, sampling, tfidf
from rankloom.operators.features import FEATURES, features, training_rows
from rankloom.operators.forest import Forest, Tree
from rankloom.operators.metrics import grade_counts, per_query
from rankloom.operators.ranking import as_ranking
from rankloom.operators.rerank import reorder, score_pairs, text_pairs
from rankloom.operators.search import SearchIndex
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.runtime import (
    BROADCAST_BYTES,
    QuerySet,
    by_document,
    fresh_dir,
    hinted,
    materialize,
    shared_dir,
    spread,
)
from rankloom.sources.models import TrainingRuns

DEPTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query() -> Column:
    return F.lower(F.concat("p_type", F.lit(" "), "p_brand"))


def _label() -> Column:
    place = (F.col("l_linenumber") % 4 + 1).cast("int")
    return F.element_at(F.array(*[F.lit(x) for x in "ICSE"]), place)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"
    )
    line = spread(line, "l_orderkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    return line.join(part, line.l_suppkey == part.p_partkey).select(
        F.concat_ws(
            "|",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.col("l_quantity").cast("int"),
        ).alias("example_id"),
        _query().alias("query"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("l_returnflag").alias("product_locale"),
        _label().alias("esci_label"),
        F.col("l_suppkey").alias("source_key"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_title"),
        F.col("p_type").alias("product_description"),
        F.col("p_brand").alias("product_brand"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("product_color"),
    )


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id (the query text), doc_id, rel."""
    graded = prepare.grade(judgments(spark, sf_dir))
    return prepare.qrels(graded).withColumnRenamed("query", "query_id")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_key, query of every part whose key stands as a supplier in a judgment."""
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_key")).distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_key"), _query().alias("query"))
    return part.join(asked, "source_key", "left_semi").distinct()


def graded_by(
    spark: SparkSession, sf_dir: str, keys: DataFrame, small: bool, goods: DataFrame | None = None
) -> DataFrame:
    """query, product_id (both as in `keys(source_key, query)` and `lineitem`), relevance_score of
    all judgments; their other columns are not made. `small`: `keys` was checked to fit a broadcast.
    `goods(doc_id)`, checked to fit one too: only judgments of these products, which are told by
    their keys before any text of a query or product is made."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", _label().alias("esci_label"))
    if goods is not None:
        key = F.col("doc_id").try_cast(line.schema["l_partkey"].dataType).alias("l_partkey")
        line = line.join(F.broadcast(goods.select(key).distinct()), "l_partkey", "left_semi")
    judged = line.join(hinted(keys, small), line.l_suppkey == keys.source_key)
    return prepare.grade(judged.select("query", F.col("l_partkey").alias("product_id"), "esci_label"))


def corpus(goods: DataFrame) -> DataFrame:
    """doc_id, title, brand, color, text of a whole catalog."""
    return prepare.add_product_text(goods).select(
        F.col("product_id").alias("doc_id"),
        F.col("product_title").alias("title"),
        F.col("product_brand").alias("brand"),
        F.col("product_color").alias("color"),
        F.col("product_text").alias("text"),
    )


def shop_queries(named: DataFrame) -> DataFrame:
    """query_id, number, text, vec of every query of `named(source_key, query)`."""
    asked = named.select(F.col("query").alias("query_id")).distinct()
    asked = asked.withColumns({"number": F.monotonically_increasing_id(), "text": F.col("query_id")})
    return dense.encode_texts(asked, letter_vector)


def text_queries(spark: SparkSession, sf_dir: str) -> QuerySet:
    items = table(spark, sf_dir, "benchmark")
    return QuerySet(items.select(F.col("item_id").alias("query_id"), "text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def text_hybrid(spark: SparkSession, sf_dir: str) -> tuple[QuerySet, DataFrame, DataFrame]:
    """Queries with vectors, all documents, and the documents' vectors."""
    docs = documents(spark, sf_dir)
    queries = dense.encode_texts(text_queries(spark, sf_dir).df, letter_vector)
    encoded = dense.encode_texts(docs, letter_vector).select("doc_id", "vec")
    return QuerySet(queries), docs, materialize(encoded, "vectors")


def _named(graded: DataFrame) -> DataFrame:
    """query_id, doc_id, rel: the highest grade of every pair."""
    graded = graded.withColumn("product_id", F.col("product_id").cast("string"))
    return prepare.qrels(graded).withColumnRenamed("query", "query_id")


@dataclass
class Shop:
    """The shop's queries, corpus and candidate pool, each written once and read often.

    A catalog packs into few bytes: millions of goods may lie in one split of a file, which one
    task would tokenise, encode and score. So the corpus is dealt out by document first.

    The judgments are the largest table. A few ranked pairs are looked up where they lie; counts
    of grades, which need every pair once, move them as three numbers a row."""

    spark: SparkSession
    sf_dir: str

    def __post_init__(self) -> None:
        self._sources = materialize(sources(self.spark, self.sf_dir), "sources")
        self._numbered = materialize(shop_queries(self._sources), "queries")
        self.queries = QuerySet(self._numbered.drop("number"))
        goods = by_document(catalog(self.spark, self.sf_dir), "product_id")
        self.corpus = materialize(corpus(goods), "corpus")
        encoded = dense.encode_texts(self.corpus, letter_vector).select("doc_id", "vec")
        self.vectors = materialize(encoded, "vectors")

    @cached_property
    def _sources_fit(self) -> bool:
        chars = F.sum(F.octet_length("query")).alias("chars")
        size = self._sources.agg(F.count(F.lit(1)).alias("n"), chars).first()
        return 64 * size["n"] + (size["chars"] or 0) <= BROADCAST_BYTES

    @cached_property
    def qrels(self) -> DataFrame:
        """query_id (the query text), doc_id, rel. Written only if the pairs to be looked up might
        be too many for a broadcast; else the pairs thin out the judgments before these are grouped."""
        graded = graded_by(self.spark, self.sf_dir, self._sources, self._sources_fit)
        return _named(graded) if self.queries.rows_fit(2 * DEPTH, 128) else materialize(_named(graded), "qrels")

    def qrels_of(self, rows: DataFrame, per_query: int) -> DataFrame:
        """The `qrels` of at least the pairs in `rows`, which have at most so many rows a query and
        were written down. Where their documents fit a broadcast, all other judgments are left out
        where they lie."""
        if not self.queries.rows_fit(per_query, 128):
            return self.qrels
        return _named(graded_by(self.spark, self.sf_dir, self._sources, self._sources_fit, rows))

    @cached_property
    def grades(self) -> DataFrame:
        """query_id, rel, n: how many products have this as their highest grade for the query.

        Most pairs are judged once, so combining them before the shuffle only fills memory; they
        are grouped where the shuffle by pair has brought them."""
        of = F.col("query").eqNullSafe(F.col("query_id"))
        fits = self.queries.rows_fit(1)
        names = hinted(self._numbered.select("query_id", "number"), fits)
        keys = self._sources.join(names, of).select("source_key", F.col("number").alias("query"))
        graded = graded_by(self.spark, self.sf_dir, keys, self._sources_fit)
        pairs = prepare.qrels(graded.repartition("query", "product_id"))
        counted = grade_counts(pairs.withColumnRenamed("query", "number"), "number")
        return materialize(counted.join(names, "number").select("query_id", "rel", "n"), "grades")

    @cached_property
    def _pool(self) -> DataFrame:
        index = TextIndex.build(self.corpus)
        return materialize(hybrid.candidates(self.queries, index, self.vectors), "pool")

    def pool(self) -> DataFrame:
        return self._pool

    @cached_property
    def _scored(self) -> DataFrame:
        return materialize(self.scored_candidates(self.pool()), "scored")

    def tfidf(self) -> DataFrame:
        return as_ranking(tfidf.retrieve(self.queries, TfidfIndex.fit(self.corpus)), "tfidf")

    def first_stage(self, pool: DataFrame) -> DataFrame:
        """Rankings of bm25, embedding and hybrid (default weights)."""
        return (
            as_ranking(hybrid.pure(pool, "bm25"), "bm25")
            .unionByName(as_ranking(hybrid.pure(pool, "emb"), "embedding"))
            .unionByName(as_ranking(hybrid.fuse(pool, 0.4, 0.6), "hybrid"))
        )

    def scored_candidates(self, pool: DataFrame, max_chars: int | None = None) -> DataFrame:
        """The hybrid top 50 with the stand-in pair model's `ce_score`."""
        top = hybrid.fuse(pool, 0.4, 0.6, DEPTH)
        small = self.queries.rows_fit(DEPTH, 128)
        pairs = text_pairs(
            top, self.queries.texts, self.corpus, max_chars, small, self.queries.texts_fit
        )
        return score_pairs(pairs, token_cosine).drop("query_text", "doc_text")

    def reranked(self, scored: DataFrame) -> DataFrame:
        return as_ranking(reorder(scored), "rerank")

    def all_methods(self) -> DataFrame:
        """Rankings of the five methods that need no trained model."""
        first, second = self.first_stage(self.pool()), self.reranked(self._scored)
        whole = first.unionByName(self.tfidf()).unionByName(second)
        return materialize(whole, "rankings")

    def features(self) -> DataFrame:
        scored = self._scored.withColumnsRenamed({"rank": "hybrid_rank", "score": "hybrid_score"})
        small = self.queries.rows_fit(DEPTH, 128)
        return features(scored, self.queries.texts, self.corpus, small, self.queries.texts_fit)

    def lists_fit(self, methods: int, k: int = 10) -> bool:
        """Do the ranked rows of so many methods fit a broadcast?"""
        return self.queries.rows_fit(methods * k, 128)

    def metrics(
        self, rankings: DataFrame, methods: list[str], queries: DataFrame | None = None
    ) -> DataFrame:
        """The metrics of every query (or of those given) and method."""
        asked = self.queries.df if queries is None else queries
        small = self.lists_fit(len(methods))
        judged = self.qrels_of(rankings, 10 * len(methods))
        return per_query(rankings, asked, judged, methods, small=small, grades=self.grades)

    def splits(self) -> DataFrame:
        return sampling.split_queries(self.queries.df.select("query_id"), "query_id")

    def training_rows(self) -> DataFrame:
        small = self.queries.rows_fit(DEPTH, 128)
        judged = self.qrels_of(self._scored, DEPTH)
        return training_rows(self.features(), judged, self.splits(), small)


def requests(conversations: DataFrame) -> DataFrame:
    """Every turn of every conversation as a search request; some are not valid."""
    turn = F.col("turn")
    named = F.element_at(
        F.create_map(
            *[
                x
                for n, m in enumerate(("tfidf", "bm25", "embedding", "hybrid", "rerank", " BM25 ", "magic"))
                for x in (F.lit(n).cast("long"), F.lit(m))
            ]
        ),
        turn,
    )
    method = F.when((turn == 4) & (F.col("conv_id") % 2 == 1), "ltr").otherwise(named)
    return conversations.select(
        (F.col("conv_id") * 100 + turn).alias("request_id"),
        F.col("text").alias("query"),
        method.alias("method"),
        F.when(turn == 3, 20).when(turn == 5, 0).cast("int").alias("top_k"),
        (turn * 0.2).alias("alpha"),
        F.lit(None).cast("double").alias("beta"),
        (turn * 5).cast("int").alias("candidate_depth"),
    )


def stand_in_forest() -> Forest:
    """Two small trees in place of a trained ranker, for rows that SQL can follow."""

    def place(name: str) -> int:
        return FEATURES.index(name)

    by_pair = Tree(
        [place("ce_score"), -1, place("title_overlap_count"), -1, -1],
        [0.25, 0.0, 1.0, 0.0, 0.0],
        [1, -1, 3, -1, -1],
        [2, -1, 4, -1, -1],
        [0.0, -0.5, 0.0, 0.25, 0.75],
        [2.0, 0.0, 1.0, 0.0, 0.0],
    )
    by_rank = Tree(
        [place("hybrid_rank"), -1, -1],
        [10.0, 0.0, 0.0],
        [1, -1, -1],
        [2, -1, -1],
        [0.0, 0.125, -0.125],
        [1.0, 0.0, 0.0],
    )
    return Forest([by_pair, by_rank])


def _stored_text_index(goods: DataFrame) -> TextIndex:
    path = fresh_dir(goods.sparkSession, "text-index")
    TextIndex.build(goods).write(path, forward=True)
    return TextIndex.read(goods.sparkSession, path)


def _stored_tfidf_index(goods: DataFrame) -> TfidfIndex:
    path = fresh_dir(goods.sparkSession, "tfidf-index")
    TfidfIndex.fit(goods).write(path)
    return TfidfIndex.read(goods.sparkSession, path)


def search_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as a catalog."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select(
        "doc_id",
        F.concat_ws(" ", "lang", "source").alias("title"),
        F.lit("").alias("brand"),
        F.lit("").alias("color"),
        "text",
    )


def text_only_index(spark: SparkSession, goods: DataFrame, text_path: str) -> SearchIndex:
    """A catalog with a stored text index, for keyword search alone."""
    return SearchIndex(
        catalog=goods,
        text_index=TextIndex.read(spark, text_path),
        tfidf_index=None,
        vectors=None,
        encode=None,
    )


def text_search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """All documents, letter-count vectors and token-overlap pair scores. The indexes are
    written once; batches and micro-batches read them and tokenise no document again."""
    goods = search_catalog(spark, sf_dir)
    return SearchIndex(
        catalog=goods,
        text_index=_stored_text_index(goods),
        tfidf_index=_stored_tfidf_index(goods),
        # Several methods read the vectors: encode once, as a served index would be.
        vectors=materialize(
            goods.select("doc_id", letter_vector(F.col("text")).alias("vec")), "vectors"
        ),
        encode=lambda df: df.withColumn("vec", letter_vector(F.col("text"))),
        scorer=token_cosine,
        forest=stand_in_forest(),
    )


def training_runs(spark: SparkSession) -> TrainingRuns:
    """The runs of this application; those of an earlier one may be of older code."""
    return TrainingRuns(spark, f"{shared_dir(spark)}/rankloom-training/{spark.sparkContext.applicationId}")


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` read as a log: method, phase, latency_ms, status_code, cached."""
    return log_columns(table(spark, sf_dir, "events"))


def log_columns(events: DataFrame) -> DataFrame:
    warm = F.col("user_id") % 2 == 1
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("time"),
        F.col("event_type").alias("method"),
        F.concat(F.lit("/"), "event_type").alias("path"),
        F.when(warm, "warm").otherwise("cold").alias("phase"),
        warm.alias("cached"),
        F.col("value").alias("latency_ms"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"),
    )


def bm25_over_documents(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    index = TextIndex.build(documents(spark, sf_dir))
    return bm25.retrieve(text_queries(spark, sf_dir), index, k)
