"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.scores import duration_label, percent_label
from rankloom.functions.text import preview, token_cosine
from rankloom.functions.vectors import letter_vector
from rankloom.operators import bm25, compare, dense, hybrid, ltr, metrics, monitor, prepare
from rankloom.operators import rerank as reranking
from rankloom.operators import sampling, search, tfidf
from rankloom.operators.cells import CellIndex, write_cells
from rankloom.operators.forest import importance, score_rows
from rankloom.operators.indexlog import IndexLog
from rankloom.operators.ranking import as_ranking, result_rows
from rankloom.operators.textindex import TextIndex
from rankloom.operators.tfidf import TfidfIndex
from rankloom.plans import inputs
from rankloom.plans.inputs import Shop
from rankloom.runtime import QuerySet, fresh_dir, materialize
from rankloom.sources import reports, tables
from rankloom.sources.models import load_forest, save_forest
from rankloom.sources.scores import ScoreStore
from rankloom.sources.vectors import ensure_vectors, id_differences
from rankloom.sources.versions import Versions
from rankloom.streaming.monitor import windowed
from rankloom.streaming.requests import serve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

METHODS = ["tfidf", "bm25", "embedding", "hybrid", "rerank"]
JUDGMENT_COLUMNS = ["example_id", "query", "product_id", "product_locale", "esci_label"]
SAMPLE_COLUMNS = ["example_id", "query", "product_id", "relevance_score"]


def registered(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def r6(*columns: str) -> list[Column]:
    """Scores are shown with 6 decimals."""
    return [F.round(c, 6).alias(c) for c in columns]


def ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "doc_id", *r6("score"), "rank")


# --- preparation -------------------------------------------------------------------------


@registered
def profile_nulls(spark, sf_dir):
    return prepare.profile(inputs.judgments(spark, sf_dir).select(*JUDGMENT_COLUMNS))


@registered
def first_rows(spark, sf_dir):
    return prepare.first_rows(
        inputs.judgments(spark, sf_dir).select(*JUDGMENT_COLUMNS), "example_id"
    )


@registered
def label_counts(spark, sf_dir):
    return prepare.value_counts(inputs.judgments(spark, sf_dir), "esci_label")


@registered
def distinct_counts(spark, sf_dir):
    return prepare.distinct_counts(inputs.judgments(spark, sf_dir), ["query", "product_id"])


def _said(spark, sf_dir):
    return inputs.table(spark, sf_dir, "conversations").select(F.col("text").alias("query"))


@registered
def query_length_stats(spark, sf_dir):
    stats = prepare.query_length_stats(prepare.add_query_length(_said(spark, sf_dir)))
    shares = r6("mean_len", "pct_1_2", "pct_3_5", "pct_6_plus")
    return stats.select("min_len", "max_len", *shares)


@registered
def query_length_hist(spark, sf_dir):
    return prepare.query_length_histogram(_said(spark, sf_dir))


@registered
def graded_locale_rows(spark, sf_dir):
    rows = prepare.keep_locale(inputs.judgments(spark, sf_dir), "R")
    return prepare.drop_missing(prepare.grade(rows)).select(
        "example_id", "query", "product_id", "esci_label", "relevance_score"
    )


@registered
def locale_fallback(spark, sf_dir):
    rows = prepare.grade(prepare.keep_locale(inputs.judgments(spark, sf_dir), "us"))
    return prepare.value_counts(rows, "relevance_score")


@registered
def product_text(spark, sf_dir):
    texts = prepare.add_product_text(inputs.catalog(spark, sf_dir))
    return prepare.drop_empty_text(texts).select("product_id", "product_text")


@registered
def text_preview(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir)
    return docs.select("doc_id", preview(F.col("text"), 60).alias("preview"))


@registered
def judgments_join_catalog(spark, sf_dir):
    graded = prepare.grade(inputs.judgments(spark, sf_dir))
    joined = prepare.join_catalog(graded, inputs.catalog(spark, sf_dir))
    rows = prepare.drop_empty_text(prepare.add_product_text(joined))
    return rows.select(*SAMPLE_COLUMNS, "product_title", "product_text")


@registered
def judgments_join_catalog_locale(spark, sf_dir):
    locales = F.explode(F.array(F.lit("A"), F.lit("R"))).alias("product_locale")
    goods = inputs.catalog(spark, sf_dir).select("*", locales)
    joined = prepare.join_catalog(inputs.judgments(spark, sf_dir), goods)
    return joined.select("example_id", "product_id", "product_locale", "product_title")


@registered
def balanced_sample(spark, sf_dir):
    graded = prepare.grade(inputs.judgments(spark, sf_dir)).select(*SAMPLE_COLUMNS)
    return sampling.balanced_sample(graded, "relevance_score", "example_id").select(*SAMPLE_COLUMNS)


@registered
def balanced_sample_topup(spark, sf_dir):
    graded = prepare.grade(inputs.judgments(spark, sf_dir)).select(*SAMPLE_COLUMNS)
    return sampling.topped_up_sample(graded, "relevance_score", "example_id").select(*SAMPLE_COLUMNS)


@registered
def eval_queries(spark, sf_dir):
    return sampling.evaluation_queries(inputs.qrels(spark, sf_dir), "query_id")


@registered
def display_queries(spark, sf_dir):
    every = inputs.qrels(spark, sf_dir).select("query_id").distinct()
    return sampling.pick(every, "query_id", 10)


@registered
def query_split(spark, sf_dir):
    items = inputs.text_queries(spark, sf_dir).df.select("query_id")
    return sampling.split_queries(items, "query_id").select("query_id", "split")


@registered
def corpus_dedup(spark, sf_dir):
    joined = prepare.join_catalog(
        inputs.judgments(spark, sf_dir), inputs.catalog(spark, sf_dir)
    )
    rows = prepare.add_product_text(joined).withColumnRenamed("query", "first_query")
    return prepare.corpus(rows, columns=("first_query", "product_text"))


@registered
def qrels_max(spark, sf_dir):
    return inputs.qrels(spark, sf_dir).select("query_id", "doc_id", "rel")


# --- retrieval ---------------------------------------------------------------------------


@registered
def bm25_topk(spark, sf_dir):
    return ranked(inputs.bm25_over_documents(spark, sf_dir))


@registered
def incremental_bm25_topk(spark, sf_dir):
    """An index taken in by changes: outdated texts first, then all documents under the same
    ids, then a removal of documents that do not belong. Its answers are those of a fresh one."""
    docs = inputs.documents(spark, sf_dir)
    log = IndexLog(spark, fresh_dir(spark, "log"))
    log.upsert(docs.withColumn("text", F.reverse("text")))
    log.upsert(docs.unionByName(docs.withColumn("doc_id", -1 - F.col("doc_id"))))
    log.remove(docs.select((-1 - F.col("doc_id")).alias("doc_id")))
    return ranked(bm25.retrieve(inputs.text_queries(spark, sf_dir), log.read()))


# Slices of the batches below: so small that the given tables need several.
SLICE_BYTES = 4 * 1024 * 1024


def _turns(spark, sf_dir):
    """Every turn of every conversation as a query: more than a batch of few queries holds."""
    turns = inputs.table(spark, sf_dir, "conversations")
    asked = turns.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "text")
    return QuerySet(asked, limit=SLICE_BYTES)


@registered
def bm25_many_queries(spark, sf_dir):
    index = TextIndex.build(inputs.documents(spark, sf_dir))
    best = bm25.retrieve(_turns(spark, sf_dir), index)
    # Long turns have large sums, whose sixth decimal is near their last digits.
    return best.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@registered
def tfidf_many_queries(spark, sf_dir):
    index = TfidfIndex.fit(inputs.documents(spark, sf_dir))
    return ranked(tfidf.retrieve(_turns(spark, sf_dir), index))


@registered
def bm25_fill(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    index = TextIndex.build(shop.corpus)
    return ranked(bm25.retrieve(shop.queries, index, 150, fill=shop.corpus.select("doc_id")))


@registered
def tfidf_topk(spark, sf_dir):
    index = TfidfIndex.fit(inputs.documents(spark, sf_dir))
    return ranked(tfidf.retrieve(inputs.text_queries(spark, sf_dir), index))


@registered
def dense_topk(spark, sf_dir):
    stored = inputs.table(spark, sf_dir, "embeddings")
    queries = QuerySet(dense.vector_table(stored, "vec_id", "embedding", "query_id"))
    return ranked(dense.retrieve(queries, dense.vector_table(stored, "vec_id", "embedding")))


@registered
def dense_cells_topk(spark, sf_dir):
    """The rows of `dense_topk` from vectors stored by cell: only cells within reach are read."""
    stored = inputs.table(spark, sf_dir, "embeddings")
    path = fresh_dir(spark, "cells")
    write_cells(dense.vector_table(stored, "vec_id", "embedding"), path)
    queries = QuerySet(dense.vector_table(stored, "vec_id", "embedding", "query_id"))
    return ranked(CellIndex(spark, path).retrieve(queries))


@registered
def encoded_dense_topk(spark, sf_dir):
    docs = dense.encode_texts(inputs.documents(spark, sf_dir), letter_vector)
    asked = dense.encode_texts(inputs.text_queries(spark, sf_dir).df, letter_vector)
    return ranked(dense.retrieve(QuerySet(asked), docs))


@registered
def pair_similarity(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    replies = turns.select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right")
    )
    pairs = turns.withColumnRenamed("text", "left").join(replies, ["conv_id", "turn"])
    return dense.similarity_of_pairs(pairs, letter_vector).select(
        "conv_id", "turn", *r6("similarity")
    )


def _text_pool(spark, sf_dir):
    queries, docs, vecs = inputs.text_hybrid(spark, sf_dir)
    return hybrid.candidates(queries, TextIndex.build(docs), vecs)


@registered
def hybrid_candidates(spark, sf_dir):
    return _text_pool(spark, sf_dir).select(
        "query_id", "doc_id", "bm25_rank", "emb_rank", *r6("bm25", "emb", "bm25_norm", "emb_norm")
    )


@registered
def hybrid_topk(spark, sf_dir):
    return ranked(hybrid.fuse(_text_pool(spark, sf_dir), 0.5, 0.5))


def _sweep_scores(shop):
    names = [str(i) for i in range(len(hybrid.WEIGHT_GRID))]
    rankings = materialize(hybrid.sweep(shop.pool()), "sweep")
    return shop.metrics(rankings, names)


def _sweep_means(spark, sf_dir):
    return metrics.by_method(_sweep_scores(Shop(spark, sf_dir)))


@registered
def weight_sweep(spark, sf_dir):
    means = _sweep_means(spark, sf_dir)
    place = F.col("method").cast("int")
    alphas = F.array(*[F.lit(a) for a, _ in hybrid.WEIGHT_GRID])
    betas = F.array(*[F.lit(b) for _, b in hybrid.WEIGHT_GRID])
    return means.select(
        alphas[place].alias("alpha"), betas[place].alias("beta"), *r6("precision", "recall", "ndcg")
    )


@registered
def train_weights(spark, sf_dir):
    """The best weights by the queries that train and validate, test queries left out."""
    shop = Shop(spark, sf_dir)
    scores = _sweep_scores(shop)
    seen = shop.splits().filter(F.col("split") != "test").select("query_id")
    means = metrics.by_method(scores.join(seen, "query_id", "left_semi"))
    return hybrid.best_weights(means).select("alpha", "beta", *r6("ndcg"))


@registered
def best_weights(spark, sf_dir):
    best = hybrid.best_weights(_sweep_means(spark, sf_dir))
    return best.select("alpha", "beta", *r6("ndcg"))


# --- second stage ------------------------------------------------------------------------


@registered
def pair_rerank(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    top = materialize(hybrid.fuse(shop.pool(), 0.4, 0.6, inputs.DEPTH), "top")
    queries = shop.queries
    best = reranking.rerank(
        top,
        queries.texts,
        shop.corpus,
        token_cosine,
        small=queries.rows_fit(inputs.DEPTH),
        texts_fit=queries.texts_fit,
    )
    return best.select("query_id", "doc_id", *r6("score"), "rank", "hybrid_rank")


@registered
def pair_text_cut(spark, sf_dir):
    """Pair scores over the first 20 characters of each product text."""
    shop = Shop(spark, sf_dir)
    scored = shop.scored_candidates(shop.pool(), 20)
    return scored.select("query_id", "doc_id", *r6("ce_score"))


@registered
def score_store_resume(spark, sf_dir):
    """Half of the pairs are scored in one run, the rest in a second run in three chunks."""
    shop = Shop(spark, sf_dir)
    queries = shop.queries
    top = hybrid.fuse(shop.pool(), 0.4, 0.6, inputs.DEPTH).select("query_id", "doc_id")
    small = queries.rows_fit(inputs.DEPTH, 128)
    pairs = materialize(
        reranking.text_pairs(top, queries.texts, shop.corpus, None, small, queries.texts_fit), "pairs"
    )
    store = ScoreStore(spark, fresh_dir(spark, "scores"), "token-cosine")
    store.score_missing(pairs.filter(F.pmod(F.xxhash64("query_id", "doc_id"), F.lit(2)) == 0), token_cosine)
    store.score_missing(pairs, token_cosine, chunks=3)
    return store.lookup(pairs).select("query_id", "doc_id", *r6("ce_score"))


@registered
def scoring_runs(spark, sf_dir):
    """The numbers of three runs into one store: the first half of every list, the whole lists
    in two chunks, and the same once more after the commits were merged."""
    shop = Shop(spark, sf_dir)
    queries = shop.queries
    top = hybrid.fuse(shop.pool(), 0.4, 0.6, inputs.DEPTH).select("query_id", "doc_id", "rank")
    small = queries.rows_fit(inputs.DEPTH, 128)
    pairs = materialize(
        reranking.text_pairs(top, queries.texts, shop.corpus, None, small, queries.texts_fit), "pairs"
    )
    store = ScoreStore(spark, fresh_dir(spark, "scores"), "token-cosine")
    runs = [
        store.score_missing(pairs.filter(F.col("rank") <= inputs.DEPTH // 2), token_cosine),
        store.score_missing(pairs, token_cosine, chunks=2),
    ]
    store.merge()
    runs.append(store.score_missing(pairs, token_cosine))
    rows = [(i + 1, r.new_pairs, r.reused_pairs, r.pairs_per_second is not None) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, "run int, new_pairs long, reused_pairs long, timed boolean")


@registered
def missing_pairs(spark, sf_dir):
    pool = materialize(_text_pool(spark, sf_dir), "pool")
    scored = hybrid.fuse(pool, 0.4, 0.6, inputs.DEPTH)
    wanted = hybrid.fuse(pool, 0.6, 0.4, inputs.DEPTH).select("query_id", "doc_id")
    return wanted.join(scored, ["query_id", "doc_id"], "left_anti")


@registered
def cache_id_check(spark, sf_dir):
    stored = inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return id_differences(inputs.documents(spark, sf_dir), stored)


@registered
def ltr_features(spark, sf_dir):
    rows = Shop(spark, sf_dir).features()
    return rows.select("query_id", "doc_id", *r6(*ltr.FEATURES))


@registered
def ltr_training_rows(spark, sf_dir):
    rows = Shop(spark, sf_dir).training_rows()
    return rows.select("query_id", "doc_id", *r6(*ltr.FEATURES), "label", "split")


def _trained(spark, rows):
    """The ranker of these rows: one stored run serves every query of the application."""
    return inputs.training_runs(spark).get(rows, ltr.LtrParams(), ltr.train)


@registered
def ltr_topk(spark, sf_dir):
    rows = materialize(Shop(spark, sf_dir).training_rows(), "training")
    forest = _trained(spark, rows)
    return ranked(ltr.rank(rows.filter(F.col("split") == "test"), forest))


@registered
def ltr_importance(spark, sf_dir):
    rows = materialize(Shop(spark, sf_dir).training_rows(), "training")
    return importance(_trained(spark, rows).table(spark)).select("feature", *r6("gain"))


@registered
def heldout_six_methods(spark, sf_dir):
    """All six methods on the held-out queries, the sixth by the trained ranker."""
    shop, rankings, _ = _evaluated(spark, sf_dir)
    rows = materialize(shop.training_rows(), "training")
    held = shop.splits().filter(F.col("split") == "test").select("query_id")
    best = ltr.rank(rows.filter(F.col("split") == "test"), _trained(spark, rows))
    six = materialize(rankings.unionByName(as_ranking(best, "ltr")), "rankings")
    asked = shop.queries.df.join(held, "query_id", "left_semi")
    scores = shop.metrics(six, [*METHODS, "ltr"], asked)
    return metrics.by_method(scores).select("method", *r6(*metrics.METRICS))


# Cut points between the values that features usually take, so that noise in the last digit of
# a float cannot move a row to another bin.
GRID_START, GRID_STEP, GRID_SIZE = -0.9863, 1 / 16, 832


@registered
def ltr_first_tree(spark, sf_dir):
    """The first boosting round with three leaves over all training rows: bins, histograms,
    best splits under the monotone directions, leaf values."""
    rows = Shop(spark, sf_dir).training_rows().filter(F.col("split") == "train")
    edges = [GRID_START + GRID_STEP * np.arange(GRID_SIZE)] * len(ltr.FEATURES)
    params = ltr.LtrParams(num_leaves=3, subsample=1.0, colsample=1.0)
    tree = ltr.first_tree(rows, edges, params).table(spark)
    return tree.select("node", "feature", *r6("threshold"), "left", "right", *r6("value", "gain"))


# --- evaluation --------------------------------------------------------------------------


def _evaluated(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    rankings = shop.all_methods()
    return shop, rankings, shop.metrics(rankings, METHODS)


@registered
def unjudged_zero(spark, sf_dir):
    shop = Shop(spark, sf_dir)
    small, rankings = shop.lists_fit(len(METHODS)), shop.all_methods()
    return result_rows(rankings, shop.queries.df, shop.qrels_of(rankings, 10 * len(METHODS)), small)


@registered
def metrics_per_query(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    return scores.select("method", "query_id", *r6(*metrics.METRICS))


@registered
def metrics_by_method(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    return metrics.by_method(scores).select("method", *r6(*metrics.METRICS))


@registered
def best_method(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    best = compare.best_method(metrics.by_method(scores), "ndcg", METHODS)
    return best.select("method", *r6("value"))


@registered
def heldout_comparison(spark, sf_dir):
    shop, _, scores = _evaluated(spark, sf_dir)
    held = shop.splits().filter(F.col("split") == "test").select("query_id")
    kept = scores.join(held, "query_id", "left_semi")
    return metrics.by_method(kept).select("method", *r6(*metrics.METRICS))


@registered
def relative_change(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    means = metrics.unpivoted(metrics.by_method(scores))
    return compare.relative_change(means, "rerank").select("metric", "method", *r6("change_pct"))


@registered
def a_fails_b_succeeds(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    return compare.fails_and_succeeds(scores, "embedding", "bm25").select("query_id", *r6("gain"))


@registered
def a_beats_b(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    return compare.beats(scores, "hybrid", "bm25").select("query_id", *r6("gain"))


@registered
def win_loss_counts(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    counts = compare.outcome_counts(compare.changes(scores, "hybrid", "rerank"))
    return counts.select("outcome", "queries", *r6("share"))


@registered
def largest_changes(spark, sf_dir):
    _, _, scores = _evaluated(spark, sf_dir)
    changed = compare.changes(scores, "hybrid", "rerank")
    both = compare.largest(changed, "improved").unionByName(compare.largest(changed, "worsened"))
    return both.select("query_id", "outcome", *r6("diff"))


@registered
def largest_changes_lists(spark, sf_dir):
    """The top 5 before and after of the most improved and most worsened queries."""
    _, rankings, scores = _evaluated(spark, sf_dir)
    changed = compare.changes(scores, "hybrid", "rerank")
    cases = materialize(
        compare.largest(changed, "improved").unionByName(compare.largest(changed, "worsened")), "cases"
    )
    lists = compare.top_lists(cases, rankings, ["hybrid", "rerank"])
    shown = [F.nullif(F.array_join(m, ","), F.lit("")).alias(m) for m in ("hybrid", "rerank")]
    return lists.select("query_id", "outcome", *r6("diff"), *shown)


@registered
def stage_examples(spark, sf_dir):
    _, rankings, scores = _evaluated(spark, sf_dir)
    cases = materialize(
        compare.most_moved(compare.changes(scores, "hybrid", "rerank")), "cases"
    )
    shown = ["bm25", "hybrid", "rerank"]
    lists = compare.top_lists(cases, rankings, shown)
    joined = [F.nullif(F.array_join(m, ","), F.lit("")).alias(m) for m in shown]
    return lists.select("query_id", *r6("before", "after"), *joined)


@registered
def known_judgments(spark, sf_dir):
    shop, _, scores = _evaluated(spark, sf_dir)
    cases = compare.most_moved(compare.changes(scores, "hybrid", "rerank"))
    return compare.known_judgments(cases, shop.qrels)


# --- stored tables and models ------------------------------------------------------------


@registered
def csv_round_trip(spark, sf_dir):
    """Result rows written as CSV with quoted texts and read back with a schema."""
    docs = inputs.documents(spark, sf_dir)
    rows = docs.select("doc_id", F.regexp_replace(preview(F.col("text"), 80), "e", '"').alias("text"))
    path = fresh_dir(spark, "csv")
    tables.write_results(rows, path)
    return tables.read_csv(spark, path, rows.schema, "results")


@registered
def sample_round_trip(spark, sf_dir):
    """The graded sample, stored and read with its column check."""
    graded = prepare.grade(inputs.judgments(spark, sf_dir))
    joined = prepare.join_catalog(graded, inputs.catalog(spark, sf_dir))
    rows = prepare.drop_empty_text(prepare.add_product_text(joined))
    path = fresh_dir(spark, "sample-table")
    tables.write_sample(rows.select(*SAMPLE_COLUMNS, "product_text"), path)
    return tables.read_sample(spark, path)


@registered
def preview_rows(spark, sf_dir):
    path = fresh_dir(spark, "preview")
    rows = inputs.judgments(spark, sf_dir).select(*JUDGMENT_COLUMNS)
    tables.write_preview(rows, path, "example_id", 100)
    return tables.read_csv(spark, path, rows.schema, "preview")


@registered
def report_round_trip(spark, sf_dir):
    """The latency report as JSON lines."""
    stats = latency_stats(spark, sf_dir)
    path = fresh_dir(spark, "report")
    tables.write_report(stats, path)
    return spark.read.schema(stats.schema).json(path)


@registered
def shuffled_rows(spark, sf_dir):
    """The judgments in seeded random order, written in that order and read with their place."""
    rows = sampling.shuffled(inputs.judgments(spark, sf_dir), "example_id")
    path = fresh_dir(spark, "shuffled")
    rows.select("example_id").write.parquet(path)
    return sampling.with_position(spark.read.parquet(path), "example_id")


@registered
def resumed_vectors(spark, sf_dir):
    """Half of the documents are encoded first; the second call encodes only the others."""
    docs = inputs.documents(spark, sf_dir)
    path = fresh_dir(spark, "stored-vectors")
    half = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    ensure_vectors(spark, half, path, letter_vector)
    vectors = ensure_vectors(spark, docs, path, letter_vector)
    return vectors.select("doc_id", F.round(F.get("vec", F.lit(4)), 6).alias("e_share"))


def _letter_counts():
    """An encoder as a model would be wrapped: loaded once per worker, fed with text batches."""
    import numpy as np

    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]

    def encode(texts):
        return np.array([[t.lower().count(c) for c in letters] for t in texts], dtype=np.float32)

    return encode


@registered
def arrow_encoder(spark, sf_dir):
    """Query texts through a wrapped encoder in Arrow batches."""
    encoder = dense.encoder_udf(_letter_counts)
    asked = dense.encode_texts(inputs.text_queries(spark, sf_dir).df, encoder)
    return asked.select("query_id", F.round(F.get("vec", F.lit(4)), 6).alias("e_share"))


def _overlap():
    import numpy as np

    def score(left, right):
        out = []
        for a, b in zip(left, right):
            a, b = set(a.lower().split()), set(b.lower().split())
            out.append(len(a & b) / (len(a) * len(b)) ** 0.5 if a and b else 0.0)
        return np.array(out)

    return score


@registered
def arrow_pair_scores(spark, sf_dir):
    """Candidate pairs through a wrapped pair model in Arrow batches."""
    shop = Shop(spark, sf_dir)
    top = hybrid.fuse(shop.pool(), 0.4, 0.6, inputs.DEPTH)
    small = shop.queries.rows_fit(inputs.DEPTH, 128)
    pairs = reranking.text_pairs(
        top, shop.queries.texts, shop.corpus, None, small, shop.queries.texts_fit
    )
    scored = reranking.score_pairs(pairs, reranking.model_scorer(_overlap))
    return scored.select("query_id", "doc_id", *r6("ce_score"))


@registered
def forest_scores(spark, sf_dir):
    """A stored forest of two trees applied to the features of all candidates."""
    path = fresh_dir(spark, "forest")
    save_forest(spark, inputs.stand_in_forest(), path)
    rows = Shop(spark, sf_dir).features()
    return score_rows(rows, load_forest(spark, path)).select("query_id", "doc_id", *r6("ltr_score"))


@registered
def ltr_lambdas(spark, sf_dir):
    """The first round's gradients, from equal scores, of every training list."""
    rows = materialize(Shop(spark, sf_dir).training_rows(), "training")
    edges = ltr.bin_edges(rows, 255)
    found = ltr.first_gradients(ltr.pack(rows, edges))
    return found.select("query_id", "doc_id", *r6("grad", "hess"))


@registered
def ltr_root_sums(spark, sf_dir):
    """First-round gradients summed per label and per value of a whole-number feature."""
    rows = materialize(Shop(spark, sf_dir).training_rows(), "training")
    found = ltr.first_gradients(ltr.pack(rows, ltr.bin_edges(rows, 255)))
    joined = found.join(rows.select("query_id", "doc_id", "title_overlap_count"), ["query_id", "doc_id"])
    sums = joined.groupBy("label", "title_overlap_count").agg(
        F.sum("grad").alias("grad"), F.sum("hess").alias("hess"), F.count(F.lit(1)).alias("n")
    )
    return sums.select("label", "title_overlap_count", *(F.round(c, 4).alias(c) for c in ("grad", "hess")), "n")


# --- requests and logs -------------------------------------------------------------------


def _checked(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    return search.validate(inputs.requests(turns))


@registered
def request_validation(spark, sf_dir):
    return _checked(spark, sf_dir).withColumn("alpha", F.round("alpha", 6))


@registered
def search_batch(spark, sf_dir):
    index = inputs.text_search_index(spark, sf_dir)
    found = search.answer(search.accepted(_checked(spark, sf_dir)), index)
    return found.select("request_id", "method", "doc_id", *r6("score"), "rank")


@registered
def response_rows(spark, sf_dir):
    index = inputs.text_search_index(spark, sf_dir)
    asked = search.accepted(_checked(spark, sf_dir))
    rows = search.responses(asked, search.items(search.answer(asked, index), index.catalog))
    text = F.transform(
        "results", lambda i: F.concat_ws(":", i["rank"], i["product_id"], i["title"])
    )

    def total(name):
        values = F.aggregate("results", F.lit(0.0), lambda t, i: t + i[name])
        return F.round(values, 6).alias(f"{name}_sum")

    return rows.select(
        "request_id",
        "query",
        "ranking_method",
        "top_k",
        "count",
        F.array_join(text, ";").alias("results"),
        total("score"),
        total("confidence"),
    )


@registered
def display_labels(spark, sf_dir):
    v = F.col("value")
    return inputs.table(spark, sf_dir, "events").select(
        "event_id",
        percent_label(v / 1000.0).alias("share_label"),
        duration_label(v * 10).alias("duration_label"),
    )


@registered
def latency_stats(spark, sf_dir):
    stats = monitor.latency(inputs.search_log(spark, sf_dir))
    return stats.select(
        "method", "phase", "calls", *r6("mean_ms", "median_ms"), "min_ms", "max_ms"
    )


@registered
def stage_averages(spark, sf_dir):
    means = monitor.stage_averages(inputs.search_log(spark, sf_dir))
    return means.select(*r6("cold_mean_of_means", "warm_mean"))


@registered
def hit_rate(spark, sf_dir):
    return monitor.hit_rate(inputs.search_log(spark, sf_dir))


@registered
def throughput(spark, sf_dir):
    rates = monitor.throughput(inputs.search_log(spark, sf_dir))
    return rates.select("method", "pairs", *r6("seconds", "pairs_per_second", "ms_per_pair"))


@registered
def report_extract(spark, sf_dir):
    """The log printed as report lines, then read back as numbers."""
    log = inputs.search_log(spark, sf_dir)
    cells = [F.col("method"), F.col("phase"), F.format_string("%.2f", "latency_ms")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    place = F.col("event_id").alias("place")
    return reports.latency_table(log.select(F.lit("log").alias("file"), place, line.alias("line")))


@registered
def report_numbers(spark, sf_dir):
    """The log printed as report lines under known labels; the first of each label is read."""
    log = inputs.search_log(spark, sf_dir)
    labels = F.array(*[F.lit(f"{label.capitalize()} (all calls)") for label in list(reports.LABELS.values())[:-1]])
    label = F.get(labels, F.col("event_id") % F.size(labels))
    line = F.concat(label, F.lit(": "), F.format_number("latency_ms", 2), F.lit(" ms"))
    place = F.col("event_id").alias("place")
    return reports.numbers(log.select(F.lit("log").alias("file"), place, line.alias("line")))


def _windows(log):
    rows = windowed(log, "1 hour", by="path")
    return rows.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"),
        "path",
        "requests",
        *r6("mean_ms"),
        "max_ms",
        "p95_ms",
        "errors",
    )


@registered
def windowed_latency(spark, sf_dir):
    return _windows(inputs.search_log(spark, sf_dir))


# --- streams -----------------------------------------------------------------------------


def _as_stream(spark, sf_dir, name):
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # A pattern, because a stream takes a folder or a pattern but no single file.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


@registered
def stream_requests(spark, sf_dir):
    """`conversations` as a request stream, answered batch by batch."""
    out = fresh_dir(spark, "stream")
    index = inputs.text_search_index(spark, sf_dir)
    stream = inputs.requests(_as_stream(spark, sf_dir, "conversations"))
    serve(stream, index, out, f"{out}/checkpoint", once=True).awaitTermination()
    return spark.read.parquet(f"{out}/answers").select(
        "request_id", "method", F.col("product_id").alias("doc_id"), "score", "rank"
    )


@registered
def stream_index_refresh(spark, sf_dir):
    """The turns of half of the conversations are answered from the first version of an index.
    Then a second version with other titles is published, and all turns are sent: what was
    answered before is not answered again, the rest comes from the second version."""
    out = fresh_dir(spark, "refresh")
    versions = Versions(spark, f"{out}/index")
    goods = inputs.search_catalog(spark, sf_dir)
    stored = {"text": f"{out}/text"}
    TextIndex.build(goods).write(stored["text"], forward=True)

    def publish(titled):
        versions.publish(lambda path: titled.write.parquet(f"{path}/catalog"))

    def current():
        catalog = spark.read.parquet(f"{versions.current()}/catalog")
        return inputs.text_only_index(spark, catalog, stored["text"])

    turns = inputs.table(spark, sf_dir, "conversations")
    asked = inputs.requests(turns).withColumns({"method": F.lit("bm25"), "top_k": F.lit(5)})
    first = F.col("request_id") % 200 < 100
    for titled, sent in (
        (goods, asked.filter(first)),
        (goods.withColumn("title", F.upper("title")), asked),
    ):
        publish(titled)
        sent.write.mode("append").parquet(f"{out}/requests")
        stream = spark.readStream.schema(asked.schema).parquet(f"{out}/requests")
        serve(stream, current, out, f"{out}/checkpoint", once=True).awaitTermination()
    answers = spark.read.parquet(f"{out}/answers")
    return answers.select(
        "request_id", "rank", F.col("product_id").alias("doc_id"), "title", "score"
    )


CLOSING = "/closing"


@registered
def stream_latency(spark, sf_dir):
    """`events` as a log stream in append mode: a window is written once the watermark has
    passed it. A second batch brings late copies of the first hour's rows, which are dropped,
    and a row far ahead that closes all windows; a third one lets them be written."""
    out = fresh_dir(spark, "windows")
    log = inputs.log_columns(inputs.table(spark, sf_dir, "events"))
    first, last = log.agg(F.min("time"), F.max("time")).first()
    late = log.filter(F.col("time") < F.lit(first) + F.expr("INTERVAL 1 HOUR"))
    late = late.withColumn("latency_ms", F.col("latency_ms") + 1000)

    def closing(days):
        return log.limit(1).withColumns(
            {"time": F.lit(last) + F.expr(f"INTERVAL {days} DAYS"), "path": F.lit(CLOSING)}
        )

    for batch in (log, late.unionByName(closing(30)), closing(60)):
        batch.write.mode("append").parquet(f"{out}/log")
        stream = spark.readStream.schema(log.schema).parquet(f"{out}/log")
        (
            _windows(stream)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", f"{out}/windows")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{out}/windows").filter(F.col("path") != CLOSING)
