"""TF-IDF over words and pairs of words, cosine ranked.

Documents are weighed in place: a task counts the terms of a row that the shared vocabulary
holds and scales them to length 1, so no text and no count of a document is shuffled. Stored
weights come in two layouts: by term bucket, the largest weights of a term first, for batches
of few queries, and by document for batches of very many. Document ids must be unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.text import explode_ngrams, explode_terms, ngram_array, words
from rankloom.operators import blocksearch
from rankloom.operators.ranking import top_k
from rankloom.operators.textindex import buckets_of, sum_of_products, unique_ids, write_buckets
from rankloom.runtime import QuerySet, by_document, materialize

# Fixed value: size of the vocabulary.
MAX_FEATURES = 50_000
# A vocabulary of at most this many terms may be sent to every task.
BROADCAST_TERMS = 500_000


@dataclass(frozen=True)
class TfidfIndex:
    vocabulary: DataFrame  # term, df, idf (at most MAX_FEATURES rows)
    rows: DataFrame  # doc_id, dl (terms in the vocabulary), terms, amounts (rows of length 1)
    stored: DataFrame | None = None  # doc_id, term, value, term_bucket

    @staticmethod
    def fit(docs: DataFrame, max_features: int = MAX_FEATURES) -> TfidfIndex:
        """Choose the vocabulary, then weigh the rows of `docs(doc_id, text)`.

        The first pass counts all occurrences and all documents of each term together, with
        map-side combine, and keeps the `max_features` most frequent terms (the earlier in
        alphabetical order on a tie). The second one weighs every row by itself.
        """
        grams = docs.select(words(F.col("text")).alias("words")).select(
            ngram_array(F.col("words")).alias("grams")
        )
        both = F.array(F.col("grams"), F.array_distinct("grams"))
        counted = (
            explode_terms(
                grams.select(F.posexplode_outer(both).alias("distinct", "terms")),
                F.col("terms"),
                "distinct",
            )
            .groupBy("term")
            .agg(
                F.count_if(F.col("distinct") == 0).alias("total"),
                F.count_if(F.col("distinct") == 1).alias("df"),
            )
        )
        n_docs = docs.count()
        idf = F.ln(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
        chosen = most_frequent(materialize(counted, "grams"), max_features)
        vocabulary = materialize(chosen.select("term", "df", idf.alias("idf")), "vocabulary")
        # Read by several batches of queries; smaller than the texts.
        return TfidfIndex(vocabulary, materialize(_weighed(docs, vocabulary), "tfidf-rows"))

    def postings_of(self, vocabulary: DataFrame) -> DataFrame:
        """doc_id, term, value of a small `vocabulary(term)`, hash partitioned by document."""
        if self.stored is not None:
            kept = self.stored.filter(F.col("term_bucket").isin(buckets_of(vocabulary)))
        else:
            kept = self._exploded()
        found = kept.join(F.broadcast(vocabulary), "term", "left_semi")
        return by_document(found.select("doc_id", "term", "value"))

    def _exploded(self) -> DataFrame:
        pairs = F.arrays_zip(F.col("terms").alias("term"), F.col("amounts").alias("value"))
        return self.rows.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")

    def query_weights(self, queries: QuerySet) -> DataFrame:
        counts = _query_terms(queries).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
        return _unit_rows(counts, self.vocabulary, "query_id").withColumnRenamed("value", "weight")

    def write(self, path: str) -> None:
        """Store the weights by term bucket, large ones first, and by document."""
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        n_rows = self.vocabulary.agg(F.sum("df")).first()[0] or 0
        write_buckets(self._exploded(), n_rows, f"{path}/weights", F.col("value").desc())

    @staticmethod
    def read(spark: SparkSession, path: str) -> TfidfIndex:
        return TfidfIndex(
            *(spark.read.parquet(f"{path}/{name}") for name in ("vocabulary", "rows", "weights"))
        )


def _weighed(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """doc_id, dl, terms, amounts: tf * idf of every row, scaled to length 1. Rows without a
    term of the vocabulary have empty lists."""
    spark = docs.sparkSession
    if vocabulary.count() > BROADCAST_TERMS:
        return _weighed_by_join(docs, vocabulary)
    known = vocabulary.select("term", "idf").toArrow().combine_chunks()
    parts = known.column("term").combine_chunks(), known.column("idf").to_numpy()
    shared = spark.sparkContext.broadcast(parts)
    terms = T.ArrayType(T.StringType())
    schema = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("dl", T.IntegerType()),
            T.StructField("terms", terms),
            T.StructField("amounts", T.ArrayType(T.DoubleType())),
        ]
    )
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    return split.mapInArrow(_weigher(shared, to_arrow_schema(schema)), schema)


def _weigher(shared, out: pa.Schema) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, idf = shared.value
        for batch in batches:
            row, term = _known_grams(batch.column(1), vocabulary)
            cell, amount = np.unique(row * max(len(idf), 1) + term, return_counts=True)
            row, term = cell // max(len(idf), 1), cell % max(len(idf), 1)
            weight = amount * idf[term]
            length = np.sqrt(np.bincount(row, weight * weight, batch.num_rows))
            sizes = np.bincount(row, minlength=batch.num_rows)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = (
                batch.column(0),
                pa.array(sizes),
                pa.ListArray.from_arrays(ends, vocabulary.take(pa.array(term))),
                pa.ListArray.from_arrays(ends, pa.array(weight / length[row])),
            )
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return weigh


def _known_grams(said: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number in the vocabulary of every word and pair of neighbouring words of some word
    lists that the vocabulary holds. Texts of pairs are only made once per distinct pair."""
    coded = said.flatten().dictionary_encode()
    words, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = pc.list_value_length(said).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(said)), sizes)
    wide = max(len(words), 1)
    beside = row[1:] == row[:-1]
    pair, of = np.unique((code[:-1] * wide + code[1:])[beside], return_inverse=True)
    ends = words.take(pa.array(pair // wide)), words.take(pa.array(pair % wide))
    single = _numbers(words, vocabulary)[code]
    double = _numbers(pc.binary_join_element_wise(*ends, " "), vocabulary)[of]
    row, term = np.concatenate([row, row[1:][beside]]), np.concatenate([single, double])
    return row[term >= 0], term[term >= 0]


def _numbers(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """The place of each term in the vocabulary, -1 where it is not there."""
    found = pc.index_in(terms, value_set=vocabulary).fill_null(-1)
    return found.to_numpy(zero_copy_only=False).astype(np.int64)


def _weighed_by_join(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The same for a vocabulary too large for every task: only counts of its terms are moved."""
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    counts = (
        explode_ngrams(split, "words", "doc_id")
        .join(vocabulary.select("term"), "term")
        .groupBy("doc_id", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    listed = F.collect_list(F.struct("term", "value")).alias("p")
    return (
        _unit_rows(counts, vocabulary, "doc_id")
        .groupBy("doc_id")
        .agg(listed)
        .select(
            "doc_id",
            F.size("p").alias("dl"),
            F.col("p.term").alias("terms"),
            F.col("p.value").alias("amounts"),
        )
    )


def most_frequent(counted: DataFrame, n: int) -> DataFrame:
    """The n rows of `counted(term, total, ...)` with the largest totals, ties by term.

    Terms are counted per total; the running count tells the total at which n is reached. There
    are at most sqrt(2 x occurrences) different totals. Everything above that total is taken
    unsorted, and only the terms on it are sorted.
    """
    order = Window.orderBy(F.col("total").desc())
    per_total = counted.groupBy("total").agg(F.count(F.lit(1)).alias("terms"))
    upto = per_total.withColumn("upto", F.sum("terms").over(order))
    cut = upto.filter(F.col("upto") >= n).orderBy("upto").select("total", "terms", "upto").first()
    if cut is None:
        return counted
    above = counted.filter(F.col("total") > cut["total"])
    on = counted.filter(F.col("total") == cut["total"])
    return above.unionByName(on.orderBy("term").limit(n - (cut["upto"] - cut["terms"])))


def _query_terms(queries: QuerySet) -> DataFrame:
    split = queries.texts.select("query_id", words(F.col("text")).alias("words"))
    return explode_ngrams(split, "words", "query_id")


def _unit_rows(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """tf * idf, scaled so that the squares of one text's weights sum to 1."""
    weighed = counts.join(vocabulary.select("term", "idf"), "term").withColumn(
        "w", F.col("tf") * F.col("idf")
    )
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighed.select(key, "term", (F.col("w") / length).alias("value"))


def scores(queries: QuerySet, index: TfidfIndex) -> DataFrame:
    """query_id, doc_id, score of every document that shares a term with one of few queries."""
    return sum_of_products(
        index.postings_of,
        _query_terms(queries).select("term").distinct(),
        index.query_weights(queries),
        F.col("value"),
    )


def _as_stored(amount: np.ndarray, dl: np.ndarray) -> np.ndarray:
    return amount


def retrieve(queries: QuerySet, index: TfidfIndex, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank. Few queries are answered from stored term buckets, all others
    in blocks of documents unless ids repeat."""
    if queries.terms_fit and (index.stored is not None or not unique_ids(index.rows)):
        return top_k(scores(queries, index), k)
    return blocksearch.retrieve(
        index.rows, index.query_weights(queries), queries, _as_stored, k, written=True
    )
