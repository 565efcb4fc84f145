"""Term statistics and postings of a text corpus.

An index either scans the texts for each batch of queries or reads stored postings. Both give
the scorer the same thing: the postings of the query's own terms, partitioned by document, so
that summing a document's score needs no shuffle of (query, document) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.text import explode_terms, tokens
from rankloom.runtime import QuerySet, by_document, hinted, materialize

TERM_BUCKETS = 64
# Stored postings and rows are many times the texts' files: the closer codec saves a third of them.
COMPACT = "zstd"
# Postings of a bucket's file.
HOT_TERM_ROWS = 1_000_000


def unique_ids(rows: DataFrame) -> bool:
    return rows.groupBy("doc_id").count().filter("count > 1").isEmpty()


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def buckets_of(vocabulary: DataFrame) -> list[int]:
    """The buckets of some terms: at most TERM_BUCKETS numbers, which as literals prune the
    folders that are read."""
    found = vocabulary.select(_bucket(F.col("term")).alias("b")).distinct().collect()
    return [row["b"] for row in found]


def write_buckets(
    postings: DataFrame, rows: int, path: str, first: Column, key: str = "doc_id"
) -> None:
    """Store postings in a folder per term bucket, ordered by term and `first`. The files of a
    bucket grow in number with the counted rows, and a frequent term is spread over all of them
    by the hash of `key`."""
    spread = F.pmod(F.xxhash64(key), F.lit(1 + rows // (TERM_BUCKETS * HOT_TERM_ROWS)))
    (
        postings.withColumn("term_bucket", _bucket(F.col("term")))
        .repartition("term_bucket", spread)
        .sortWithinPartitions("term_bucket", "term", first)
        .write.mode("overwrite")
        .partitionBy("term_bucket")
        .parquet(path, compression=COMPACT)
    )


@dataclass(frozen=True)
class TextIndex:
    terms: DataFrame  # term, df
    n_docs: int
    total_len: int
    analyzer: Callable[[Column], Column]
    texts: DataFrame | None = None  # doc_id, dl, tokens
    stored: DataFrame | None = None  # doc_id, term, tf, dl, term_bucket, or `posting_lists`
    rows: DataFrame | None = None  # doc_id, dl, terms, amounts: a stored document's postings
    live: Callable[[DataFrame], DataFrame] | None = None  # drops stored rows that do not count

    @staticmethod
    def build(docs: DataFrame, analyzer: Callable[[Column], Column] = tokens) -> TextIndex:
        """Count the terms of `docs(doc_id, text)` in one pass and keep the counts.

        Document frequencies come from each row's distinct tokens, so only one partial count
        per term and partition is shuffled. An extra NULL term per row carries the number and
        the total length of the documents through the same aggregation.
        """
        texts = docs.select("doc_id", analyzer(F.col("text")).alias("tokens")).select(
            "doc_id", F.size("tokens").alias("dl"), "tokens"
        )
        no_term = F.lit(None).cast("string")
        counted = (
            texts.select("dl", F.explode_outer(F.array_append(F.array_distinct("tokens"), no_term)).alias("term"))
            .groupBy("term")
            .agg(
                F.count(F.lit(1)).alias("df"),
                F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("total_len"),
            )
        )
        counted = materialize(counted, "terms")
        totals = counted.filter(F.col("term").isNull()).first()
        n_docs, total_len = (totals["df"], totals["total_len"]) if totals else (0, 0)
        terms = counted.filter(F.col("term").isNotNull()).select("term", "df")
        return TextIndex(terms, n_docs, total_len, analyzer, texts=texts)

    @cached_property
    def unique(self) -> bool:
        """Does every document have its own id?"""
        return unique_ids(self.forward())

    def postings(self) -> DataFrame:
        """All postings: doc_id, term, tf, dl."""
        if self.stored is not None:
            return self._single(self.stored)
        return self._count(explode_terms(self.texts, F.col("tokens"), "doc_id", "dl"))

    def forward(self) -> DataFrame:
        """doc_id, dl, terms (with repetitions, or with their amounts): a row per document."""
        if self.rows is not None:
            return self.rows
        if self.texts is not None:
            return self.texts.select("doc_id", "dl", F.col("tokens").alias("terms"))
        return forward_rows(self.postings())

    @staticmethod
    def _count(occurrences: DataFrame) -> DataFrame:
        return (
            occurrences.groupBy("doc_id", "dl", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
            .select("doc_id", "term", "tf", "dl")
        )

    def postings_of(self, vocabulary: DataFrame) -> DataFrame:
        """Postings of a small `vocabulary(term)`, hash partitioned by document."""
        if self.stored is not None:
            kept = self.stored.filter(F.col("term_bucket").isin(buckets_of(vocabulary)))
            found = self._single(kept.join(F.broadcast(vocabulary), "term", "left_semi"))
        else:
            seen = explode_terms(self.texts, F.col("tokens"), "doc_id", "dl")
            found = self._count(seen.join(F.broadcast(vocabulary), "term", "left_semi"))
        return by_document(found)

    def _single(self, found: DataFrame) -> DataFrame:
        """One row per posting that counts, whichever way they are stored."""
        if "doc_ids" in found.columns:
            found = found.withColumn("p", F.explode(F.arrays_zip("doc_ids", "tfs", "dls"))).withColumns(
                {"doc_id": F.col("p.doc_ids"), "tf": F.col("p.tfs"), "dl": F.col("p.dls")}
            )
        found = found if self.live is None else self.live(found)
        return found.select("doc_id", "term", "tf", "dl")

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """query_id, term, qtf: a repeated word counts as often as it is said."""
        return (
            explode_terms(queries, self.analyzer(F.col("text")), "query_id")
            .groupBy("query_id", "term")
            .agg(F.count(F.lit(1)).alias("qtf"))
        )

    def vocabulary_of(self, queries: DataFrame) -> DataFrame:
        return self.query_terms(queries).select("term").distinct()

    def write(self, path: str, forward: bool = False) -> None:
        """Store the index. Postings are laid out by term bucket, so a query batch reads only
        the buckets of its own terms. With `forward` they are stored by document too, for
        batches of very many queries."""
        if forward:
            forward_rows(self.postings()).write.mode("overwrite").parquet(f"{path}/forward", compression=COMPACT)
        rows = self.terms.agg(F.sum("df")).first()[0] or 0
        write_buckets(self.postings(), rows, f"{path}/postings", F.col("tf").desc())
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        sizes = [(self.n_docs, self.total_len)]
        stats = self.terms.sparkSession.createDataFrame(sizes, "n_docs long, total_len long")
        stats = stats.withColumn("forward", F.lit(forward))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def read(
        spark: SparkSession, path: str, analyzer: Callable[[Column], Column] = tokens
    ) -> TextIndex:
        stats = spark.read.parquet(f"{path}/stats").first()
        return TextIndex(
            spark.read.parquet(f"{path}/terms"),
            stats["n_docs"],
            stats["total_len"],
            analyzer,
            stored=spark.read.parquet(f"{path}/postings"),
            rows=spark.read.parquet(f"{path}/forward") if stats["forward"] else None,
        )


def forward_rows(postings: DataFrame, amount: str = "tf") -> DataFrame:
    """doc_id, dl, terms, amounts from postings(doc_id, dl, term, <amount>)."""
    listed = F.collect_list(F.struct("term", F.col(amount).cast("double").alias("amount")))
    return (
        by_document(postings)
        .groupBy("doc_id", "dl")
        .agg(listed.alias("p"))
        .select("doc_id", "dl", F.col("p.term").alias("terms"), F.col("p.amount").alias("amounts"))
    )


def _batches(make: Callable, out: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch)
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return run


def _codes(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of some lists, and of every value that is not null its number, the number
    of its list, and whether it is not null."""
    coded = lists.flatten().dictionary_encode()
    known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)[known]
    code = coded.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, code, row, known


def _ends(place: np.ndarray, n: int) -> pa.Array:
    counts = np.bincount(place, minlength=n)
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _counted(batch: pa.RecordBatch) -> tuple[pa.Array, ...]:
    words, code, row, _ = _codes(batch.column("tokens"))
    wide = max(len(words), 1)
    cell, amount = np.unique(row * wide + code, return_counts=True)
    ends = _ends(cell // wide, batch.num_rows)
    terms = words.take(pa.array(cell % wide))
    return (
        batch.column("doc_id"),
        batch.column("dl"),
        pa.ListArray.from_arrays(ends, terms),
        pa.ListArray.from_arrays(ends, pa.array(amount.astype(float))),
    )


def counted_rows(texts: DataFrame) -> DataFrame:
    """doc_id, dl, terms, amounts of `texts(doc_id, dl, tokens)` with unique ids: every row counts
    its own words where it lies, so no posting is shuffled to make `forward_rows`."""
    fields = [
        texts.schema["doc_id"],
        texts.schema["dl"],
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("amounts", T.ArrayType(T.DoubleType())),
    ]
    schema = T.StructType(fields)
    rows = texts.select("doc_id", "dl", "tokens")
    return rows.mapInArrow(_batches(_counted, to_arrow_schema(schema)), schema)


def _listed(batch: pa.RecordBatch) -> tuple[pa.Array, ...]:
    words, code, row, known = _codes(batch.column("terms"))
    amount = batch.column("amounts").flatten().to_numpy(zero_copy_only=False)[known]
    order = np.lexsort((-amount, code))
    ends, row = _ends(code, len(words)), pa.array(row[order])
    return (
        words,
        pa.ListArray.from_arrays(ends, batch.column("doc_id").take(row)),
        pa.ListArray.from_arrays(ends, pa.array(amount[order].astype(np.int64))),
        pa.ListArray.from_arrays(ends, batch.column("dl").take(row)),
    )


def posting_lists(forward: DataFrame) -> DataFrame:
    """term, doc_ids, tfs, dls: the postings of a term in one Arrow batch of `forward(doc_id, dl,
    terms, amounts)` in one row, the largest counts first. A list is never longer than a batch."""
    ids, lengths = (forward.schema[c].dataType for c in ("doc_id", "dl"))
    kinds = {"doc_ids": ids, "tfs": T.LongType(), "dls": lengths}
    fields = [T.StructField(name, T.ArrayType(kind)) for name, kind in kinds.items()]
    schema = T.StructType([T.StructField("term", T.StringType()), *fields])
    rows = forward.select("doc_id", "dl", "terms", "amounts")
    return rows.mapInArrow(_batches(_listed, to_arrow_schema(schema)), schema)


def sum_of_products(
    postings_of: Callable[[DataFrame], DataFrame],
    vocabulary: DataFrame,
    weights: DataFrame,
    value: Column,
) -> DataFrame:
    """score(query, doc) = sum over shared terms of weight(query, term) * value(posting).

    For few queries: their terms are broadcast, postings never move except by document.
    `blocksearch` has the way for many.
    """
    matched = postings_of(vocabulary).join(F.broadcast(weights), "term")
    return matched.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") * value).alias("score"))


def pair_sums(
    postings_of: Callable[[DataFrame], DataFrame],
    all_postings: Callable[[], DataFrame],
    vocabulary: DataFrame,
    weights: DataFrame,
    pairs: DataFrame,
    queries: QuerySet,
    value: Column,
    name: str,
) -> DataFrame:
    """The same sum for listed (query, doc) pairs only; a pair without shared terms gets 0.

    Postings are already placed by document, so only the short pair list moves.
    """
    postings = postings_of(vocabulary) if queries.terms_fit else all_postings()
    return (
        pairs.join(postings, "doc_id", "left")
        .join(hinted(weights, queries.terms_fit), ["query_id", "term"], "left")
        .groupBy(*pairs.columns)
        .agg(F.coalesce(F.sum(F.col("weight") * value), F.lit(0.0)).alias(name))
    )
