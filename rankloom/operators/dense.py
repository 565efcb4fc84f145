"""Exact inner-product search over dense vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.scores import TIE_DECIMALS
from rankloom.functions.vectors import cosine, inner_product, unit_vector
from rankloom.operators.blocksearch import Kept
from rankloom.operators.ranking import top_k
from rankloom.runtime import QuerySet, hinted

# Scores of a block that are held at once, of which there are up to four arrays.
CELLS = 1_000_000
SCALE = 10.0**TIE_DECIMALS


def vector_table(df: DataFrame, id_col: str, vec_col: str, key: str = "doc_id") -> DataFrame:
    """Any id and array columns as the common (key, vec) table of unit vectors."""
    return df.select(F.col(id_col).alias(key), unit_vector(F.col(vec_col)).alias("vec"))


def encoder_udf(make_encoder: Callable, batch_size: int = 64) -> Callable[[Column], Column]:
    """Wrap a model as a text -> vector column; the model is loaded once per Python worker."""
    return predict_batch_udf(
        make_encoder, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )


def encode_texts(df: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """Add a unit vector column `vec` for the column `text`."""
    return df.withColumn("vec", unit_vector(encoder(F.coalesce("text", F.lit("")))))


def similarity_of_pairs(pairs: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """Cosine of the listed text pairs (columns `left` and `right`)."""
    encoded = pairs.withColumns(
        {"left_vec": encoder(F.col("left")), "right_vec": encoder(F.col("right"))}
    )
    similarity = cosine(F.col("left_vec"), F.col("right_vec"))
    return encoded.withColumn("similarity", similarity).drop("left_vec", "right_vec")


def _best_of_block(
    doc_ids, doc_vecs, query_ids, query_vecs, k, kept: Kept | None = None, least: np.ndarray | None = None
) -> Iterator[tuple]:
    """At most k (query, document, score) rows per query of one block, ties by document id. Given
    the keys that earlier blocks have `kept`, only scores that reach `least`, the k-th key
    (`tie_key`) of each query so far, are ranked; it is raised here."""
    if len(doc_ids) == 0 or len(query_ids) == 0:
        return
    least = np.full(len(query_ids), -np.inf) if least is None else least
    by_id = np.argsort(doc_ids, kind="stable")
    doc_ids, doc_vecs = doc_ids[by_id], doc_vecs[by_id]
    keep = min(k, len(doc_ids))
    step = max(1, CELLS // len(doc_ids))
    for start in range(0, len(query_ids), step):
        block = query_vecs[start : start + step] @ doc_vecs.T
        floor = least[start : start + step]
        if np.isneginf(floor).any():
            key = np.rint(block * SCALE)
            cut = np.partition(key, len(doc_ids) - keep, axis=1)[:, len(doc_ids) - keep]
            rows, cols = np.nonzero(key >= np.maximum(cut, floor)[:, None])
        else:  # few scores of a later block reach the floor
            rows, cols = np.nonzero(block >= ((floor - 1.0) / SCALE)[:, None])
        key = np.rint(block[rows, cols] * SCALE)
        inside = key >= floor[rows]
        rows, cols, key = rows[inside], cols[inside], key[inside]
        order = np.lexsort((cols, -key, rows))
        rows, cols, key = rows[order], cols[order], key[order]
        first = np.searchsorted(rows, np.arange(len(block)))
        inside = np.arange(len(rows)) - first[rows] < keep
        rows, cols, key = rows[inside], cols[inside], key[inside]
        if kept is not None:
            kept.add(start + rows, key, least)
        yield query_ids[start + rows], doc_ids[cols], block[rows, cols]


def _block(data: pa.RecordBatch | pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an Arrow block as arrays."""
    ids, vecs = data.column(key), data.column("vec")
    if isinstance(data, pa.Table):
        ids, vecs = ids.combine_chunks(), vecs.combine_chunks()
    flat = vecs.flatten().to_numpy(zero_copy_only=False)
    return ids.to_numpy(zero_copy_only=False), flat.reshape(len(ids), -1) if len(ids) else flat


def _arrow_rows(found: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for columns in found:
        arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def scan_best(queries: QuerySet, docs: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: a superset of the top k of each query.

    Every block of vectors is multiplied with the query matrix and cut to k rows per query
    before anything is shuffled. A query matrix too large to broadcast is cut into slices by the
    hash of the query id; the vectors are scanned once per slice and never move.
    """
    schema = T.StructType(
        [
            queries.df.schema["query_id"],
            docs.schema["doc_id"],
            T.StructField("score", T.DoubleType()),
        ]
    )
    out = to_arrow_schema(schema)
    docs = docs.select("doc_id", "vec").filter(F.col("vec").isNotNull())
    asked = queries.vectors.filter(F.col("vec").isNotNull())
    slices = max(1, -(-queries.vector_bytes // max(queries.limit, 1)))
    slices = min(slices, max(1, queries.count))
    place = F.pmod(F.xxhash64("query_id"), F.lit(slices))
    found = None
    for number in range(slices):
        part = asked if slices == 1 else asked.filter(place == number)
        shared = docs.sparkSession.sparkContext.broadcast(_block(part.toArrow(), "query_id"))
        best = docs.mapInArrow(_scanner(shared, k, out), schema)
        found = best if found is None else found.union(best)
    return found


def _scanner(shared, k: int, out: pa.Schema) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vecs = shared.value
        kept, least = Kept(len(query_ids), k), np.full(len(query_ids), -np.inf)
        for batch in batches:
            best = _best_of_block(*_block(batch, "doc_id"), query_ids, query_vecs, k, kept, least)
            yield from _arrow_rows(best, out)

    return scan


def retrieve(queries: QuerySet, docs: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank by inner product of `vec` columns."""
    return top_k(scan_best(queries, docs, k), k)


def pair_scores(
    pairs: DataFrame,
    queries: QuerySet,
    docs: DataFrame,
    rows_per_query: int,
    name: str = "score",
) -> DataFrame:
    """Add the inner product of each listed (query, doc) pair.

    The pair list is the small side: when its checked size allows, it is broadcast and the
    vector table stays where it is.
    """
    small = queries.rows_fit(rows_per_query, 128)
    with_doc = docs.select("doc_id", F.col("vec").alias("doc_vec")).join(
        hinted(pairs, small), "doc_id"
    )
    query_vecs = queries.vectors.withColumnRenamed("vec", "query_vec")
    return (
        with_doc.join(hinted(query_vecs, queries.vectors_fit), "query_id")
        .withColumn(name, inner_product(F.col("query_vec"), F.col("doc_vec")))
        .select(*pairs.columns, name)
    )
