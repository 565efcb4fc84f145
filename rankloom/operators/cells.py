"""Exact inner-product search that reads only the cells of vectors that can matter.

Vectors are stored by cell: the cell of the nearest of a few centres, a folder each. A cell keeps
its centre c and radius r, the largest distance of a member to c, so that no member x scores above
`q·c + |q|·r` for a query q (triangle bound). A search has two passes:

1. Each query is scored in the cells of its nearest centres that hold at least k vectors together.
   The k-th score found is a lower bound of its true k-th score.
2. Each cell whose bound reaches that score for some query is read (other folders are not) and its
   vectors are scored against those queries alone, cut to k rows per query and block.

The result is that of a full scan whatever the centres are: they decide only how much is read.
Centres are fitted on a bounded sample (`FIT_ROWS`); every vector is stored and bounded.

Scale: centres, radii and counts are at most `MAX_CELLS` rows and are all that the driver keeps of
an index. The query matrix is cut into slices of a checked size; a slice gathers one number per
query. A cell of many vectors, one that holds a third of all or copies of one vector, is
written and read in parts by the hash of the id.

Defined results: null vectors are not stored and null queries find nothing; a query of zeros scores
0 everywhere; ties go to the smaller id; fewer than k vectors are all returned; an index of no
vectors returns no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.functions.scores import TIE_DECIMALS
from rankloom.functions.vectors import as_doubles
from rankloom.operators.dense import _arrow_rows, _best_of_block, _block
from rankloom.operators.ranking import top_k
from rankloom.runtime import QuerySet, materialize, scratch

FIT_ROWS = 20_000
MAX_CELLS = 4_096
PART_ROWS = 200_000
SCORES = 4_000_000  # scores of queries against centres held at once
SLACK = 1e-7  # of the size of the numbers: rounding never prunes a cell

CELLS = "cell int, centre array<double>, radius double, vectors long"


def fit_centres(vectors: DataFrame, cells: int | None = None, rows: int = FIT_ROWS) -> np.ndarray:
    """Centres (one per row) of k-means over about `rows` vectors picked by the hash of the id;
    by default about the square root of the number of vectors, at most `MAX_CELLS`."""
    total = vectors.count()
    if total == 0:
        return np.zeros((0, 0))
    wanted = min(cells or round(total**0.5), MAX_CELLS, total)
    picked = vectors
    if total > rows:
        scale = 1 << 30
        picked = vectors.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < int(scale * rows / total))
    if wanted < 2:
        return np.array(picked.select("vec").first()["vec"], dtype=float, ndmin=2)
    sample = picked.select(array_to_vector("vec").alias("features")).persist()
    try:
        model = KMeans(k=wanted, maxIter=8, initMode="random", seed=1).fit(sample)
    finally:
        sample.unpersist()
    return np.array(model.clusterCenters())


def _assigner(shared: Broadcast, out: pa.Schema) -> Callable:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        squares = (centres**2).sum(axis=1) / 2
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vecs = _block(batch, "doc_id")[1]
            step = max(1, SCORES // len(centres))
            near = np.concatenate(
                [(vecs[i : i + step] @ centres.T - squares).argmax(axis=1) for i in range(0, len(vecs), step)]
            )
            far = np.linalg.norm(vecs - centres[near], axis=1)
            columns = [batch.column("doc_id"), batch.column("vec"), pa.array(near, pa.int32()), pa.array(far)]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return assign


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """doc_id, vec, cell, distance: every vector with its nearest centre."""
    schema = T.StructType(
        [
            vectors.schema["doc_id"],
            T.StructField("vec", T.ArrayType(T.DoubleType())),
            T.StructField("cell", T.IntegerType()),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    return vectors.mapInArrow(_assigner(shared, to_arrow_schema(schema)), schema)


def write_cells(
    docs: DataFrame, path: str, cells: int | None = None, part_rows: int = PART_ROWS
) -> None:
    """Store `docs(doc_id, vec)` by cell under `path`; the table of cells comes last, so that a
    write that was cut off is no index."""
    spark = docs.sparkSession
    vectors = docs.filter(F.col("vec").isNotNull()).select("doc_id", as_doubles(F.col("vec")).alias("vec"))
    with scratch(spark):
        vectors = materialize(vectors, "vectors")
        centres = fit_centres(vectors, cells)
        if len(centres) == 0:
            vectors.write.parquet(f"{path}/vectors/cell=0")  # an empty file that holds the types
            spark.createDataFrame([], CELLS).write.parquet(f"{path}/cells")
            return
        placed = materialize(assigned(vectors, centres), "placed")
        groups = placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("vectors"))
        found = {r["cell"]: (r["radius"], r["vectors"]) for r in groups.collect()}
        parts = [max(1, -(-found.get(c, (0, 0))[1] // part_rows)) for c in range(len(centres))]
        part = F.pmod(F.xxhash64("doc_id"), F.get(F.lit(parts), F.col("cell")))
        by_cell = placed.select("doc_id", "vec", "cell", part.alias("part"))
        writer = by_cell.repartition("cell", "part").drop("part").write.option("maxRecordsPerFile", part_rows)
        writer.partitionBy("cell").parquet(f"{path}/vectors")
        rows = [(c, centres[c].tolist(), *found[c]) for c in sorted(found)]
        spark.createDataFrame(rows, CELLS).coalesce(1).write.parquet(f"{path}/cells")


@dataclass
class CellIndex:
    """Stored cells, opened for searching."""

    spark: SparkSession
    path: str

    @cached_property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    @cached_property
    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, centres, radii and counts; at most `MAX_CELLS` rows."""
        rows = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells").orderBy("cell").collect()
        return (
            np.array([r["cell"] for r in rows], dtype=int),
            np.array([r["centre"] for r in rows], dtype=float),
            np.array([r["radius"] for r in rows], dtype=float),
            np.array([r["vectors"] for r in rows], dtype=int),
        )

    def retrieve(self, queries: QuerySet, k: int = 10) -> DataFrame:
        """query_id, doc_id, score, rank: the rows of `dense.retrieve`."""
        best, _ = self.search(queries, k)
        return top_k(best, k)

    def search(self, queries: QuerySet, k: int) -> tuple[DataFrame, list[int]]:
        """A superset of the top k of each query, and the cells read for it."""
        numbers = self._cells[0]
        asked = queries.vectors.filter(F.col("vec").isNotNull())
        schema = T.StructType(
            [
                queries.df.schema["query_id"],
                self.vectors.schema["doc_id"],
                T.StructField("score", T.DoubleType()),
            ]
        )
        found, cells = self.spark.createDataFrame([], schema), set()
        if len(numbers) == 0:
            return found, []
        slices = max(1, min(-(-queries.vector_bytes // max(queries.limit, 1)), queries.count))
        place = F.pmod(F.xxhash64("query_id"), F.lit(slices))
        for number in range(slices):
            part = (asked if slices == 1 else asked.filter(place == number)).toArrow()
            ids, matrix = _block(part, "query_id")
            if len(ids) == 0:
                continue
            matrix = matrix.astype(float)
            nearest, first = self._nearest(matrix, k)
            lower = self._lower_bounds(ids, matrix, nearest, first, k, schema)
            wanted = self._reachable(matrix, lower)
            found = found.union(self._scan(ids, matrix, lower, wanted, k, schema, _reaches, True))
            cells.update(numbers[wanted].tolist())
        return found, sorted(cells)

    def _blocks(self, matrix: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        """Blocks of queries with their scores against all centres."""
        centres = self._cells[1]
        step = max(1, SCORES // len(centres))
        for i in range(0, len(matrix), step):
            yield slice(i, i + step), matrix[i : i + step] @ centres.T

    def _nearest(self, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the score of the last centre to try first, and all cells tried first."""
        counts = self._cells[3]
        cut, used = np.empty(len(matrix)), np.zeros(len(counts), dtype=bool)
        for rows, scores in self._blocks(matrix):
            order = np.argsort(-scores, axis=1, kind="stable")
            enough = np.cumsum(counts[order], axis=1) >= k
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(counts) - 1)
            at = np.arange(len(scores))
            cut[rows] = scores[at, order[at, last]]
            used |= (scores >= cut[rows][:, None]).any(axis=0)
        return cut, used

    def _lower_bounds(
        self, ids: np.ndarray, matrix: np.ndarray, cut: np.ndarray, used: np.ndarray, k: int, schema: T.StructType
    ) -> np.ndarray:
        """The k-th score of each query in its nearest cells; minus infinity below k rows."""
        best = top_k(self._scan(ids, matrix, cut, used, k, schema, _tries), k)
        last = best.filter(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(ids, kind="stable")
        lower = np.full(len(ids), -np.inf)
        known = last.column("query_id").to_numpy()
        if len(known):
            lower[order[np.searchsorted(ids[order], known)]] = last.column("score").to_numpy()
        return lower

    def _reachable(self, matrix: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Which cells can hold one of the k best vectors of some query."""
        _, centres, radii, _ = self._cells
        lengths = np.linalg.norm(matrix, axis=1)
        sizes = np.linalg.norm(centres, axis=1) + radii
        used = np.zeros(len(radii), dtype=bool)
        for rows, scores in self._blocks(matrix):
            slack = 2 * SLACK * (1 + lengths[rows][:, None] * sizes)
            bounds = scores + lengths[rows][:, None] * radii + slack
            used |= (bounds >= lower[rows][:, None]).any(axis=0)
        return used

    def _scan(
        self,
        ids: np.ndarray,
        matrix: np.ndarray,
        limit: np.ndarray,
        used: np.ndarray,
        k: int,
        schema: T.StructType,
        concerned: Callable,
        at_least: bool = False,
    ) -> DataFrame:
        """Scores of the vectors of the `used` cells against the queries concerned by each, with
        `at_least` those alone that reach the limit of their query, so that what is sorted does
        not grow with the number of cells that a query reaches."""
        numbers, centres, radii, _ = self._cells
        described = {int(n): (centres[i], radii[i]) for i, n in enumerate(numbers) if used[i]}
        shared = self.spark.sparkContext.broadcast((ids, matrix, limit, described))
        out = to_arrow_schema(schema)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries, limits, cells = shared.value
            for batch in batches:
                doc_ids, vecs = _block(batch, "doc_id")
                of = batch.column("cell").to_numpy()
                for cell in np.unique(of):
                    rows = of == cell
                    some = concerned(queries, limits, *cells[int(cell)])
                    best = _best_of_block(doc_ids[rows], vecs[rows], np.flatnonzero(some), queries[some], k)
                    if at_least:
                        best = _reaching(best, limits)
                    yield from _arrow_rows(((query_ids[q], d, s) for q, d, s in best), out)

        read = self.vectors.filter(F.col("cell").isin([int(n) for n in numbers[used]]))
        return read.select("doc_id", "vec", "cell").mapInArrow(scan, schema)


def _tries(queries: np.ndarray, cut: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """The queries that try a cell first."""
    return queries @ centre >= cut - SLACK * (1 + np.abs(cut))


def _reaches(queries: np.ndarray, lower: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """The queries for which a cell can hold one of the k best vectors."""
    lengths = np.linalg.norm(queries, axis=1)
    slack = SLACK * (1 + lengths * (np.linalg.norm(centre) + radius))
    return queries @ centre + lengths * radius + slack >= lower


def _reaching(best: Iterator[tuple], lower: np.ndarray) -> Iterator[tuple]:
    """The rows whose score is not below the lower bound of their query; equal scores tie."""
    for query, doc_id, score in best:
        kept = score >= lower[query] - 2.0 * 10.0**-TIE_DECIMALS
        if kept.any():
            yield query[kept], doc_id[kept], score[kept]
