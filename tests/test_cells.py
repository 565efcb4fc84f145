"""Cells of vectors: the rows of a full scan, from fewer cells."""

import numpy as np
import pytest

from rankloom.operators import dense
from rankloom.operators.cells import CellIndex, fit_centres, write_cells
from rankloom.runtime import QuerySet, fresh_dir

IDS = "doc_id long, vec array<double>"
ASKED = "query_id long, vec array<double>"


def clustered(groups=20, each=40, dim=8, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return np.repeat(centres, each, axis=0) + rng.normal(size=(groups * each, dim)) * spread


def rows(matrix, start=0):
    return [(start + i, [float(x) for x in v]) for i, v in enumerate(matrix)]


def stored(spark, data, **options):
    path = fresh_dir(spark, "test-cells")
    write_cells(spark.createDataFrame(data, IDS).repartition(3), path, **options)
    return CellIndex(spark, path)


def triples(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def full(spark, data, queries, k):
    return triples(dense.retrieve(queries, spark.createDataFrame(data, IDS), k))


@pytest.mark.parametrize("cells", [1, 7, 60])
@pytest.mark.parametrize("k", [1, 10])
def test_rows_of_a_full_scan(spark, cells, k):
    data = rows(clustered())
    queries = QuerySet(spark.createDataFrame(rows(clustered(5, 3, seed=2)), ASKED))
    index = stored(spark, data, cells=cells)
    assert triples(index.retrieve(queries, k)) == full(spark, data, queries, k)


def test_unclustered_vectors_of_any_length(spark):
    rng = np.random.default_rng(3)
    data = rows(rng.normal(size=(400, 6)) * rng.exponential(3, size=(400, 1)))
    queries = QuerySet(spark.createDataFrame(rows(rng.normal(size=(30, 6))), ASKED))
    assert triples(stored(spark, data).retrieve(queries, 5)) == full(spark, data, queries, 5)


def test_fewer_cells_are_read_of_clustered_vectors(spark):
    data = rows(clustered(40, 30, 12, spread=0.01))
    queries = QuerySet(spark.createDataFrame([data[5], data[6]], ASKED))
    index = stored(spark, data, cells=40)
    best, cells = index.search(queries, 10)
    known = index._cells[0]
    assert 0 < len(cells) < len(known) / 2
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_slices_of_queries(spark):
    data = rows(clustered())
    asked = spark.createDataFrame(rows(clustered(10, 3, seed=5)), ASKED)
    got = stored(spark, data).retrieve(QuerySet(asked, limit=600), 4)
    assert triples(got) == full(spark, data, QuerySet(asked), 4)


def test_a_cell_of_copies_is_written_in_parts(spark):
    same = np.ones((300, 4))
    other = np.random.default_rng(7).normal(size=(100, 4))
    data = rows(np.concatenate([same, other]))
    index = stored(spark, data, cells=5, part_rows=50)
    hot = index.vectors.groupBy("cell").count().orderBy("count", ascending=False).first()["cell"]
    files = index.vectors.filter(f"cell = {hot}").inputFiles()
    assert len(files) > 1
    queries = QuerySet(spark.createDataFrame(rows(np.ones((2, 4))), ASKED))
    assert triples(index.retrieve(queries, 20)) == full(spark, data, queries, 20)


def test_nulls_zeros_ties_and_short_tables(spark):
    data = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 2.0])]
    queries = QuerySet(spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0])], ASKED))
    got = triples(stored(spark, data, cells=3).retrieve(queries, 9))
    assert got == full(spark, data, queries, 9)
    assert [r[2] for r in got if r[0] == 1] == [1, 4, 3, 5] and not [r for r in got if r[0] == 2]


def test_empty_tables(spark):
    none = stored(spark, [])
    queries = QuerySet(spark.createDataFrame([(1, [1.0, 0.0])], ASKED))
    assert none.retrieve(queries, 3).count() == 0
    some = stored(spark, [(1, [1.0, 0.0])])
    assert some.retrieve(QuerySet(spark.createDataFrame([], ASKED)), 3).count() == 0
    assert triples(some.retrieve(queries, 3)) == [(1, 1, 1, 1.0)]


def test_text_ids(spark):
    data = [(f"d{i:03}", v) for i, v in rows(clustered(6, 10))]
    queries = QuerySet(spark.createDataFrame([("q", data[0][1]), ("p", data[30][1])], "query_id string, vec array<double>"))
    docs = spark.createDataFrame(data, "doc_id string, vec array<double>")
    path = fresh_dir(spark, "test-cells")
    write_cells(docs, path)
    got = triples(CellIndex(spark, path).retrieve(queries, 5))
    assert got == triples(dense.retrieve(queries, docs, 5))


def test_centres_come_from_a_bounded_sample(spark):
    docs = spark.createDataFrame(rows(clustered(10, 100)), IDS)
    assert fit_centres(docs, 8, rows=100).shape == (8, 8)
