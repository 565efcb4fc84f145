"""The pipeline against plain single-machine versions of its stages, and the SQL twins."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from rankloom.llm import packing, tokens
from rankloom.llm.registry import ORACLE_SQL, QUERIES
from tests.llm import test_decontaminate, test_linededup, test_neardup
from tests.llm.helpers import frame, same_rows
from tools.check import _rows

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in sorted(SF.glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, engine, name):
    df = QUERIES[name](spark, str(SF))
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = engine.execute(ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, result.fetchall())


def test_every_operator_is_registered():
    names = contract.queries()
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert "pipeline" in names


def plain_stages(docs, items):
    kept = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    yield kept
    kept = [(i, text) for i, _, _, text in test_linededup.expected(kept)]
    yield kept
    kept = test_neardup.plain_kept(kept)
    yield kept
    bad = [r[-1] for r in test_decontaminate.expected(kept, items)]
    yield [x for x, b in zip(kept, bad) if not b]


def test_stages_match_plain_versions(spark, engine):
    docs = engine.execute("SELECT doc_id, text FROM documents").fetchall()
    docs += [(9001, None), (9002, "123 !!"), (9003, ""), (9004, docs[0][1]), (9005, docs[0][1])]
    items = engine.execute("SELECT item_id, text FROM benchmark").fetchall()
    now = frame(spark, docs)
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain_stages(docs, items)):
        now = stage(spark, now, str(SF))
        assert now.columns == frame(spark, []).columns
        same_rows([(r["doc_id"], r["text"] or "") for r in now.collect()], want)
        now = corpus_pipeline.materialize(now, "test")
    encode = tokens.encoder(tokens.read_ranks()).encode_ordinary
    packed = corpus_pipeline.STAGES[-1][1](spark, now, str(SF)).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {i: n for i, t in want if (n := len(encode(t)))}
    assert all(r["bin_offset"] + r["n_tokens"] <= r["bin_size"] <= max(packing.LENGTHS) for r in packed)


def test_stages_take_an_empty_table(spark):
    now = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, str(SF)), "test")
        assert now.count() == 0
