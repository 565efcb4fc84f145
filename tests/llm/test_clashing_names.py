"""Operators that add columns run over their own result, and beside columns with awkward names."""

import pytest
from pyspark.sql import functions as F

from rankloom.llm import decontaminate, langid, linededup, pii
from tests.llm.helpers import prose, same_rows

LINE = "a line of text that is long enough"
TEXTS = [(i, f"{LINE}\nMr John Smith wrote to john.smith@example.com {prose(i, 30)}") for i in range(5)]
AWKWARD_NAMES = [
    "_drop_id", "_drop_keys", "_n_lines", "_hit_words", "_hit_spans", "_hit_items", "_hit_count",
    "_contaminated", "_lang_pred", "_LANG_SCORE", "_pii_id", "_pii", "_n_entities", "_entity_kinds",
    "c0", "c1", "dotted.name", "tick`ed", "blank name", "lang",
]


@pytest.fixture(scope="module")
def docs(spark):
    columns = [F.col("id").alias("doc.id"), F.col("t").alias("the text")]
    own = spark.createDataFrame(TEXTS, "id long, t string").select(*columns)
    return own.select("*", *(F.lit("en").alias(n) for n in AWKWARD_NAMES))


NAMES = {"id_col": "doc.id", "text_col": "the text"}
OPERATORS = {
    "lines": lambda docs, items: linededup.dedup_lines(docs, **NAMES),
    "hits": lambda docs, items: decontaminate.judged(docs, items, text_col="the text"),
    "clean": lambda docs, items: decontaminate.decontaminate(docs, items, text_col="the text"),
    "language": lambda docs, items: langid.predict(docs, {"en": [97, 98]}, text_col="the text"),
    "people": lambda docs, items: pii.pseudonymize(docs, **NAMES),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_run_twice(spark, docs, name):
    items = spark.createDataFrame([("x", "words that stand in no document")], "item_id string, text string")
    once = OPERATORS[name](docs, items)
    twice = OPERATORS[name](once, items)
    assert len({c.lower() for c in once.columns}) == len(once.columns)
    assert sorted(twice.columns) == sorted(once.columns)
    assert set(docs.columns) <= {c for c in once.columns} | {"_LANG_SCORE"}
    kept = [f"`{c.replace('`', '``')}`" for c in ["doc.id", *AWKWARD_NAMES[14:]]]
    same_rows(once.select(kept).collect(), docs.select(kept).collect())
    assert twice.count() == len(TEXTS)
