"""Rows of the TF-IDF index against counts in plain Python."""

from collections import Counter
from math import sqrt

import numpy as np
import pyarrow as pa

from rankloom.operators.tfidf import TfidfIndex, _known_grams


def test_known_grams_of_a_batch_stay_within_their_rows():
    said = pa.array([["a", "b", "a", "b"], [], ["b", "a"], ["c"], ["a", "c"]]).slice(0, 5)
    vocabulary = pa.array(["a b", "b", "b c", "a"])
    row, term = _known_grams(said, vocabulary)
    wanted = Counter({(0, 0): 2, (0, 1): 2, (0, 3): 2, (2, 1): 1, (2, 3): 1, (4, 3): 1})
    assert Counter(zip(row.tolist(), term.tolist())) == wanted
    assert [len(x) for x in _known_grams(said.slice(1, 1), vocabulary)] == [0, 0]
    assert [len(x) for x in _known_grams(said, vocabulary.slice(0, 0))] == [0, 0]


def test_rows_hold_the_weights_of_every_known_term(spark):
    texts = [(1, "red ring red ring"), (2, "ring red"), (3, None), (4, ""), (5, "blue"), (6, "été ring été ring")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    index = TfidfIndex.fit(docs, 6)
    idf = {r["term"]: r["idf"] for r in index.vocabulary.collect()}
    found = {r["doc_id"]: r for r in index.rows.collect()}
    assert len(idf) == 6 and found.keys() == {n for n, _ in texts}
    for number, text in texts:
        words = (text or "").split()
        counts = Counter(g for g in [*words, *map(" ".join, zip(words, words[1:]))] if g in idf)
        length = sqrt(sum((n * idf[g]) ** 2 for g, n in counts.items()))
        row = found[number]
        amounts = dict(zip(row["terms"], row["amounts"]))
        assert row["dl"] == len(counts) and amounts.keys() == counts.keys()
        assert np.allclose([amounts[g] for g in counts], [n * idf[g] / length for g, n in counts.items()], rtol=1e-14)
