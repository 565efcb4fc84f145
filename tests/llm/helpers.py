"""Awkward documents that every operator has to take."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, fp long, n_words long, component_id string, keys array<string>"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def rows(texts):
    """(doc_id, text) pairs with clashing extra columns; some languages are null."""
    return [
        (i, t, None if i is None or i % 5 == 4 else "en", "s", None, "k", 7, 1, "c", ["x"])
        for i, t in texts
    ]


LONG = prose(1, 60_000)
AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t\n "),
    (4, "one"),
    (5, LONG),
    (6, LONG),
    (7, "!!! ??? 123 456"),
    (8, prose(2, 80)),
    (8, prose(2, 80)),
    (9, prose(2, 80).upper()),
    (None, prose(3, 60)),
    (None, None),
    (10, "Größe ÉTÉ naïve İK    x\u0085y"),
]


def frame(spark, texts=None):
    return spark.createDataFrame(rows(AWKWARD if texts is None else texts), SCHEMA)


def key(row):
    return tuple((x is not None, str(x)) for x in row)


def same_rows(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
