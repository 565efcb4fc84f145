from collections import Counter

import duckdb
import numpy as np

from rankloom.llm import langid
from tests.llm.helpers import frame, same_rows

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    counts = Counter()
    word = ""
    for c in (text or "") + " ":
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            word += low
        elif word:
            framed = f" {word} "
            counts.update(word)
            counts.update(framed[i : i + 2] for i in range(len(framed) - 1))
            counts.update(framed[i : i + 3] for i in range(len(framed) - 2))
            word = ""
    return counts


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def test_grams_match_the_plain_count():
    letters = langid.letter_table()
    for text in ["", "a", "Ab b", "  x, y! z ", "été\n123 Straße ÀÉ", "日本語 x", "... 1", "İİ"]:
        codes, counts = langid.grams(text.encode(), letters)
        want = {code(g): n for g, n in plain_grams(text).items()}
        assert dict(zip(codes.tolist(), counts.tolist())) == want


def plain_predict(text, profiles, size):
    own = sorted(plain_grams(text).items(), key=lambda x: (-x[1], code(x[0])))[:size]
    if not own:
        return "und"
    best = []
    for lang, profile in profiles.items():
        rank = {c: i for i, c in enumerate(profile)}
        best.append((sum(abs(rank[code(g)] - i) if code(g) in rank else size for i, (g, _) in enumerate(own)), lang))
    return min(best)[1]


DOCS = [
    (1, "the cat and the dog and the bird", "en"),
    (2, "der hund und die katze und das haus", "de"),
    (3, "the house and the tree", "en"),
    (4, "das haus und der baum", "de"),
    (5, None, "en"),
    (6, "the", None),
    (7, "12 34 !!", "de"),
    (8, "", "en"),
    (8, "und der", "de"),
    (None, "and the", "en"),
    (9, "the tree and the bird " * 5000, None),
]


def test_brute_force(spark):
    docs = spark.createDataFrame([(*d, 1) for d in DOCS], "doc_id long, text string, lang string, code int")
    profiles = langid.train(docs, size=40)
    counts = {}
    for _, text, lang in DOCS:
        if lang and text is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    # A null id is no document to learn from by id; the operator leaves it out.
    counts["en"] -= plain_grams("and the")
    for lang, found in counts.items():
        want = [code(g) for g, _ in sorted(found.items(), key=lambda x: (-x[1], code(x[0])))[:40]]
        assert profiles[lang] == want
    got = langid.predict(docs, profiles, size=40)
    assert got.columns == [*docs.columns, "_lang_pred", "_lang_score"]
    same_rows(
        [(r["doc_id"], r["text"], r["_lang_pred"]) for r in got.collect()],
        [(i, t, plain_predict(t, profiles, 40)) for i, t, _ in DOCS],
    )
    assert all(0 <= r["_lang_score"] <= 1 for r in got.collect())


def test_nothing_to_learn(spark):
    docs = frame(spark, [])
    assert langid.train(docs) == {}
    assert langid.predict(docs, {}).count() == 0
    assert {r["_lang_pred"] for r in langid.predict(frame(spark), {}).collect()} == {"und"}


def test_bound_on_training_documents(spark):
    docs = spark.createDataFrame([(i, "aaa" if i % 2 else "bbb", "x") for i in range(50)], "doc_id long, text string, lang string")
    small = langid.train(docs, train_docs=1)
    assert len({chr(c) for c in small["x"] if c < 1 << 21}) == 1


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in langid.op6_language(spark, SF).collect()}
    truth = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").fetchall()
    held = [(got[d]["lang_pred"], lang) for d, lang in truth if got[d]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.98
