import hashlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm import fim as m
from tests.llm.helpers import AWKWARD, frame, prose, same_rows

TEXTS = [
    *AWKWARD,
    (20, "a"),
    (21, "text with <S> inside"),
    (22, "ends with <"),
    (23, "<" * 700),
    (24, "𝄞 clef 😀 and é" * 400),
    (25, "$1 \\ $2 \\E \\Q (a) [b] {3}" * 30),
    (26, "line\nline\r\n end"),
    (27, "x" * 512),
    (28, "x" * 513),
    *[(100 + i, prose(i, 1 + i % 40)) for i in range(200)],
]


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, mid, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{mid}"


def test_brute_force_and_exact_round_trip(spark):
    made = m.transform(frame(spark, TEXTS))
    same_rows(made.collect(), [plain(*x) for x in TEXTS])
    back = made.select("doc_id", m.restore(F.col("output"), F.col("form")))
    same_rows(back.collect(), [(i, t or "") for i, t in TEXTS])
    assert {r["form"] for r in made.select("form").collect()} == {"plain", "psm", "spm"}


def test_very_long_text(spark):
    text = "añ😀" * 700_000
    docs = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    made = m.transform(docs)
    same_rows(made.collect(), [plain(i, text) for i in range(3)])


@pytest.mark.parametrize("block", [1, 7, 512])
def test_units_are_counted_the_same_in_any_block(spark, block):
    docs = spark.createDataFrame([(t,) for _, t in TEXTS if t], "text string")
    wrong = docs.filter(m.count_units(F.col("text"), block=block) != F.length("text"))
    assert wrong.count() == 0


def test_other_units_and_sentinels(spark):
    lines = m.FimParams(prefix="[pre]", suffix="[suf]", middle="[mid]", unit=r"(?:[^\n]*+\n|[^\n]++)", transformed=100)
    text = "one\ntwo\n\nthree"
    docs = spark.createDataFrame([(i, text) for i in range(40)], "`d.id` long, `t``x` string")
    made = m.transform(docs, lines, id_col="d.id", text_col="t`x")
    assert {r["n"] for r in made.collect()} == {4}
    back = made.select(m.restore(F.col("output"), F.col("form"), lines).alias("t")).distinct().collect()
    assert [r["t"] for r in back] == [text]
    for r in made.collect():
        cut = r["output"].replace("[suf]", "|").replace("[pre]", "|").replace("[mid]", "|").split("|")[1:]
        assert all(x == "" or x.endswith("\n") or text.endswith(x) for x in cut)


def test_empty_table_and_plan(spark):
    made = m.transform(frame(spark, []))
    assert made.count() == 0
    assert made.columns == ["doc_id", "n", "form", "prefix_units", "middle_units", "output"]
    plan = m.transform(frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
