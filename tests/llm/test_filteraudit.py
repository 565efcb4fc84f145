import itertools
import random

import pandas as pd
import pytest

from rankloom.llm import filteraudit as m
from tests.llm.helpers import AWKWARD, prose, same_rows

SCHEMA = "doc_id long, text string, lang string, part string, key string, mask int, salt int, id long, good int"
LABELS = "doc_id long, quality int, toxic int"
BLANK = " \t\n\v\f\r"
LONG = prose(5, 260)


def words(text):
    out, word = [], ""
    for c in text + " ":
        if c in BLANK:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def masks(docs):
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = ""
        fails += "A" * (len(w) < 200)
        fails += "B" * (100 * len(set(w)) < 50 * len(w))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t)
        fails += "E" * (i is not None and i > least[t])
        out.append((i, lang or "", fails))
    return out


def expected(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    found, out = masks(docs), []
    for part in {p for _, p, _ in found}:
        own = [(i, f) for i, p, f in found if p == part]
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                shapley[letter] += len(gone)
                rows.append(
                    (
                        part,
                        "".join(order),
                        step + 1,
                        len(left),
                        len(gone),
                        sum(letter in f for _, f in own) - len(gone),
                        sum(f == letter for _, f in own),
                        sum(i in good for i, _ in gone),
                        sum(i in toxic for i, _ in gone),
                    )
                )
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return out


def write(spark, docs, path):
    rows = [(i, t, lang, "x", "k", 99, 1, 5, 1) for i, t, lang in docs]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def documents():
    rng = random.Random(3)
    docs = [(i, t, "en" if i is None or i % 2 else None) for i, t in AWKWARD]
    texts = [LONG, LONG.upper(), LONG + " # ", "a b " * 300, "short", None, "", "É" * 30 + "AB"]
    docs += [(i, rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(300, 100, -1)]
    docs += [(i, rng.choice(texts), "en") for i in (150, 150, 300, 20, 20, None, None)]
    return docs


LABEL_ROWS = [(i, i % 2, int(i % 7 == 0)) for i in range(100, 260)]
LABEL_ROWS += [(20, 0, 0), (20, 1, None), (None, 1, 1), (5, None, None), (7777, 1, 1)]


def test_brute_force_with_files_in_falling_and_mixed_order(spark, tmp_path):
    docs = documents()
    for k in range(5):
        write(spark, docs[k::5] if k % 2 else docs[k::5][::-1], f"{tmp_path}/docs")
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    audit = m.FilterAudit(spark, f"{tmp_path}/audit").update(f"{tmp_path}/docs", labels, batches=5)
    same_rows(m.report(audit.counters()).collect(), expected(docs, LABEL_ROWS))


@pytest.mark.parametrize("heap", [m.HEAP_BYTES, 0])
def test_new_files_retract_what_was_counted(spark, tmp_path, monkeypatch, heap):
    monkeypatch.setattr(m, "HEAP_BYTES", heap)
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    first = [(50, LONG, "en"), (51, LONG, "fr"), (52, "x", None), (101, "x", "de"), (101, "x", "de")]
    write(spark, first, f"{tmp_path}/docs")
    audit = m.FilterAudit(spark, f"{tmp_path}/audit").update(f"{tmp_path}/docs", labels)
    same_rows(m.report(audit.counters()).collect(), expected(first, LABEL_ROWS))
    second = [(20, LONG, "es"), (20, LONG, "en"), (52, "x", "de"), (99, "x", ""), (None, "x", "de")]
    write(spark, second, f"{tmp_path}/docs")
    again = m.FilterAudit(spark, f"{tmp_path}/audit").update(f"{tmp_path}/docs", labels)
    same_rows(m.report(again.counters()).collect(), expected(first + second, LABEL_ROWS))
    layout = spark.read.parquet(f"{tmp_path}/audit/layout").first()
    assert (layout["provider"] == m.ROCKSDB) == (heap == 0)
    unchanged = m.FilterAudit(spark, f"{tmp_path}/audit").update(f"{tmp_path}/docs", labels)
    same_rows(m.report(unchanged.counters()).collect(), expected(first + second, LABEL_ROWS))


def test_empty_tables(spark, tmp_path):
    write(spark, [], f"{tmp_path}/docs")
    labels = spark.createDataFrame([], LABELS)
    audit = m.FilterAudit(spark, f"{tmp_path}/audit").update(f"{tmp_path}/docs", labels)
    assert m.report(audit.counters()).count() == 0


class State:
    def __init__(self):
        self.get = None

    exists = property(lambda self: self.get is not None)

    def update(self, value):
        self.get = value


def test_any_order_of_batches_gives_the_same_counters():
    rng = random.Random(8)
    columns = ["range", "key", "part", "mask", "good", "toxic", "known", "n", "id", "n_id"]
    for _ in range(100):
        rows = [(rng.choice([b"k", b"l"]), rng.randrange(6), rng.choice("pq"), rng.random() < 0.5) for _ in range(12)]
        want = {}
        for text, i, part, good in rows:
            least = min(j for t, j, _, _ in rows if t == text)
            place = (part, 3 if i == least else 3 | m.COPY, good, False)
            want[place] = want.get(place, 0) + 1
        rng.shuffle(rows)
        state, got = State(), {}
        while rows:
            some, rows = rows[:3], rows[3:]
            frame = pd.DataFrame([(0, t, p, 3, g, False, True, 1, i, 1) for t, i, p, g in some], columns=columns)
            for out in m.retracted((0,), iter([frame]), state):
                for part, mask, good, toxic, n in out.itertuples(index=False):
                    got[part, mask, good, toxic] = got.get((part, mask, good, toxic), 0) + n
        assert {k: n for k, n in got.items() if n} == want


def test_rows_of_a_hot_text_are_folded_before_the_state(spark):
    rows = [(0, b"k", "en", 1, False, False, i) for i in range(5000)] + [(0, b"k", "en", 1, False, False, None)]
    frame = spark.createDataFrame(rows, "range int, key binary, part string, mask int, good boolean, toxic boolean, id long")
    out = m.folded(frame.coalesce(1), "bigint").collect()
    assert sorted((r["known"], r["n"], r["n_id"]) for r in out) == [(False, 1, 1), (True, 5000, 1)]
