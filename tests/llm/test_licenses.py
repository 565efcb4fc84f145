import re

from pyspark.sql import functions as F

from rankloom.llm import licenses as m
from tests.llm.helpers import AWKWARD, frame, prose, same_rows

TEXTS = [
    *AWKWARD,
    (20, "This work is licensed under the GNU General Public License, version 3."),
    (21, "GNU General Public License " * 3 + "gnu general public"),
    (22, "CC BY CC BY-NC 4.0 mit LICENSE apache-license"),
    (23, "Licensed under the Apache License, Version 2.0."),
    (24, "ccé by mit licenses"),
    (25, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"),
    (26, "free of charge. Permission is hereby granted; associated documentation files"),
    (27, prose(1, 3000) + " MIT License " + prose(2, 3000)),
    (28, "the MİT License and the MIT Kind License"),
    (29, "released under the terms of cc by sa 4 0"),
]


def words(text):
    low = re.sub("[A-Z]", lambda x: x[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def expected(texts):
    out = []
    for doc_id, text in texts:
        w, found = words(text), []
        for t in m.templates():
            for start in range(-len(t.words), len(w)):
                good = all(
                    start + at >= 0 and w[start + at : start + at + len(p)] == list(p) for at, p in t.phrases
                )
                if good:
                    hits = sum(
                        1 for k, x in enumerate(t.words) if 0 <= start + k < len(w) and w[start + k] == x
                    )
                    found.append((t.label, t.base, start, 0.5 if t.base else round(hits / len(t.words), 9)))
        out.append((doc_id, len(w), sorted(found)))
    return out


def got(df, **options):
    rows = m.scan(df, **options).select("doc_id", "_n_words", "_places").collect()
    return [
        (r[0], r[1], sorted((p["label"], p["base"], p["start"], round(p["score"], 9)) for p in r[2]))
        for r in rows
    ]


def test_brute_force(spark):
    same_rows(got(frame(spark, TEXTS)), expected(TEXTS))


def test_anchor_number_changes_nothing(spark):
    for anchors in (1, 4):
        same_rows(got(frame(spark, TEXTS), anchors=anchors), expected(TEXTS))


def test_empty_table_and_columns(spark):
    df = frame(spark, [])
    found = m.scan(df)
    assert found.count() == 0 and found.columns == [*df.columns, "_n_words", "_places"]


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = m.scan(frame(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_rare_words_are_the_anchors():
    template = m.Template.of("x", "licensed under the mit license", ("mit license",))
    assert template.anchors({"mit": 0.3, "license": 4.0}, 1) == [("license", 4)]


def test_word_splitting_of_whole_texts(spark):
    df = spark.createDataFrame([(t,) for _, t in TEXTS], "text string")
    rows = df.select("text", m.text_words(F.coalesce("text", F.lit(""))).alias("w")).collect()
    assert all(r["w"] == words(r["text"]) for r in rows)


def many(count):
    names = [f"licence{i:03d} of the maker{i:03d}" for i in range(count)]
    return m.templates()[:4] + [m.Template.of(f"own-{i}", f"under the {n} terms", (n,)) for i, n in enumerate(names)]


def test_hundreds_of_templates_have_the_plan_of_a_few(spark):
    """Index and templates are constants: nothing is unrolled by template."""

    def size(known):
        plan = m.scan(frame(spark, TEXTS), known=known)._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("lambdafunction("), plan.count("split("), len(plan.splitlines())

    assert size(many(20)) == size(many(500))


def test_hundreds_of_templates_are_told_apart(spark):
    texts = [(1, "Under the LICENCE007 of the maker007 terms, MIT license"), (2, "licence007 of the maker008")]
    rows = m.scan(frame(spark, texts), known=many(500)).collect()
    found = {r["doc_id"]: [(p["label"], p["start"], round(p["score"], 3)) for p in r["_places"]] for r in rows}
    assert found == {1: [("mit", 7, 0.5), ("own-7", 0, 1.0)], 2: []}


def test_rows_of_the_full_notices(spark):
    """Every template's own notice is found at its start with the full score."""
    own = [t for t in m.templates() if not t.base]
    rows = m.scan(frame(spark, [(i, "x " + " ".join(t.words)) for i, t in enumerate(own)])).collect()
    for r in rows:
        t = own[r["doc_id"]]
        assert (t.label, 1, 1.0) in {(p["label"], p["start"], round(p["score"], 9)) for p in r["_places"]}
