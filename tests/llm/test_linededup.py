import hashlib
import random
from collections import defaultdict

from rankloom.llm import linededup as d
from tests.llm.helpers import frame, same_rows

BLANK = " \t\n\v\f\r"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def expected(docs, min_docs=3, min_chars=20):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = low(line.strip(BLANK))
            if len(key) >= min_chars:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(low(line.strip(BLANK)), ())
            largest = max((x for x in own if x is not None), default=None)
            if not (len(own) >= min_docs and doc_id != largest):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def cleaned(index, spark, docs):
    return [
        (r["doc_id"], r["_n_lines"], r["_n_dropped"], r["text"] or "")
        for r in index.dedup(frame(spark, docs)).collect()
    ]


def corpus(n, seed=0):
    rng = random.Random(seed)
    lines = [f"Repeated line number {i} éß" for i in range(12)] + ["short", "", "  \t"]
    docs = []
    for i in range(n):
        own = [rng.choice(lines) for _ in range(rng.randrange(6))] + [f"only document {i} has this line"]
        rng.shuffle(own)
        docs.append((i, "\n".join(x.upper() if rng.random() < 0.3 and "é" not in x else f" {x}\r" for x in own)))
    return docs


AWKWARD = [
    (1, None),
    (2, ""),
    (3, "The line that all have.\nown three"),
    (3, "The line that all have.\nown three"),
    (4, "\tTHE LINE that all have. \nx"),
    (5, "the line that all have.\nthe line that all have."),
    (None, "the line that all have.\nno id"),
    (6, "exactly twenty chars\nnineteen characters"),
    (7, "exactly twenty chars\nnineteen characters"),
    (8, "Exactly twenty chars\nnineteen characters"),
    (9, "ééééééééééééééééééé"),
    (10, "ééééééééééééééééééé"),
    (11, "ééééééééééééééééééé\n" + "filler\n" * 30_000),
]


def test_brute_force(spark):
    for docs in (AWKWARD, corpus(60)):
        same_rows(cleaned(d.LineIndex.build(frame(spark, docs)), spark, docs), expected(docs))


def test_empty_and_columns(spark):
    docs = frame(spark, [])
    assert d.LineIndex.build(docs).dedup(docs).count() == 0
    docs = frame(spark, AWKWARD)
    assert d.dedup_lines(docs).columns == docs.columns


def test_insert_and_delete_are_reversible(spark):
    docs, more = corpus(40), [(i + 1000, t) for i, t in corpus(15, seed=3)]
    index = d.LineIndex.build(frame(spark, docs))
    both = index.insert(frame(spark, more))
    same_rows(cleaned(both, spark, docs + more), expected(docs + more))
    back = both.delete(frame(spark, more).select("doc_id"))
    same_rows(cleaned(back, spark, docs), expected(docs))
    same_rows(back.counts.collect(), index.counts.collect())
    same = back.insert(frame(spark, docs)).delete(frame(spark, [(99_999, None)]).select("doc_id"))
    same_rows(same.counts.collect(), index.counts.collect())


def test_filters_hold_repeated_keys_only_after_changes(spark):
    docs = corpus(40)
    index = d.LineIndex.build(frame(spark, docs)).delete(frame(spark, docs[:30]).select("doc_id"))
    same_rows(cleaned(index, spark, docs[30:]), expected(docs[30:]))
    repeated = index.counts.filter("n_docs >= 3").count()
    held = sum(
        int((d.CuckooFilter.load(bytes(r["slots"])).slots != 0).sum()) for r in index.filters.collect()
    )
    assert held == repeated


def test_overflowing_shard_is_rebuilt(spark):
    few = [(i, "\n".join(f"a line that comes often, {k}" for k in range(2))) for i in range(3)]
    many = [(i + 10, "\n".join(f"another line that comes often, {k}" for k in range(400))) for i in range(3)]
    index = d.LineIndex.build(frame(spark, few))
    index = d.replace(index, n_shards=1, filters=d._built(index.counts.filter("n_docs >= 3"), 1))
    grown = index.insert(frame(spark, many))
    assert grown.filters.filter("slots is null").isEmpty()
    same_rows(cleaned(grown, spark, few + many), expected(few + many))


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    made = d.CuckooFilter.build(keys)
    assert made.hits(keys).all()
    others = [hashlib.md5(f"x{i}".encode()).digest() for i in range(5000)]
    assert made.hits(others).mean() < 0.01
    made.delete_all(keys[:2500])
    assert made.hits(keys[2500:]).all() and made.hits(keys[:2500]).mean() < 0.01
    assert d.CuckooFilter.load(made.dump()).hits(keys[2500:]).all()
