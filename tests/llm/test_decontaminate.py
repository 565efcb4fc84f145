import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import decontaminate as d
from tests.llm.helpers import frame, prose, same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(low)


def expected(docs, items, size=13):
    out = []
    for doc_id, text in docs:
        own, hit, found = split(text), set(), set()
        for item_id, item in items:
            words = split(item)
            if not words:
                continue
            n = min(size, len(words))
            wins = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.update([] if item_id is None else [str(item_id)])
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append(
            (doc_id, len(own), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(own))
        )
    return out


def run(spark, docs, items, **options):
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked = d.judged(frame(spark, docs), bench, **options)
    return [
        (
            r["doc_id"],
            r["_hit_words"],
            r["_hit_count"],
            len(r["_hit_items"]),
            hashlib.sha256(",".join(r["_hit_items"]).encode()).hexdigest(),
            r["_contaminated"],
        )
        for r in marked.collect()
    ]


PASSAGE = prose(50, 40)
DOCS = [
    (1, None),
    (2, ""),
    (3, PASSAGE),
    (3, PASSAGE),
    (4, prose(51, 500) + ". " + PASSAGE.upper() + " " + prose(52, 200)),
    (5, " ".join(PASSAGE.split()[:13]) + " " + prose(53, 1000)),
    (6, " ".join(PASSAGE.split()[:12])),
    (7, "tiny item here " * 3),
    (8, prose(54, 30_000) + " " + PASSAGE),
    (None, PASSAGE),
]
# Of the items without an id, one occurs in document 4: its words are hit, no item is named.
ITEMS = [(None, prose(52, 20)), (1, PASSAGE), (2, "Tiny item"), (10, prose(55, 30)), (3, None), (4, " ! "), (None, prose(54, 50)), (1, PASSAGE)]


def test_brute_force(spark):
    same_rows(run(spark, DOCS, ITEMS), expected(DOCS, ITEMS))


def test_blocks_and_passes_change_nothing(spark):
    want = expected(DOCS, ITEMS)
    same_rows(run(spark, DOCS, ITEMS, block_windows=5), want)
    same_rows(run(spark, DOCS, ITEMS, block_windows=7, group_bytes=1), want)


def test_pieces_hold_every_window_once():
    item = [str(i).encode() for i in range(50)]
    for most in (1, 4, 37, 38, 100):
        got = [w for piece, n in d.cut(item, 13, most) for w in d.windows(piece, 13)]
        assert got == list(d.windows(item, 13))
        assert sum(n for _, n in d.cut(item, 13, most)) == len(got)
    assert list(d.cut([], 13, 4)) == [] and list(d.cut(item[:5], 13, 4)) == [(item[:5], 1)]


def test_documents_are_scanned_once_whatever_the_number_of_groups(spark):
    docs = frame(spark, DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    marked = d.scan_documents(docs, bench, block_windows=7, group_bytes=1)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_empty_tables(spark):
    assert run(spark, [], ITEMS) == []
    same_rows(run(spark, DOCS, []), expected(DOCS, []))


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs = frame(spark, DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = d.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    bad = [r[-1] for r in expected(DOCS, ITEMS)]
    assert kept.count() == len(DOCS) - sum(bad)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40),
    st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=6), max_size=6),
)
def test_scan_finds_every_occurrence(text, items):
    block = [(str(i), b" ".join(x)) for i, x in enumerate(items)]
    got = {
        (start, s.length, owner)
        for s in d.searchers(block, 4)
        for start, owners in s.scan(text)
        for owner in owners
    }
    want = set()
    for i, item in enumerate(items):
        n = min(4, len(item))
        for a in range(len(item) - n + 1):
            want |= {(p, n, str(i)) for p in range(len(text) - n + 1) if text[p : p + n] == item[a : a + n]}
    assert got == want
