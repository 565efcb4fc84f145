import random

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import edits as e
from rankloom.llm import tokens
from tests.llm.helpers import AWKWARD, frame, prose, same_rows

ENCODE = tokens.encoder(tokens.read_ranks()).encode_ordinary


def count(text):
    return len(ENCODE(text))


def edited(text, edits):
    parts, at = [], 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        at = stop
    return "".join(parts) + text[at:]


PIECES = ["a", "word", " ", "  ", "\n", "\n\n", "'s", "!", "é", "12", "\t", " x", "日本", "don't", " ", "."]


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.sampled_from(PIECES), max_size=60).map("".join),
    st.lists(st.tuples(st.integers(0, 90), st.integers(0, 6), st.lists(st.sampled_from(PIECES), max_size=3).map("".join)), max_size=5),
    st.integers(1, 12),
)
def test_counts_equal_a_full_recount(text, raw, leaf):
    wanted = e.usable([(a, a + n, t) for a, n, t in raw], len(text))
    tree = e.CountTree.build(text, count, leaf)
    assert tree.n_tokens == count(text)
    new = text
    for group in reversed(e.grouped(tree, wanted)):
        new, _ = tree.replace(new, group, count, leaf)
    assert new == edited(text, wanted)
    assert tree.n_tokens == count(new)
    assert tree.chars[1] == len(new)
    again = e.CountTree.load(*tree.dump())
    assert (again.n_tokens, again.chars) == (tree.n_tokens, tree.chars)


def test_few_characters_are_encoded_again():
    text = prose(1, 20_000)
    tree = e.CountTree.build(text, count, e.LEAF)
    _, work = tree.replace(text, [(50_000, 50_004, "xyz")], count, e.LEAF)
    assert work < 3 * e.LEAF


def test_usable_edits():
    assert e.usable([(5, 9, "b"), (0, 6, "a"), (9, 12, "c"), (3, 1, "x"), (0, 50, "y")], 10) == [(0, 6, "a")]
    assert e.usable([(2, 2, None)], 3) == [(2, 2, "")]


def test_state_and_repeated_edits(spark):
    rng = random.Random(3)
    docs = [x for x in AWKWARD if not (x[1] and len(x[1]) > 100_000)] + [(40, prose(6, 3000))]
    rows, want = [], []
    for i, (_, text) in enumerate(docs):
        length = len(text or "")
        own = e.usable([(a := rng.randrange(length + 1), a + rng.randrange(4), " new") for _ in range(4)], length)
        rows.append((i, text, [(a, b, t) for a, b, t in own] or None, 1))
        new = edited(text or "", own)
        want.append((i, count(text or ""), count(new), len(own), new if own else text))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {e.EDIT}, n_before int")
    state = e.apply(e.build(df, extra=("edits",)))
    same_rows(state.select("doc_id", "n_before", "n_tokens", "n_edits", "text").collect(), want)
    # The state is edited once more: everything goes.
    gone = state.selectExpr("doc_id", "text", "leaf_chars", "leaf_tokens", "array(struct(0 as start, length(coalesce(text, '')) as stop, 'last words' as text)) as edits")
    twice = e.apply(gone)
    assert {r["n_tokens"] for r in twice.collect()} == {count("last words")}


def test_empty_table_and_whole_query(spark):
    assert e.apply(e.build(e.with_cleaning_edits(frame(spark, [])), extra=("edits",))).count() == 0
    text = "a ### b 1234567890 | c " * 50
    docs = [(1, text), (1, text), (2, None), (None, "x")]
    got = e.apply(e.build(e.with_cleaning_edits(frame(spark, docs)), extra=("edits",)))
    new = edited(text, e.cleaning_edits(text))
    same_rows(
        got.select("doc_id", "n_tokens", "text").collect(),
        [(1, count(new), new)] * 2 + [(2, 0, None), (None, count("x"), "x")],
    )
