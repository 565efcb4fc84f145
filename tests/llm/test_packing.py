from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import packing as p
from rankloom.llm import tokens
from tests.llm.helpers import AWKWARD, frame


def plain(lengths, permitted, cost):
    """Best fit, one piece at a time; the size of a new bin by the operator's own look-ahead."""
    left, bins = Counter(lengths), []
    for length in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= length]
        if not fits:
            usable = sorted(n for n, c in left.items() if c and n <= length)
            size = min(
                (s for s in permitted if s >= length),
                key=lambda s: (cost(s) / p._filled(s, length, dict(left), usable), s),
            )
            # the bins that the pieces of this length fill are opened at once
            fits = [[size, size, []] for _ in range(max(1, left[length] // (size // length)))]
            bins += fits
        chosen = min(fits, key=lambda b: (b[0], b[1]))
        chosen[0] -= length
        chosen[2].append(length)
        left[length] -= 1
    return Counter(
        (tuple(sorted(b[2])), next(s for s in permitted if s >= sum(b[2]))) for b in bins
    )


def unfolded(lengths, permitted):
    runs, sizes = p.plan(Counter(lengths), permitted)
    bins = defaultdict(list)
    for r in runs:
        for i in range(r.count):
            turn, place = divmod(i, r.per_bin)
            bins[r.first_bin + turn].append((r.offset + place * r.length, r.length))
    starts = [a for a, _ in sizes]
    out = Counter()
    for b, content in bins.items():
        content.sort()
        at = 0
        for offset, length in content:
            assert offset == at
            at += length
        size = sizes[max(i for i, a in enumerate(starts) if a <= b)][1]
        assert at <= size and size == next(s for s in permitted if s >= at)
        out[tuple(sorted(n for _, n in content)), size] += 1
    assert Counter(n for k, c in out.items() for n in k[0] * c) == Counter(lengths)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_plan_is_best_fit(lengths):
    permitted = (8, 16, 32, 64)
    got, want = unfolded(lengths, permitted), plain(lengths, permitted, p.sequence_cost)
    # Bins of equal room and size are interchangeable: fills are compared, not pairings.
    fills = [Counter(), Counter()]
    for out, found in zip(fills, (got, want)):
        for (content, size), n in found.items():
            out[sum(content), size] += n
    assert fills[0] == fills[1]


def test_ranks_are_whole(spark):
    counts = spark.createDataFrame(
        [(i, 100 if i % 3 else i % 700) for i in range(3000)] + [(None, 50), (7, 7), (7, 7), (8, None), (9, 20_000)],
        "doc_id long, n_tokens long",
    )
    got = p.pack(counts, (128, 256, 1024), blocks=16).collect()
    want = sum(r["n_tokens"] or 0 for r in counts.collect())
    assert sum(r["n_tokens"] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for content in bins.values():
        content.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in content:
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert len({r["bin_size"] for r in content}) == 1 and at <= content[0]["bin_size"]
    assert want / sum(c[0]["bin_size"] for c in bins.values()) > 0.9
    long = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in got if r["doc_id"] == 9 and r["piece"] or r["n_tokens"] == 1024)
    assert [x[1] for x in long[:3]] == [0, 1024, 2048]
    histogram = Counter(r["n_tokens"] for r in got)
    runs, sizes = p.plan(histogram, (128, 256, 1024))
    assert len(bins) == max(r.first_bin + -(-r.count // r.per_bin) for r in runs)


def test_counts_and_awkward_rows(spark):
    docs = frame(spark)
    encode = tokens.encoder(tokens.read_ranks()).encode_ordinary
    counts = p.token_counts(docs).collect()
    assert sorted(r["n_tokens"] for r in counts) == sorted(len(encode(t or "")) for _, t in AWKWARD)
    packed = p.pack_documents(docs)
    assert sum(r["n_tokens"] for r in packed.collect()) == sum(len(encode(t or "")) for _, t in AWKWARD)
    assert p.pack_documents(frame(spark, [])).count() == 0


def test_too_long_piece_is_refused():
    with pytest.raises(ValueError):
        p.plan({100: 1}, (50,))


def test_plan_grows_with_lengths_not_rows():
    small = p.plan({n: 3 for n in range(1, 500)}, (512, 1024))
    large = p.plan({n: 3_000_000 for n in range(1, 500)}, (512, 1024))
    assert len(large[0]) < 4 * len(small[0]) + 5000
