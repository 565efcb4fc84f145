import math
import random

import numpy as np
import pytest

from rankloom.llm import quality as q
from tests.llm.helpers import AWKWARD, frame, prose, same_rows

BLANK = " \t\n\v\f\r"


def plain(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in BLANK:
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


TEXTS = [
    *[x for x in AWKWARD if not (x[1] and len(x[1]) > 100_000)],
    (30, "a b c a b c a"),
    (31, "a a a a"),
    (32, "line one\nline one\n line one\n\n\n \nx\u0085y # $ <>"),
    (33, prose(4, 90) + "\n" + prose(4, 30)),
]


def test_measures_match_the_plain_count():
    for _, text in TEXTS:
        assert q.measures(None if text is None else text.encode())[:5] == plain(text)


def test_long_text():
    text = prose(1, 60_000).encode()
    assert q.measures(text)[0] == 60_000


def test_features(spark):
    got = q.features(frame(spark, TEXTS))
    rows = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for doc_id, text in TEXTS:
        m = plain(text)
        want.append((doc_id, *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    same_rows(rows.collect(), want)
    assert q.features(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n,p", [(1, 0.3), (10, 0.01), (400, 0.01), (5000, 0.008), (30, 0.9)])
def test_binomial_cdf(n, p):
    for k in {0, 1, 2, n // 100, n // 2, n - 1, n}:
        want = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n < 1000 else None
        got = q.binomial_cdf(k, n, p)
        assert 0 <= got <= 1 + 1e-12
        if want is not None:
            assert got == pytest.approx(want, abs=1e-10)
    assert q.binomial_cdf(-1, n, p) == 0


def test_large_binomial_against_the_normal_limit():
    n, p = 10_000_000, 0.01
    z = 2.0
    k = int(n * p - z * math.sqrt(n * p * (1 - p)))
    assert q.binomial_cdf(k, n, p) == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=0.02)


def test_cutoff_is_the_last_before_the_first_failure():
    assert q.cutoff(np.array([0, 1, 2, 50, 0]), 1000, 0.02, 0.01) == 2
    assert q.cutoff(np.array([50, 0]), 1000, 0.02, 0.01) == -1
    assert q.cutoff(np.array([0, 0]), 20, 0.01, 0.01) == -1  # too few labels


def labelled(spark, n, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [prose(i * 7 + k, 1) for k in range(60)]
        if not good:
            words = [w + "###" for w in words]
        elif rng.random() < 0.002:
            words[0] += "#"
        docs.append((i, " ".join(words), "en" if i % 4 else "fr"))
        labels.append((i, int(good)))
    docs += [(n, None, None), (n + 1, prose(3, 60), None), (n + 2, "", "xx")]
    labels += [(5, 0), (6, None), (None, 1), (n + 1, 1), (99_999, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_false_rejections_stay_below_the_limit(spark):
    docs, labels = labelled(spark, 6000)
    measured = q.features(docs)
    cutoffs = q.calibrate(measured, labels)
    found = {r["stratum"]: r["cutoffs"] for r in cutoffs.collect()}
    assert found["en"]["symbols"] < 1
    assert found[None] == {}  # one label is too few
    kept = {r["doc_id"]: r["kept"] for r in q.judged(measured, cutoffs).collect()}
    good = [r["doc_id"] for r in labels.groupBy("doc_id").agg({"quality": "min"}).filter("`min(quality)` = 1").collect() if r["doc_id"] in kept]
    bad = [r["doc_id"] for r in labels.filter("quality = 0").collect()]
    assert np.mean([not kept[d] for d in good]) < q.LIMIT
    assert np.mean([not kept[d] for d in bad if d != 5]) > 0.95
    assert kept[6000] is False and kept[6001] is True and kept[6002] is False


def plain_cutoffs(values, limit, delta, rule):
    """Straight from the definition: the strictest cutoff before the first that fails."""
    best = None
    for c in rule.cutoffs:
        k = sum(v > c for v in values)
        tail = math.fsum(math.comb(len(values), i) * limit**i * (1 - limit) ** (len(values) - i) for i in range(k + 1))
        if tail > delta:
            return best
        best = c
    return best


def test_cutoffs_match_the_definition(spark):
    docs, labels = labelled(spark, 2500, seed=2)
    measured = q.features(docs)
    got = {r["stratum"]: r["cutoffs"] for r in q.calibrate(measured, labels).collect()}
    label = {}
    for d, g in [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None]:
        label[d] = min(label.get(d, 1), g)
    rows = [r.asDict() for r in measured.filter("not base_failed").collect() if label.get(r["doc_id"]) == 1]
    strata = {r["stratum"] for r in rows}
    for stratum in strata:
        for rule in q.RULES:
            values = [r[rule.column] for r in rows if r["stratum"] == stratum]
            want = plain_cutoffs(values, q.LIMIT / len(q.RULES), q.ERROR / len(strata) / len(q.RULES), rule)
            assert got[stratum].get(rule.name) == want, (stratum, rule.name)


def test_no_labels(spark):
    docs, labels = labelled(spark, 50)
    measured = q.features(docs)
    cutoffs = q.calibrate(measured, labels.limit(0))
    assert cutoffs.count() == 0
    assert q.judged(measured, cutoffs).filter("kept = base_failed").count() == 0
