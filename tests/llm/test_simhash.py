import random
import re

import numpy as np
import pytest
import xxhash

from rankloom.llm import components
from rankloom.llm import simhash as s
from tests.llm.helpers import AWKWARD, frame, prose, same_rows


def plain_fingerprint(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def classes(values, max_bits):
    """Index → smallest index of its component, by comparing all pairs."""
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= max_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_brute_force(spark):
    docs = [x for x in AWKWARD if x[0] is not None] + [
        (100 + i, prose(9, 300) + (" tail" * (i % 3))) for i in range(6)
    ]
    got = s.near_duplicates(frame(spark, docs))
    prints = [plain_fingerprint(t, 3) for _, t in docs]
    roots = classes(prints, 2)
    want = []
    for i, (doc_id, _) in enumerate(docs):
        least = min(docs[j][0] for j in range(len(docs)) if roots[j] == roots[i])
        want.append((doc_id, f"{prints[i]:016x}", least, roots.count(roots[i])))
    same_rows(
        got.select("doc_id", s.hexed(got["fp"]), "component_id", "component_size").collect(), want
    )


def test_null_ids_empty_and_columns(spark):
    docs = frame(spark)
    found = s.near_duplicates(docs)
    assert found.count() == docs.count()
    blank = found.filter("fp = 0").select("component_id").distinct().collect()
    assert [r[0] for r in blank] == [1]
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    assert s.near_duplicates(frame(spark, [])).count() == 0


def test_keep_one_leaves_one_of_each_group(spark):
    docs = [(i, prose(i // 4, 200)) for i in range(20)]
    assert sorted(r["doc_id"] for r in s.keep_one(frame(spark, docs)).collect()) == [0, 4, 8, 12, 16]


@pytest.mark.parametrize("max_bits", [2, 4])
@pytest.mark.parametrize("bucket", [3, 64])
def test_links_give_the_components_of_the_relation(spark, max_bits, bucket):
    rng = random.Random(max_bits * 100 + bucket)
    values = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        cloud = [centre]
        for _ in range(25):
            near = rng.choice(cloud)
            for b in rng.sample(range(64), rng.randrange(1, max_bits + 2)):
                near ^= 1 << b
            cloud.append(near)
        values |= set(cloud)
    values |= {rng.getrandbits(64) for _ in range(50)} | {0, 2**64 - 1}
    values = sorted(values)
    signed = np.array(values, "<u8").view("<i8").tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = s.links(fps, max_bits, bucket)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = classes(values, max_bits)
    got = [roots.get(v, v) for v in signed]
    pairs = {(a, b) for a, b in zip(want, got)}
    assert len(pairs) == len(set(want)) == len(set(got))


def test_dense_cloud_within_one_chunk(spark):
    values = [(i ^ (i >> 1)) << 8 for i in range(3000)]  # one chain, neighbours one bit apart
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    roots = components.connected_components(s.links(fps)).collect()
    assert len(roots) == 3000 and len({r["root"] for r in roots}) == 1


def test_max_bits_must_be_even(spark):
    with pytest.raises(ValueError):
        s.links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(2000, 2300)] + [(5, 5), (7, None)]
    found = components.connected_components(spark.createDataFrame(edges, "u long, v long"))
    roots = {r["node"]: r["root"] for r in found.collect()}
    assert all(roots[i] == 0 for i in range(201))
    assert all(roots[i] == 1000 for i in [1000, *range(2000, 2300)])
    assert len(roots) == 201 + 301
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
