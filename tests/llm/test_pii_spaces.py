"""Closed spaces that a corpus fills are permuted; all others are filled by attempts."""

import pytest

from rankloom.llm import pii
from tests.llm.helpers import frame

SCHEMA = "kind string, form string, code int"


@pytest.mark.parametrize("n", [2, 3, 10, 257, 1000])
def test_a_circle_moves_every_number_to_another(n):
    circle = pii.Circle(b"k", "test", n)
    made = [circle.step(x) for x in range(n)]
    assert sorted(made) == list(range(n))
    assert all(a != b for a, b in enumerate(made))
    assert all(circle.at(circle.place(x)) == x for x in range(n))


def test_keys_and_spaces_have_their_own_circles():
    forms = [f"192.168.7.{i}" for i in range(256)]
    one = [pii.permuted(b"k", "ipv4", f) for f in forms]
    assert one != [pii.permuted(b"j", "ipv4", f) for f in forms]
    assert [x.split(".", 2)[2] for x in one] != [
        pii.permuted(b"k", "ipv4", f.replace("192.168", "172.16")).split(".", 2)[2] for f in forms
    ]


def test_padded_octets_stay_padded_and_distinct():
    made = [pii.permuted(b"k", "ipv4", f"10.0{i}.3.{j}") for i in range(10) for j in range(256)]
    assert len(set(made)) == 2560
    assert all(m.startswith("10.0") and m.split(".")[1] in pii.PADDED_OCTETS for m in made)
    assert pii.closed_space("ipv4", "8.8.8.8") is None and pii.closed_space("ipv4", "100.1.2.3") is None


def test_a_full_private_block(spark):
    full = [("ipv4", f"192.168.{i}.{j}", 0) for i in range(256) for j in range(256)]
    other = [("ipv4", f"10.0.0.{i}", 0) for i in range(50)] + [("ipv4", "8.8.8.8", 0), ("ssn", "078051120", 0)]
    rows = pii.assign(spark.createDataFrame(full + other, SCHEMA)).collect()
    made = {(r["kind"], r["form"]): r["made"] for r in rows}
    assert len(rows) == len(made) == len(full) + len(other)
    assert len({(k, m) for (k, _), m in made.items()}) == len(made)
    assert all(m != f and m.startswith("192.168.") for (_, f), m in made.items() if f.startswith("192.168."))
    assert not {made[k, f] for k, f, _ in other} & {f for _, f, _ in other}


def test_a_crowded_space_of_numbers_is_permuted(spark):
    entities = [("ssn", f"{i:03d}", 0) for i in range(1000)]
    rows = pii.assign(spark.createDataFrame(entities, SCHEMA)).collect()
    assert sorted(r["made"] for r in rows) == [f for _, f, _ in entities]
    assert all(r["made"] != r["form"] for r in rows)


def test_a_space_that_is_not_closed_and_full_is_an_error(spark):
    entities = spark.createDataFrame([("phone", f"44{i}", 2) for i in range(10)], SCHEMA)
    with pytest.raises(RuntimeError, match="exhausted"):
        pii.assign(entities, rounds=3)


def test_texts_of_a_crowded_block(spark):
    texts = [(i, " ".join(f"host 192.168.{i}.{j}," for j in range(256))) for i in range(100)]
    rows = pii.pseudonymize(frame(spark, texts)).select("doc_id", "text").collect()
    found = [f for r in rows for *_, f in pii.mentions(r["text"])]
    assert len(found) == len(set(found)) == 25_600
