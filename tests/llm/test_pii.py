import re
from collections import defaultdict

from rankloom.llm import pii
from tests.llm.helpers import AWKWARD, frame, same_rows

TEXTS = [
    *[x for x in AWKWARD if not (x[1] and len(x[1]) > 100_000)],
    (20, "Mr. John Smith wrote to Mary Jones and Frau Müller. SMITH? Mrs Smith answered john.smith@example.com."),
    (21, "JOHN.SMITH@EXAMPLE.COM called +1 (017) 555-7713, then +1 017 555 7713 and 4111 1111 1111 1111."),
    (22, "Card 4111-1111-1111-1111, account DE89 3704 0044 0532 0130 00, host 10.1.2.3 and 8.8.8.8."),
    (23, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" ssn 078-05-1120 mac 00:1A:2B:3C:4D:5E"),
    (24, "Анна Петрова и Г-н Иванов; Κύριος Παπαδόπουλος; 2001:0db8:85a3:0000:0000:8a2e:0370:7334"),
    (25, "clean text with 1234 numbers, 3.14 and 12:30 on 2024-01-02, version 1.2.3"),
    (26, "a@b.example, c@d.example " * 300),
    (26, "a@b.example, c@d.example " * 300),
]


def test_detection():
    kinds = [[k.split(":")[0] for *_, k, _ in pii.mentions(t)] for i, t in TEXTS if i and i >= 20]
    assert kinds[0] == ["given", "surname", "given", "surname", "surname", "surname", "email"]
    assert kinds[1] == ["email", "phone", "phone", "card"]
    assert kinds[2] == ["card", "iban", "ipv4", "ipv4"]
    assert kinds[3] == ["secret", "ssn", "mac"]
    assert kinds[4] == ["given", "surname", "surname", "surname", "ipv6"]
    assert kinds[5] == []


def test_surrogates_keep_type_format_and_identity(spark):
    docs = frame(spark, TEXTS)
    got = pii.pseudonymize(docs)
    assert got.columns == [*docs.columns, "_n_entities", "_entity_kinds"]
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    made = defaultdict(set)
    text_of = defaultdict(list)
    for i, t in TEXTS:
        text_of[i].append(t)
    for r in rows:
        old = next(t for t in text_of[r["doc_id"]] if (t is None) == (r["text"] is None) and (t is None or pii.mentions(t) or t == r["text"]))
        before, after = pii.mentions(old), pii.mentions(r["text"])
        assert r["_n_entities"] == len(before)
        assert [x[2] for x in before] == [x[2] for x in after]
        for a, b in zip(before, after):
            made[a[2], a[3]].add(b[3])
            x, y = old[a[0] : a[1]], r["text"][b[0] : b[1]]
            assert x.lower() != y.lower()
            if a[2] in ("phone", "card", "ssn", "iban", "mac", "ipv6", "secret"):
                assert re.sub(r"[0-9A-Za-z]", "x", x) == re.sub(r"[0-9A-Za-z]", "x", y)
            if a[2] == "card":
                assert pii.luhn(b[3]) and b[3][0] == a[3][0]
            if a[2] == "iban":
                assert y[:2] == "DE" and int("".join(str(int(c, 36)) for c in b[3][4:] + b[3][:4])) % 97 == 1
            if a[2].startswith(("given", "surname")):
                assert pii.script_of(x) == pii.script_of(y)
    assert all(len(v) == 1 for v in made.values())  # one surrogate per entity everywhere
    by_kind = [(k[0], next(iter(v))) for k, v in made.items()]
    assert len(set(by_kind)) == len(by_kind)  # different entities stay different
    assert not set(by_kind) & set(made)  # no surrogate is a real entity


def test_given_names_are_permuted_inside_gender_and_script():
    for (script, gender), names in pii.GIVEN.items():
        made = [pii.surrogate(b"k", f"given:{script}:{gender}", n.lower(), 0) for n in names]
        assert sorted(made) == sorted(n.lower() for n in names)
        assert all(a.lower() != b for a, b in zip(names, made))


def test_collisions_are_resolved(spark):
    """There are only 10^3 numbers of this form, and 300 entities: many first tries collide."""
    entities = spark.createDataFrame([("ssn", f"{i:03d}", 0) for i in range(300)], "kind string, form string, code int")
    got = pii.assign(entities, rounds=200).collect()
    assert len(got) == 300 and len({r["made"] for r in got}) == 300
    assert not {r["made"] for r in got} & {r["form"] for r in got}


def test_key_changes_surrogates_and_result_is_stable(spark):
    docs = frame(spark, TEXTS[-8:])
    a, b = (sorted(r["text"] or "" for r in pii.pseudonymize(docs).collect()) for _ in range(2))
    c = sorted(r["text"] or "" for r in pii.pseudonymize(docs, key=b"other").collect())
    assert a == b != c


def test_empty_table(spark):
    assert pii.pseudonymize(frame(spark, [])).count() == 0


def test_clean_texts_are_unchanged(spark):
    clean = [(i, t) for i, t in TEXTS if not pii.mentions(t)]
    same_rows(
        [(r["doc_id"], r["text"]) for r in pii.pseudonymize(frame(spark, clean)).collect()], clean
    )
