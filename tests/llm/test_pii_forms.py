import re

import pytest

from rankloom.llm import pii
from tests.llm.helpers import frame

PHONES = """+44 20 7946 0958;+33 1 23 45 67 89;01 23 45 67 89;+49 30 1234 5678;+81 3 1234 5678
+44 (0)20 7946 0958;020 7946 0958;0171/1234567;06-12-34-56-78;0033 1 23 45 67 89;(030) 1234 5678
+1 (017) 555-7713;+4915112345678;+55 11 912 345 678""".replace("\n", ";").split(";")
ADDRESSES = "2001:db8::1 fe80::1ff:fe23:4567:890a 2001:db8:85a3::8a2e:370:7334".split()
CLEAN = "05.12.2024 and 05.12.24 10:30, 01-02-2024, 0.12345678, 10 000 000 000, std::abc, ::1"


@pytest.mark.parametrize("kind, form", [("phone", p) for p in PHONES] + [("ipv6", a) for a in ADDRESSES])
def test_form_is_found_whole(kind, form):
    text = f"call {form}, please"
    assert [(m[2], text[m[0] : m[1]]) for m in pii.mentions(text)] == [(kind, form)]
    for attempt in range(50):
        code = pii.kept_digits(kind, form)
        own = pii.canonical(kind, form)
        made = pii.surrogate(pii.KEY, kind, own, attempt)
        made = own[:code] + made[code:]
        new = pii.dressed(kind, form, made)
        again = f"call {new}, please"
        assert [(m[2], again[m[0] : m[1]], m[3]) for m in pii.mentions(again)] == [(kind, new, made)]


def test_dates_and_numbers_stay():
    assert not [m for m in pii.mentions(CLEAN) if m[2] == "ipv6" or "2024" in CLEAN[m[0] : m[1]]]
    assert not pii.mentions("05.12.2024 and 05.12.24 10:30, 01-02-2024, 0.12345678, std::abc, ::1")


def test_texts_keep_none(spark):
    texts = [(i, f"call {f} now") for i, f in enumerate([*PHONES, *ADDRESSES])]
    rows = pii.pseudonymize(frame(spark, texts)).collect()
    for r in rows:
        old = dict(texts)[r["doc_id"]]
        assert r["text"] != old
        assert re.sub("[0-9a-f]", "x", r["text"]) == re.sub("[0-9a-f]", "x", old)
