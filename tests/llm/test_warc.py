import base64
import gzip
import hashlib
import random
import uuid
from pathlib import Path

import pytest

from rankloom.llm import warc
from tests.llm.helpers import prose, same_rows


def expected(pages, least=1000):
    best = {}
    for page_id, _, html in pages:
        raw = (html or "").encode()
        if len(raw) >= least and page_id is not None:
            best[raw] = max(best.get(raw, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        raw = (html or "").encode()
        keeper = best.get(raw) if len(raw) >= least else None
        refers = keeper if keeper is not None and keeper != page_id and len([p for p in pages if (p[2] or "").encode() == raw]) > 1 else None
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return out


def round_trip(spark, pages, tmp_path, **options):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / uuid.uuid4().hex)
    warc.write_archives(df.withColumn("digest", df.url).withColumn("packed", df.url), path, **options)
    got = warc.resolved(warc.read_archives(spark, path))
    return got.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").collect(), path


FAKE = (
    "text WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:rankloom:page:99>\r\n"
    "Content-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n and WARC/1.1\r\nContent-Length: 3\r\n\r\n"
)
BIG = prose(5, 400)
PAGES = [
    (1, "http://a/", BIG),
    (2, "http://b/ with space\r\nX: y", BIG),
    (3, None, BIG),
    (4, "http://c/", None),
    (5, "http://c/", ""),
    (6, "http://c/", "small"),
    (7, "http://c/", "small"),
    (8, "http://d/é", FAKE),
    (9, "http://d/", BIG + FAKE * 3 + "é" * 500),
    (10, "http://d/", BIG + FAKE * 3 + "é" * 500),
    (11, "http://e/", "\r\n\r\n" + BIG + "WARC/1.1\r\n"),
    (12, "http://f/", "WARC/1.1\r\n"),
    (13, "http://g/", "x" * 300_000 + FAKE),
    (None, "http://h/", "no id"),
    (14, "http://e/", "a" * 999),
    (15, "http://e/", "a" * 999),
    (16, "http://e/", "a" * 1000),
    (17, "http://e/", "a" * 1000),
    (17, "http://e/", "a" * 1000),
]


def test_round_trip(spark, tmp_path):
    got, _ = round_trip(spark, PAGES, tmp_path)
    same_rows(got, expected(PAGES))


@pytest.mark.parametrize("size", ["2k", "20k"])
def test_splits_of_any_size(spark, tmp_path, size):
    rng = random.Random(1)
    pages = [(i, f"u{i}", prose(i % 40, rng.randrange(1, 400)) + (FAKE if i % 7 == 0 else "")) for i in range(300)]
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, size)
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        got, path = round_trip(spark, pages + PAGES[:3] + PAGES[12:13], tmp_path)
        same_rows(got, expected(pages + PAGES[:3] + PAGES[12:13]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_one_id_with_several_payloads(spark, tmp_path):
    pages = [(1, "u", "A" * 1200), (1, "u", "B" * 1500), (0, "u", "A" * 1200), (0, "u", "B" * 1500), (0, "u", "C")]
    got, _ = round_trip(spark, pages, tmp_path)
    same_rows(got, expected(pages))


def test_compressed_archives_and_other_versions(spark, tmp_path):
    _, path = round_trip(spark, PAGES[:8], tmp_path)
    whole = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part*")))
    start = [i for i in range(len(whole)) if whole.startswith(warc.MAGIC.encode() + b"WARC-Type: re", i)]
    (tmp_path / "gz").mkdir()
    members = [gzip.compress(whole[a:b]) for a, b in zip(start, [*start[1:], len(whole)])]
    (tmp_path / "gz" / "a.warc.gz").write_bytes(b"".join(members))
    got = warc.resolved(warc.read_archives(spark, str(tmp_path / "gz")))
    rows = got.select("page_id", "payload_bytes", "payload_digest", "kind", "refers_to").collect()
    same_rows(rows, expected(PAGES[:8]))
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.warc").write_bytes(whole.replace(b"WARC/1.1", b"WARC/1.0"))
    with pytest.raises(Exception, match="no archive of version 1.1"):
        warc.read_archives(spark, str(tmp_path / "old")).collect()


def test_stated_digests():
    raw = hashlib.sha1(b"x")
    assert warc._sha1(b"sha1:" + raw.hexdigest().encode()) == raw.hexdigest()
    assert warc._sha1(b"SHA1:" + base64.b32encode(raw.digest())) == raw.hexdigest()
    assert [warc._sha1(x) for x in (b"", b"md5:00", b"sha1:zz", b"sha1:" + b"z" * 40)] == [None] * 4


def test_empty_table(spark, tmp_path):
    assert round_trip(spark, [], tmp_path)[0] == []


def test_chain_ends_where_it_breaks(spark, tmp_path):
    """A damaged length: what follows the damage is not trusted."""
    _, path = round_trip(spark, [(i, "u", prose(i, 50)) for i in range(5)], tmp_path)
    whole = b"".join(p.read_bytes() for p in sorted(Path(path).glob("part*")))
    start = [i for i in range(len(whole)) if whole.startswith(warc.MAGIC.encode(), i)]
    folder = tmp_path / "damaged"
    folder.mkdir()
    broken = whole[: start[3]] + whole[start[3] :].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    (folder / "a.warc").write_bytes(broken)
    (folder / "b.warc").write_bytes(b"garbage" + whole)
    got = warc.read_archives(spark, str(folder)).select("offset", "payload_bytes").collect()
    assert sorted(r["offset"] for r in got) == start[:4]
    assert [r["payload_bytes"] for r in got if r["offset"] == start[3]] == [None]


def test_header_parser():
    assert warc.parse_header(b"no header") is None
    assert warc.parse_header(b"Content-Length: 3\r\n\r\nabc") is None  # no type
    assert warc.parse_header(b"WARC-Type: x\r\nContent-Length: -3\r\n\r\nabc") is None
    head, size, fields = warc.parse_header(b"WARC-Type:  x \r\ncontent-length: 3\r\n\r\nabc")
    assert (head, size, fields[b"warc-type"]) == (37, 3, b"x")
