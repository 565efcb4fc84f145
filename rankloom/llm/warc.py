r"""WARC archives: distributed writing with payload dedup, and reading by boundary chains.

Writing. Of pages with equal payloads of at least `min_bytes` bytes the one with the largest id
becomes a `response` record, the others `revisit` records that refer to it. Digests are compared
in a narrow table; payloads meet their decision once, compressed. Archives are written by Spark's
text writer (a record is valid UTF-8, records end with an empty line), so they are splittable
files in the shared folder and survive lost executors.

Reading. Tasks read byte splits cut at the record magic. Every cut is a candidate: its header
gives the offset of its successor. Inside its split a task follows successors and emits, for every
candidate, the first offset beyond the split (its exit). Pointer jumping over these exits, from
each file's start, doubles the distance each round and ends after log2(splits per file) rounds;
then each split walks from its entry and keeps only the candidates on the chain. Magic inside a
payload is never on the chain; the pieces it cut are joined again to the record that holds them.
Payloads are hashed where they are read; only records that were cut are moved.

Defined results: a null payload is empty; a null id is written as such and read back as null;
repeated ids are written once per row; control characters in an address are percent-encoded; a
file that does not start with the magic, or an empty folder, has no records; one of another
version of the format is an error; a chain ends at the first successor that is no candidate, and
what follows it is not trusted. A revisit's digest is the one that its own header states, its
length that of the referred response with this digest, if there is one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import binary, map_arrow, same, table
from rankloom.runtime import materialize, shared_dir

MAGIC = "WARC/1.1\r\n"
DELIMITER = len(MAGIC)
OTHER = b"WARC/"
END = "\r\n\r\n"
MIN_BYTES = 1000
ID = "urn:rankloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


# Writing


def decisions(light: DataFrame, min_bytes: int) -> DataFrame:
    """`light(page_id, digest, n_bytes)` → page_id, digest, refers_to of the revisits."""
    large = light.filter(F.col("n_bytes") >= min_bytes)
    groups = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and refers_to is not null")
        .drop("n")
    )
    again = large.select("page_id", "digest").join(groups, "digest")
    return again.filter(~same(F.col("page_id"), F.col("refers_to"))).distinct()


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str
) -> bytes:
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    kind, extra, block = "response", "", http + payload
    if refers_to is not None:
        kind, block = "revisit", http
        extra = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <{ID}{refers_to}>\r\n"
    address = re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")
    head = (
        f"{MAGIC}WARC-Type: {kind}\r\nWARC-Record-ID: <{ID}{'' if page_id is None else page_id}>\r\n"
        f"WARC-Date: {date}\r\nWARC-Target-URI: {address}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
        f"{extra}Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    ).encode()
    return head + block


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = MIN_BYTES,
    date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write one record per row of `pages` to archives in the new folder `path`."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    kind = dict(pages.dtypes)[id_col]
    light = materialize(
        pages.select(
            F.col(id_col).alias("page_id"),
            F.sha1(text.cast("binary")).alias("digest"),
            F.octet_length(text).cast("long").alias("n_bytes"),
        ),
        "digests",
    )
    revisits = materialize(decisions(light, min_bytes), "revisits")

    def squeeze(batch: pa.RecordBatch) -> dict[str, object]:
        press = zstandard.ZstdCompressor(level=3)
        payloads = [p or b"" for p in binary(batch.column(2))]
        return {
            "page_id": batch.column(0),
            "url": batch.column(1),
            "digest": [hashlib.sha1(p).hexdigest() for p in payloads],
            "packed": [press.compress(p) for p in payloads],
        }

    def build(batch: pa.RecordBatch) -> dict[str, object]:
        open_ = zstandard.ZstdDecompressor()
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)))
        made = [
            record(page_id, url, open_.decompress(packed), digest, refers, date)
            for page_id, url, digest, packed, refers in rows
        ]
        return {"value": pa.array(made, pa.binary()).cast(pa.string())}

    packed = map_arrow(
        pages.select(id_col, url_col, payload_col),
        squeeze,
        f"page_id {kind}, url string, digest string, packed binary",
    )
    joined = packed.alias("p").join(
        revisits.alias("r"),
        (F.col("p.digest") == F.col("r.digest")) & same(F.col("p.page_id"), F.col("r.page_id")),
        "left",
    )
    records = joined.select("p.page_id", "p.url", "p.digest", "p.packed", "r.refers_to")
    map_arrow(records, build, "value string").write.option("lineSep", END).text(path)


# Reading


def parse_header(chunk: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """(header bytes, block bytes, fields) of what follows a magic line; None if no header."""
    end = chunk.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = chunk[: end + 2]
    fields, at = {}, 0
    for m in FIELD.finditer(head):
        if m.start() != at:
            return None
        fields[m[1].lower()] = m[2].strip()
        at = m.end()
    size = fields.get(b"content-length", b"")
    if at != len(head) or not size.isdigit() or b"warc-type" not in fields:
        return None
    return end + 4, int(size), fields


def payload_of(block: bytes, fields: dict[bytes, bytes]) -> bytes:
    """The block without its HTTP header, where it has one."""
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


def _page(value: bytes) -> int | None:
    m = re.fullmatch(rb"<" + ID.encode() + rb"(-?\d+)>", value)
    return int(m[1]) if m else None


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """file, split, value: the bytes after every magic, in file order inside a split."""
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").cast("binary").alias("value"),
        )
    )


FACTS = "kind string, record_id string, page_id long, refers_to long, payload_bytes long, payload_digest string, stated_digest string"


def facts(chunk: bytes, parsed, payload: bytes | None) -> tuple:
    fields = parsed[2]
    return (
        fields[b"warc-type"].decode("utf-8", "replace"),
        fields.get(b"warc-record-id", b"").decode("utf-8", "replace"),
        _page(fields.get(b"warc-record-id", b"")),
        _page(fields.get(b"warc-refers-to", b"")),
        None if payload is None else len(payload),
        None if payload is None else hashlib.sha1(payload).hexdigest(),
        _sha1(fields.get(b"warc-payload-digest", b"")),
    )


def _sha1(value: bytes) -> str | None:
    """A stated SHA-1 in hex; archives write it in hex or in base 32."""
    kind, _, digest = value.partition(b":")
    if kind.lower() != b"sha1":
        return None
    try:
        raw = bytes.fromhex(digest.decode()) if len(digest) == 40 else base64.b32decode(digest.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per cut: file, split, at (offset in the split of the byte after the magic), size,
    next (offset of the successor, null for no header), exit (first offset of its chain beyond
    the split), whole (its block lies in this piece) and, for whole ones, the record's facts."""
    schema = "file string, split long, at long, size long, next long, exit long, whole boolean, " + FACTS
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    arrow = pa.schema([(x.split()[0], types[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        current, at = None, 0

        def close() -> pa.RecordBatch:
            exits: dict[int, int] = {}
            for row in reversed(rows):
                if row[4] is not None:
                    exits[row[2]] = row[5] = exits.get(row[4], row[4])
            # A successor inside the split that is no candidate breaks the chain: it stays as is
            # and finds no partner.
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
            )

        for batch in batches:
            for file, split, chunk in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, split) != current:
                    if rows:
                        yield close()
                    rows, current, at = [], (file, split), 0
                if not split and not at and chunk.startswith(OTHER):
                    raise ValueError(f"{file} is no archive of version 1.1")
                parsed = parse_header(chunk)
                row = [file, split, at, len(chunk), None, None, False, *[None] * 7]
                if parsed:
                    head, size, fields = parsed
                    row[4] = at + head + size + len(END) + DELIMITER
                    row[6] = head + size <= len(chunk)
                    block = chunk[head : head + size] if row[6] else None
                    row[7:] = facts(chunk, parsed, payload_of(block, fields) if row[6] else None)
                rows.append(row)
                at += len(chunk) + DELIMITER
        if rows:
            yield close()

    assert names == arrow.names
    return _scan(spark, path).mapInArrow(run, schema)


def _bases(cuts: DataFrame) -> DataFrame:
    """file, split, base (offset of the split's first piece in the file), until."""
    sums = cuts.groupBy("file", "split").agg(F.sum(F.col("size") + DELIMITER).alias("bytes"))
    order = Window.partitionBy("file").orderBy("split")  # a row per split, not per record
    until = F.sum("bytes").over(order)
    return sums.select("file", "split", (until - F.col("bytes")).alias("base"), until.alias("until"))


def _entries(cuts: DataFrame, bases: DataFrame) -> DataFrame:
    """file, offset: the chain's first record of every split it enters, by pointer jumping."""
    absolute = cuts.join(bases, ["file", "split"])
    start = (F.col("base") + F.col("at")).alias("offset")
    first = absolute.filter((F.col("base") + F.col("at") == 0) & (F.col("size") == 0))
    reached = materialize(first.select("file", F.lit(DELIMITER).cast("long").alias("offset")), "reached")
    hops = absolute.filter("exit is not null").select(
        "file", start, (F.col("base") + F.col("exit")).alias("target")
    )
    targets = hops.select("file", F.col("target").alias("offset")).union(reached).distinct()
    jumps = materialize(hops.join(targets, ["file", "offset"], "left_semi"), "jumps")
    longest = bases.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for round_ in range(max(0, (longest - 1).bit_length())):
        step = reached.join(jumps, ["file", "offset"]).select("file", F.col("target").alias("offset"))
        reached = materialize(reached.union(step).distinct(), "reached")
        if 2 << round_ < longest:
            further = jumps.select("file", F.col("offset").alias("target"), F.col("target").alias("beyond"))
            jumps = materialize(
                jumps.join(further, ["file", "target"]).select(
                    "file", "offset", F.col("beyond").alias("target")
                ),
                "jumps",
            )
    return reached


def _walk(cuts: DataFrame, bases: DataFrame, entries: DataFrame) -> DataFrame:
    """The cuts with `offset` in the file, `on_chain`, and `owner`: the offset of the chain's
    record that holds the piece (null for pieces before the split's entry)."""
    # A row per split and per entry: the split of an entry is the last one that begins before it.
    places = bases.select("file", F.col("base").alias("offset"), F.lit(0).alias("kind"), "split", "base", "until")
    none = F.lit(None).cast("long")
    events = places.unionByName(
        entries.select(
            "file", "offset", F.lit(1).alias("kind"), *(none.alias(c) for c in ("split", "base", "until"))
        )
    )
    upto = Window.partitionBy("file").orderBy("offset", "kind")
    latest = {c: F.last(c, ignorenulls=True).over(upto) for c in ("split", "base", "until")}
    entry = (
        events.withColumns(latest)
        .filter("kind = 1 and offset < until")
        .groupBy("file", "split")
        .agg(F.min(F.col("offset") - F.col("base")).alias("entry"))
    )
    narrow = cuts.select("file", "split", "at", "next").join(entry, ["file", "split"], "left")

    def walk(data: pa.Table) -> pa.Table:
        data = data.sort_by("at")
        at, next_ = data.column("at").to_pylist(), data.column("next").to_pylist()
        wanted, on, owner, last = data.column("entry")[0].as_py(), [], [], None
        for a, n in zip(at, next_):
            hit = wanted is not None and a == wanted and n is not None
            if hit:
                last, wanted = a, n
            on.append(hit)
            owner.append(last)
        return pa.table(
            {
                "file": data.column("file"),
                "split": data.column("split"),
                "at": data.column("at"),
                "on_chain": pa.array(on, pa.bool_()),
                "owner": pa.array(owner, pa.int64()),
            }
        )

    walked = narrow.groupBy("file", "split").applyInArrow(
        walk, "file string, split long, at long, on_chain boolean, owner long"
    )
    return walked.join(bases, ["file", "split"]).select(
        "file",
        "split",
        "at",
        "on_chain",
        (F.col("base") + F.col("owner")).alias("owner"),
        (F.col("base") + F.col("at")).alias("offset"),
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, kind, record_id, page_id, refers_to, payload_bytes, payload_digest of every
    record on a boundary chain; the last two are those of the stored payload."""
    cuts = materialize(candidates(spark, path), "cuts")
    bases = materialize(_bases(cuts), "splits")
    entries = _entries(cuts, bases)
    walked = materialize(_walk(cuts, bases, entries), "chain")
    keys = ["file", "split", "at"]
    chain = cuts.join(walked, keys).filter("on_chain")
    names = [x.split()[0] for x in FACTS.split(", ")]
    start = (F.col("offset") - DELIMITER).alias("offset")
    whole = chain.filter("whole").select("file", start, *names)
    broken = materialize(chain.filter("not whole").select("file", "offset"), "broken")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_mended(spark, path, walked, broken))


def _mended(spark: SparkSession, path: str, walked: DataFrame, broken: DataFrame) -> DataFrame:
    """The records that a magic in their payload, or the end of a split, has cut in pieces."""
    # Pieces at the head of a split belong to the last record begun in an earlier split.
    last = walked.groupBy("file", "split").agg(F.max("owner").alias("last"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    lead = last.select("file", "split", F.last("last", ignorenulls=True).over(before).alias("lead"))
    owned = walked.join(lead, ["file", "split"]).withColumn("owner", F.coalesce("owner", "lead"))
    needed = materialize(
        owned.join(
            broken.withColumnRenamed("offset", "owner"), ["file", "owner"], "left_semi"
        ).select("file", "split", "at", "owner", "offset"),
        "pieces",
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            places = []
            for file, split, size in zip(
                batch.column(0).to_pylist(),
                batch.column(1).to_pylist(),
                pc.binary_length(batch.column(2)).to_pylist(),
            ):
                if (file, split) != current:
                    current, at = (file, split), 0
                places.append(at)
                at += size + DELIMITER
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64())], names=["file", "split", "value", "at"]
            )

    pieces = _scan(spark, path).mapInArrow(number, "file string, split long, value binary, at long")
    groups = (
        pieces.join(needed, ["file", "split", "at"])
        .groupBy("file", "owner")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("pieces"))
        .select("file", "owner", F.col("pieces.value").alias("pieces"))
    )

    def join(batch: pa.RecordBatch) -> dict[str, object]:
        rows = []
        for parts in batch.column(2).to_pylist():
            whole = MAGIC.encode().join(parts)
            head, size, fields = parsed = parse_header(whole)
            block = whole[head : head + size]
            cut_short = len(block) < size
            rows.append(facts(whole, parsed, None if cut_short else payload_of(block, fields)))
        names = [x.split()[0] for x in FACTS.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        return {"file": batch.column(0), "offset": batch.column(1)} | {
            n: list(c) for n, c in zip(names, columns)
        }

    made = map_arrow(groups, join, "file string, offset long, " + FACTS)
    return made.withColumn("offset", F.col("offset") - DELIMITER)


def resolved(records: DataFrame) -> DataFrame:
    """`records` with the payload facts of revisits taken from the response they refer to."""
    records = materialize(records, "records")
    own = ["page_id", "kind", "refers_to", "payload_bytes", "payload_digest"]
    origin = (
        records.filter("kind = 'response' and page_id is not null")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
        .distinct()
    )
    revisits = records.filter("kind = 'revisit'").select(
        "page_id", "kind", "refers_to", F.col("stated_digest").alias("payload_digest")
    )
    found = revisits.join(origin, ["refers_to", "payload_digest"], "left")
    return records.filter("kind <> 'revisit'").select(own).unionByName(found.select(own))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    return resolved(read_archives(spark, path)).select(
        "page_id",
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        "refers_to",
    )


OP4_SQL = r"""
WITH page AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
        sha1(coalesce(html, '')) AS payload_digest
    FROM pages),
origin AS (
    SELECT payload_digest, max(page_id) AS keeper FROM page
    WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, payload_bytes, p.payload_digest,
    CASE WHEN keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> p.page_id THEN keeper END AS refers_to
FROM page p LEFT JOIN origin o
    ON o.payload_digest = p.payload_digest AND payload_bytes >= 1000
"""
