"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of `size` consecutive words of every benchmark item (an item of
fewer words is one window). Windows of one length L share a shift table over blocks of two
words: it tells how far the scan may jump because no pattern has the block any nearer to its
end. Where the shift is zero, the bucket of the block (its suffix) is narrowed by the first word
and each pattern left is compared word by word.

Scale: documents are scanned once, where they lie; nothing of them is shuffled or written again. A
Spark job cuts the words of the stated query set into pieces and writes them; they go to the tasks
in groups of about `group_bytes`, of which the driver holds one at a time and cuts no text. Search
tables are built for one block of windows at a time, so a task's memory does not grow with the
benchmark; where there are several blocks, texts of `HELD_BYTES` are gathered for each round of
tables.

Defined results: a null text has no words and is clean; items without a word never match; the
windows of items with a null id hit words but name no item; repeated items count by distinct id;
repeated documents are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rankloom.llm.common import binary, on_safe_names, quoted, table, words
from rankloom.runtime import materialize

WINDOW = 13
BLOCK_WINDOWS = 200_000
GROUP_BYTES = 64 * 1024 * 1024
HELD_BYTES = 8 * 1024 * 1024

Piece = tuple[str | None, bytes]  # item id, words joined by blanks


class WuManber:
    """Word patterns of one length: block shift table, suffix buckets, direct comparison."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
        for pattern, owners in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            bucket = self.buckets.setdefault(pattern[-self.block :], {})
            bucket.setdefault(pattern[0], []).append((list(pattern), owners))

    def scan(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence."""
        length, far, shift, two = self.length, self.far, self.shift.get, self.block == 2
        end, n = length - 1, len(text)
        while end < n:
            block = (text[end - 1], text[end]) if two else (text[end],)
            jump = shift(block, far)
            if jump:
                end += jump
                continue
            start = end - length + 1
            for pattern, owners in self.buckets[block].get(text[start], ()):
                if text[start : end + 1] == pattern:
                    yield start, owners
            end += 1


def windows(item: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if item:
        for start in range(max(1, len(item) - size + 1)):
            yield tuple(item[start : start + size])


def searchers(block: list[Piece], size: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item_id, text in block:
        for window in dict.fromkeys(windows(text.split(), size)):
            owners = by_length.setdefault(len(window), {}).setdefault(window, [])
            owners += [] if item_id is None else [item_id]
    return [WuManber(length, patterns) for length, patterns in by_length.items()]


def cut(item: list[bytes], size: int, most: int) -> Iterator[tuple[list[bytes], int]]:
    """An item in pieces of at most `most` windows each, with their numbers of windows; pieces
    overlap so that each window lies in one of them."""
    for start in range(0, max(1, len(item) - size + 1) if item else 0, most):
        piece = item[start : start + most + size - 1]
        yield piece, max(1, len(piece) - size + 1)


def pieces(items: DataFrame, item_col: str, text_col: str, size: int, most: int) -> DataFrame:
    """item, words, windows: the pieces of all items, cut in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                (item_id, b" ".join(piece), count)
                for item_id, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)))
                for piece, count in cut(words(text), size, most)
            ]
            columns = [list(c) for c in zip(*found)] or [[], [], []]
            types = pa.string(), pa.binary(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item", "words", "windows"]
            )

    asked = items.select(F.col(quoted(item_col)).cast("string"), F.col(quoted(text_col)))
    return asked.mapInArrow(run, "item string, words binary, windows long")


def in_blocks(rows: pa.Table, block_windows: int) -> list[list[Piece]]:
    blocks: list[list[Piece]] = []
    held = block_windows
    for item, text, count in zip(*(rows.column(c).to_pylist() for c in ("item", "words", "windows"))):
        if held + count > block_windows:
            blocks.append([])
            held = 0
        blocks[-1].append((item, text))
        held += count
    return blocks


def sent_groups(found: DataFrame, block_windows: int, group_bytes: int) -> list[Broadcast]:
    """The pieces in broadcast groups of blocks; the driver holds one group at a time."""
    spark = found.sparkSession
    found = materialize(found, "pieces")
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") + 64), F.lit(0))).first()
    groups = min(n, -(-total // group_bytes))
    if groups > 1:
        number = F.pmod(F.xxhash64("item", "words"), F.lit(groups))
        found = found.withColumn("number", number).repartitionByRange("number")
        found = materialize(found.sortWithinPartitions("number"), "groups")
    sent = []
    for number in range(groups):
        rows = (found if groups == 1 else found.filter(F.col("number") == number)).toArrow()
        if rows.num_rows:
            sent.append(spark.sparkContext.broadcast(in_blocks(rows, block_windows)))
    return sent


def opened(sent: Broadcast) -> list[list[Piece]]:
    """A group's blocks; the worker does not keep them, as it would every group in turn."""
    blocks = sent.value
    if getattr(sent, "_path", None) and hasattr(sent, "_value"):
        del sent._value
    return blocks


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def scan_documents(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """`docs` plus `_hit_words` (number of words), `_hit_spans` (word ranges inside occurrences,
    merged, end exclusive) and `_hit_items` (distinct ids of items with an occurrence)."""
    found = pieces(items, item_col, item_text_col, size, block_windows)
    sent = sent_groups(found, block_windows, group_bytes)

    def run(docs: DataFrame, safe: dict[str, str]) -> DataFrame:
        return _scanned(docs, safe[text_col], sent, size)

    return on_safe_names(docs, run)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in rounds of about `limit` bytes."""
    held, n_bytes = [], 0
    for batch in batches:
        held.append(batch)
        n_bytes += batch.nbytes
        if n_bytes >= limit:
            yield held
            held, n_bytes = [], 0
    if held:
        yield held


def _scanned(docs: DataFrame, text_col: str, sent: list[Broadcast], size: int) -> DataFrame:
    schema = docs.select(
        "*",
        F.lit(0).cast("long").alias("_hit_words"),
        F.array().cast("array<struct<s:int,e:int>>").alias("_hit_spans"),
        F.array().cast("array<string>").alias("_hit_items"),
    ).schema
    arrow = to_arrow_schema(schema)
    place, width = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        if len(sent) <= 1:
            blocks = sent[0].value if sent else []
            if len(blocks) <= 1:  # the usual benchmark: its tables are built once a task
                kept = [s for block in blocks for s in searchers(block, size)]

        def tables() -> Iterator[WuManber]:
            if kept is not None:
                yield from kept
                return
            for group in sent:
                for block in opened(group):
                    yield from searchers(block, size)

        for held in _gathered(batches, 0 if kept is not None else HELD_BYTES):
            texts = [[words(t) for t in binary(batch.column(place))] for batch in held]
            spans = [[[] for _ in own] for own in texts]
            found = [[set() for _ in own] for own in texts]
            for searcher in tables():
                for own, own_spans, own_found in zip(texts, spans, found):
                    for row, text in enumerate(own):
                        for start, owners in searcher.scan(text):
                            own_spans[row].append((start, start + searcher.length))
                            own_found[row].update(owners)
            for batch, own, own_spans, own_found in zip(held, texts, spans, found):
                added = (
                    [len(t) for t in own],
                    [[{"s": a, "e": b} for a, b in merged(s)] for s in own_spans],
                    [sorted(f) for f in own_found],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).cast(arrow.field(i).type) for i in range(width)),
                        *(pa.array(c, arrow.field(width + i).type) for i, c in enumerate(added)),
                    ],
                    schema=arrow,
                )

    return docs.mapInArrow(run, schema)


def judged(
    docs: DataFrame, items: DataFrame, share_divisor: int = 20, **options
) -> DataFrame:
    """`scan_documents` plus `_hit_count` and `_contaminated`: at least one hit word, and at
    least one word in `share_divisor` is hit."""
    scanned = scan_documents(docs, items, **options)
    hit = F.aggregate("_hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["e"] - x["s"]))
    return scanned.withColumn("_hit_count", hit).withColumn(
        "_contaminated",
        (F.col("_hit_count") > 0) & (share_divisor * F.col("_hit_count") >= F.col("_hit_words")),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that are not contaminated, columns unchanged."""
    text_col = options.pop("text_col", "text")

    def run(docs: DataFrame, safe: dict[str, str]) -> DataFrame:
        marked = judged(docs, items, text_col=safe[text_col], **options)
        return marked.filter(~F.col("_contaminated")).select(docs.columns)

    return on_safe_names(docs, run)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = judged(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col("_hit_words").alias("n_words"),
        F.col("_hit_count").alias("n_hit"),
        F.size("_hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hit_items", ","), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


OP8_SQL = r"""
WITH item AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS key
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
          FROM item WHERE len(w) > 0)),
doc AS (
    SELECT row_number() OVER () AS row_id, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents),
span AS (
    SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM doc, (SELECT DISTINCT n FROM win)),
occ AS (
    SELECT DISTINCT row_id, i, s.n, item_id
    FROM (SELECT row_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM span) s
    JOIN win USING (n, key)),
hit AS (
    SELECT row_id, count(DISTINCT p) AS n_hit
    FROM (SELECT row_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
own AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
    coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (row_id) LEFT JOIN own USING (row_id)
"""
