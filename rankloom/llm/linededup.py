"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of blanks with A-Z lower-cased; keys of at least `min_chars`
code points count. A key held by at least `min_docs` documents is a repeated line: it stays only
in the largest document id that holds it.

`LineIndex` keeps three tables in the shared folder:

* postings(key, doc_id): the exact references, one row per key and document;
* counts(key, n_docs, keeper): the reference counts;
* filters(shard, slots): per shard of the key space a cuckoo filter of the repeated keys.

`insert` and `delete` return a new index; only keys of the given documents are recounted, keys
that become repeated are inserted into their shard's filter and keys that cease to be are deleted
from it, so an insertion followed by the deletion of the same documents restores every decision.
`dedup` sends the postings past the filters first; only the few that hit go on to the exact
counts, which decide, so a filter's false hits change nothing.

Scale: keys are 128-bit hashes; counting combines before the shuffle. Shards are bounded by the
number of keys and streamed past in sorted partitions. A key with more than 1/1024 of all
postings (there are fewer than 1,024 of them) is decided by a broadcast of those keys instead, so
no shard or join meets a hot key. Texts are shuffled once, to meet their dropped keys.

Defined results: a null or empty text is one empty line; repeated rows of one id count as one
document and each row is cleaned; a null id counts as one document below all others; a deletion
of an unknown id changes nothing; inserting a known id adds its new lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import BLANKS, binary, code_points, map_arrow, on_safe_names, same, table
from rankloom.runtime import materialize

MIN_DOCS = 3
MIN_CHARS = 20
SHARD_KEYS = 50_000
HOT_PARTS = 1024
SLOTS = 4
KICKS = 500


class FilterFull(Exception):
    """A key found no place; the shard must be rebuilt with more buckets."""


class CuckooFilter:
    """16-bit fingerprints in buckets of four; empty slots are 0. Keys are 16-byte hashes."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def sized(cls, n_keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.8 < n_keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> CuckooFilter:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    @classmethod
    def build(cls, keys: list[bytes]) -> CuckooFilter:
        made = cls.sized(len(keys))
        while True:
            try:
                made.insert_all(keys)
                return made
            except FilterFull:
                made = cls(np.zeros((2 * len(made.slots), SLOTS), np.uint16))

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket); each bucket follows from the other."""
        halves = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        mask = np.uint64(len(self.slots) - 1)
        prints = (halves[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = (halves[:, 0] >> np.uint64(20)) & mask
        return prints, first.astype(np.int64), (first ^ (self._spread(prints) & mask)).astype(np.int64)

    @staticmethod
    def _spread(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)

    def insert_all(self, keys: list[bytes]) -> None:
        if not keys:
            return
        mask = len(self.slots) - 1
        for fp, a, b in zip(*(x.tolist() for x in self.places(keys))):
            if self._put(a, fp) or self._put(b, fp):
                continue
            at = b
            for kick in range(KICKS):
                slot = kick % SLOTS
                fp, self.slots[at, slot] = int(self.slots[at, slot]), fp
                at ^= int(self._spread(np.array([fp], np.uint16))[0]) & mask
                if self._put(at, fp):
                    break
            else:
                raise FilterFull

    def _put(self, bucket: int, fp: int) -> bool:
        row = self.slots[bucket]
        for slot in range(SLOTS):
            if row[slot] == 0:
                row[slot] = fp
                return True
        return False

    def delete_all(self, keys: list[bytes]) -> None:
        """Every key must be in the filter."""
        if not keys:
            return
        for fp, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for bucket in (a, b):
                at = np.flatnonzero(self.slots[bucket] == fp)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break

    def hits(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        prints, a, b = self.places(keys)
        wanted = prints[:, None]
        return (self.slots[a] == wanted).any(1) | (self.slots[b] == wanted).any(1)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of the stripped, lower-cased line; None for a short one."""
    line = line.strip(BLANKS)
    if len(line) < min_chars or (len(line) < 4 * min_chars and code_points(line) < min_chars):
        return None
    return xxhash.xxh3_128_digest(line.lower())


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """key, doc_id: the distinct keys of every row."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        keys, rows = [], []
        for row, text in enumerate(binary(batch.column(1))):
            found = {line_key(x, min_chars) for x in text.split(b"\n")} - {None} if text else ()
            keys += found
            rows += [row] * len(found)
        return {"key": pa.array(keys, pa.binary()), "doc_id": batch.column(0).take(pa.array(rows, pa.int64()))}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col), step, f"key binary, doc_id {kind}")


def _shard(n_shards: int):
    """A shard holds a range of the key space; n_shards is a power of two."""
    return F.pmod(F.conv(F.substring(F.hex("key"), 1, 7), 16, 10).cast("int"), F.lit(n_shards))


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    n_shards: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS
    shard_keys: int = SHARD_KEYS

    @classmethod
    def build(
        cls,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        min_docs: int = MIN_DOCS,
        min_chars: int = MIN_CHARS,
        shard_keys: int = SHARD_KEYS,
    ) -> LineIndex:
        """The index of `docs`."""
        postings = materialize(
            line_keys(docs, id_col, text_col, min_chars).distinct(), "line-postings"
        )
        counts = materialize(_counted(postings), "line-counts")
        n_shards = shards_for(counts, min_docs, shard_keys)
        filters = materialize(
            _built(counts.filter(F.col("n_docs") >= min_docs), n_shards), "line-filters"
        )
        return cls(postings, counts, filters, n_shards, min_docs, min_chars, shard_keys)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = line_keys(docs, id_col, text_col, self.min_chars).distinct()
        known = self.postings
        fresh = materialize(
            new.join(
                known, (new["key"] == known["key"]) & same(new["doc_id"], known["doc_id"]), "left_anti"
            ),
            "line-postings",
        )
        return self._moved(self.postings.unionByName(fresh), fresh.select("key").distinct())

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        gone = ids.select(F.col(id_col).alias("_gone")).distinct()
        matches = same(self.postings["doc_id"], gone["_gone"])
        touched = self.postings.join(gone, matches, "left_semi").select("key").distinct()
        left = materialize(self.postings.join(gone, matches, "left_anti"), "line-postings")
        return self._moved(left, touched)

    def _moved(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The index after the postings of the `touched` keys have changed."""
        touched = materialize(touched, "line-touched")
        recounted = materialize(
            touched.join(_counted(postings.join(touched, "key", "left_semi")), "key", "left"),
            "line-recounted",
        )
        kept = self.counts.join(touched, "key", "left_anti")
        counts = materialize(
            kept.unionByName(recounted.filter("n_docs is not null")), "line-counts"
        )
        before = F.coalesce(F.col("was"), F.lit(0)) >= self.min_docs
        after = F.coalesce(F.col("n_docs"), F.lit(0)) >= self.min_docs
        changes = (
            recounted.join(self.counts.select("key", F.col("n_docs").alias("was")), "key", "left")
            .filter(before != after)
            .select("key", after.alias("added"))
        )
        filters = materialize(_changed(self.filters, changes, self.n_shards), "line-filters")
        full = filters.filter("slots is null").select("shard").distinct()
        if not full.isEmpty():
            repeated = counts.filter(F.col("n_docs") >= self.min_docs)
            again = _built(
                repeated.withColumn("shard", _shard(self.n_shards))
                .join(full, "shard", "left_semi")
                .drop("shard"),
                self.n_shards,
            )
            filters = materialize(
                filters.filter("slots is not null").unionByName(again), "line-filters"
            )
        return replace(self, postings=postings, counts=counts, filters=filters)

    def drops(self) -> DataFrame:
        """doc_id, keys: the line keys that every document of the index loses."""
        total = self.postings.count()
        repeated = self.counts.filter(F.col("n_docs") >= self.min_docs)
        hot = F.col("n_docs") * HOT_PARTS > total  # fewer than HOT_PARTS keys by this bound
        few = F.broadcast(repeated.filter(hot).select("key", "keeper"))
        lost = ~same(F.col("doc_id"), F.col("keeper"))
        direct = self.postings.join(few, "key").filter(lost).select("doc_id", "key")
        others = self.postings.join(few, "key", "left_anti")
        exact = repeated.filter(~hot).select("key", "keeper")
        checked = probed(others, self.filters, self.n_shards).join(exact, "key").filter(lost)
        return (
            direct.unionByName(checked.select("doc_id", "key"))
            .groupBy("doc_id")
            .agg(F.collect_list("key").alias("keys"))
        )

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`docs` (documents of this index) with the kept text in place of the old one, and
        `_n_lines`, `_n_dropped`."""
        drops = self.drops().withColumnsRenamed({"doc_id": "_drop_id", "keys": "_drop_keys"})

        def run(docs: DataFrame, names: dict[str, str]) -> DataFrame:
            here = same(docs[names[id_col]], drops["_drop_id"])
            joined = docs.join(drops, here, "left").drop("_drop_id")
            return _rewritten(joined, docs.columns, names[text_col], self.min_chars)

        return on_safe_names(docs, run)


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")
    )


def shards_for(counts: DataFrame, min_docs: int, shard_keys: int) -> int:
    """A power of two: shards of at most about `shard_keys` keys, and enough of them to give
    every shuffle partition several."""
    n_keys = counts.filter(F.col("n_docs") >= min_docs).count()
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted, n = max(16 * partitions, n_keys // shard_keys + 1), 1
    while n < wanted:
        n *= 2
    return n


def _built(repeated: DataFrame, n_shards: int) -> DataFrame:
    """shard, slots: a filter for every shard that has a key."""

    def build(shards: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys in _sorted_groups(shards):
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([CuckooFilter.build(keys).dump()], pa.binary())],
                names=["shard", "slots"],
            )

    return (
        repeated.select(_shard(n_shards).alias("shard"), "key")
        .repartition("shard")
        .sortWithinPartitions("shard", "key")
        .mapInArrow(build, "shard int, slots binary")
    )


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    current, keys = None, []
    for batch in batches:
        for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != current:
                if keys:
                    yield current, keys
                current, keys = shard, []
            keys.append(key)
    if keys:
        yield current, keys


def _changed(filters: DataFrame, changes: DataFrame, n_shards: int) -> DataFrame:
    """`filters` after insertions and deletions; a shard that overflows gets null slots."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []

        def close(shard, raw, added, removed):
            made = CuckooFilter.load(raw) if raw is not None else CuckooFilter.sized(len(added))
            try:
                made.delete_all(removed)
                made.insert_all(added)
                done.append((shard, made.dump()))
            except FilterFull:
                done.append((shard, None))

        current, raw, added, removed = None, None, [], []
        for batch in batches:
            for shard, slots, key, plus in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if shard != current:
                    if current is not None:
                        close(current, raw, added, removed)
                    current, raw, added, removed = shard, None, [], []
                if key is None:
                    raw = slots
                else:
                    (added if plus else removed).append(key)
        if current is not None:
            close(current, raw, added, removed)
        for shard, slots in done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([slots], pa.binary())],
                names=["shard", "slots"],
            )

    nothing = F.lit(None)
    state = filters.select(
        "shard",
        F.lit(0).alias("kind"),
        "slots",
        nothing.cast("binary").alias("key"),
        nothing.cast("boolean").alias("added"),
    )
    moves = changes.select(
        _shard(n_shards).alias("shard"),
        F.lit(1).alias("kind"),
        nothing.cast("binary").alias("slots"),
        "key",
        "added",
    )
    return (
        state.unionByName(moves)
        .repartition("shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(apply, "shard int, slots binary")
    )


def probed(postings: DataFrame, filters: DataFrame, n_shards: int) -> DataFrame:
    """The postings whose key is in its shard's filter (with a filter's rare false hits).

    Each partition is sorted so that a shard's filter comes just before its postings; one filter
    is in memory at a time.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist()
            keep = np.zeros(len(shards), bool)
            keys = batch.column(3)
            for a, b in zip(cuts, [*cuts[1:], len(shards)]):
                if shards[a] != current:
                    current, held = shards[a], None
                if batch.column(1)[a].as_py() == 0:
                    held = CuckooFilter.load(batch.column(2)[a].as_py())
                    a += 1
                if held is not None and a < b:
                    keep[a:b] = held.hits(keys.slice(a, b - a).to_pylist())
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [keys.filter(chosen), batch.column(4).filter(chosen)], names=["key", "doc_id"]
            )

    kind = dict(postings.dtypes)["doc_id"]
    state = filters.select(
        "shard",
        F.lit(0).alias("kind"),
        "slots",
        F.lit(None).cast("binary").alias("key"),
        F.lit(None).cast(kind).alias("doc_id"),
    )
    asked = postings.select(
        _shard(n_shards).alias("shard"),
        F.lit(1).alias("kind"),
        F.lit(None).cast("binary").alias("slots"),
        "key",
        "doc_id",
    )
    return (
        state.unionByName(asked)
        .repartition("shard")
        .sortWithinPartitions("shard", "kind")
        .mapInArrow(probe, f"key binary, doc_id {kind}")
    )


def _rewritten(joined: DataFrame, names: list[str], text_col: str, min_chars: int) -> DataFrame:
    place, drop_place = names.index(text_col), len(names)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name in names]

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        lines, dropped, texts = [], [], []
        for text, keys in zip(binary(batch.column(place)), batch.column(drop_place).to_pylist()):
            parts = (text or b"").split(b"\n")
            lines.append(len(parts))
            if keys:
                gone = set(keys)
                kept = [x for x in parts if line_key(x, min_chars) not in gone]
                dropped.append(len(parts) - len(kept))
                texts.append(b"\n".join(kept))
            else:
                dropped.append(0)
                texts.append(text)
        out = {n: batch.column(i) for i, n in enumerate(names)}
        return out | {
            names[place]: pa.array(texts, pa.binary()).cast(pa.string()),
            "_n_lines": lines,
            "_n_dropped": dropped,
        }

    return map_arrow(joined, step, ", ".join([*kinds, "_n_lines long", "_n_dropped long"]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without its repeated lines, columns unchanged."""

    def run(docs: DataFrame, names: dict[str, str]) -> DataFrame:
        index = LineIndex.build(docs, names[id_col], names[text_col], **options)
        return index.dedup(docs, names[id_col], names[text_col]).select(docs.columns)

    return on_safe_names(docs, run)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = LineIndex.build(docs).dedup(docs)
    return cleaned.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


OP2_SQL = r"""
WITH row_text AS (
    SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
    FROM documents),
line AS (
    SELECT row_id, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos
    FROM row_text),
keyed AS (
    SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM line),
repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
    SELECT row_id, k.doc_id, line, pos, r.key IS NOT NULL AND k.doc_id <> keeper AS dropped
    FROM keyed k LEFT JOIN repeated r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
    count(*) FILTER (dropped)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
