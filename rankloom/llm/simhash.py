"""SimHash near-dedup over deletion-variant signatures.

A fingerprint has 64 bits: bit b is set if it is set in over half of the XXH64 hashes of the
text's word shingles. Two fingerprints link if at most `max_bits` bits differ.

Candidate search: the 64 bits are cut into max_bits // 2 + 1 segments. Of two linked
fingerprints at least one segment differs by one bit or none, so both have a deletion variant of
that segment (one bit replaced by a wildcard) in common. Distinct fingerprints are indexed under
all one-wildcard variants, equal keys are joined, and every candidate pair is verified by its
differing bits. Copies share a fingerprint and never meet as pairs.

Buckets of more than `bucket` fingerprints (dense clouds of near copies) are not expanded into
pairs. Their members are linked exactly another way: each is replaced by all 64-bit values at
most max_bits // 2 bits away; two fingerprints link if and only if they share such a value, all
holders of a value link with each other, and there are at most a few dozen of them. Tasks send
at most bucket + 1 rows of a key to the shuffle per chunk, so a hot key stays small.

Defined results: a null or blank text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; repeated rows and repeated ids keep their rows; null
ids take part and get the smallest id of their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import binary, map_arrow, same, table
from rankloom.llm.components import connected_components
from rankloom.runtime import materialize

SEED = 42
BUCKET = 64
CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text."""
    found = text.lower().split() if text else []
    if not found:
        return 0
    size = min(shingle, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * counts > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        values = [fingerprint(t, shingle) for t in binary(batch.column(1))]
        return {"doc_id": batch.column(0), "fp": np.array(values, "<u8").view("<i8")}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col), step, f"doc_id {kind}, fp long")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of max_bits // 2 + 1 nearly equal segments."""
    parts = max_bits // 2 + 1
    cuts = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variant_keys(fps: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """One row per fingerprint, one key per (segment, wildcard bit). The key holds the number
    of that pair and the segment's bits with the wildcard cleared."""
    columns, number = [], 0
    for first, width in parts:
        piece = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            masked = piece & ~np.uint64(1 << bit)
            columns.append(masked | np.uint64(number << 56))
            number += 1
    return np.stack(columns, axis=1)


def _index(batches: Iterator[pa.RecordBatch], parts, bucket: int) -> Iterator[pa.RecordBatch]:
    """(key, fp) rows; members of keys that overflow in this chunk also as (null, fp)."""
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
        for at in range(0, len(whole), CHUNK):
            fps = whole[at : at + CHUNK]
            keys = variant_keys(fps, parts)
            owners = np.repeat(fps, keys.shape[1])
            keys = keys.ravel()
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            counts = np.diff(np.r_[starts, len(keys)])
            inside = np.arange(len(keys)) - np.repeat(starts, counts)
            sent = inside <= bucket
            hot = np.unique(owners[np.repeat(counts > bucket, counts)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(
                        np.r_[keys[sent], np.zeros(len(hot), "<u8")].view("<i8"),
                        mask=np.r_[np.zeros(sent.sum(), bool), np.ones(len(hot), bool)],
                    ),
                    pa.array(np.r_[owners[sent], hot].view("<i8")),
                ],
                names=["key", "fp"],
            )


def _verified(
    keys: np.ndarray, fps: np.ndarray, parts, bucket: int, max_bits: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs of the small buckets and the members of the large ones (keys sorted).

    A pair shares up to 64 keys; it is reported by the first segment and bit that it shares.
    """
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    counts = np.diff(np.r_[starts, len(keys)])
    large = np.repeat(counts > bucket, counts)
    hot, keys, fps = np.unique(fps[large]), keys[~large], fps[~large]
    bit_of = [(first, width, bit) for first, width in parts for bit in range(width)]
    lefts, rights = [], []
    for gap in range(1, bucket):
        at = np.flatnonzero(keys[gap:] == keys[:-gap]) if gap < len(keys) else []
        if not len(at):
            break
        a, b = fps[at], fps[at + gap]
        diff = a ^ b
        near = (np.bitwise_count(diff) <= max_bits) & (diff != 0)
        a, b, diff, number = a[near], b[near], diff[near], (keys[at][near] >> np.uint64(56)).astype(int)
        canonical = np.full(len(a), -1)
        offset = 0
        for first, width in parts:
            piece = (diff >> np.uint64(first)) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(piece)
            low = np.log2(np.maximum(piece, 1).astype(float)).astype(int)
            here = (canonical < 0) & (ones <= 1)
            canonical[here] = offset + np.where(ones == 1, low, 0)[here]
            offset += width
        mine = canonical == number
        lefts.append(a[mine])
        rights.append(b[mine])
    assert len(bit_of) == sum(w for _, w in parts)
    empty = np.zeros(0, "<u8")
    return np.concatenate([empty, *lefts]), np.concatenate([empty, *rights]), hot


def _buckets(batches: Iterator[pa.RecordBatch], parts, bucket: int, max_bits: int):
    """Rows sorted by key → (u, v) verified links, or (u, null) for members of large buckets."""

    def out(keys, fps):
        a, b, hot = _verified(keys, fps, parts, bucket, max_bits)
        mask = np.r_[np.zeros(len(a), bool), np.ones(len(hot), bool)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.r_[a, hot].view("<i8")),
                pa.array(np.r_[b, hot].view("<i8"), mask=mask),
            ],
            names=["u", "v"],
        )

    keys, fps = np.zeros(0, "<u8"), np.zeros(0, "<u8")
    for batch in batches:
        column = batch.column(0)
        marked = column.is_null().to_numpy(zero_copy_only=False)
        own = batch.column(1).to_numpy(zero_copy_only=False).view("<u8")
        if marked.any():
            loose = pa.array(own[marked].view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [loose, pa.nulls(len(loose), pa.int64())], names=["u", "v"]
            )
        more = column.fill_null(0).to_numpy(zero_copy_only=False).view("<u8")[~marked]
        keys, fps = np.r_[keys, more], np.r_[fps, own[~marked]]
        if not len(keys):
            continue
        last = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
        if len(keys) - last > 4 * bucket:  # an open large bucket: its rows can go, but for a few
            stay = len(keys) - bucket - 1
            hot = pa.array(fps[last:stay].view("<i8"))
            yield pa.RecordBatch.from_arrays(
                [hot, pa.nulls(len(hot), pa.int64())], names=["u", "v"]
            )
            done = keys[:last], fps[:last]
            keys, fps = keys[stay:], fps[stay:]
        else:
            done = keys[:last], fps[:last]
            keys, fps = keys[last:], fps[last:]
        if len(done[0]):
            yield out(*done)
    if len(keys):
        yield out(keys, fps)


def near_values(fp: Column, radius: int) -> Column:
    """All 64-bit values at most `radius` bits away."""
    masks = [0]
    for r in range(1, radius + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = np.array(masks, "<u8").view("<i8").tolist()
    return F.transform(F.array(*map(F.lit, signed)), lambda m: fp.bitwiseXOR(m))


def links(fps: DataFrame, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct `fps(fp)` → `u, v`: edges whose components are those of the relation
    "at most max_bits bits differ". Empty in, empty out."""
    if max_bits < 2 or max_bits % 2:
        raise ValueError("max_bits must be an even number of at least 2")
    parts = segments(max_bits)
    index = fps.select("fp").mapInArrow(
        lambda batches: _index(batches, parts, bucket), "key long, fp long"
    )
    # Marked rows have no key; they are dealt out by their own value.
    place = F.coalesce(F.col("key"), F.xxhash64("fp"))
    pairs = materialize(
        index.repartition(place)
        .sortWithinPartitions("key", "fp")
        .mapInArrow(lambda batches: _buckets(batches, parts, bucket, max_bits), "u long, v long"),
        "near",
    )
    hot = pairs.filter("v is null").select(F.col("u").alias("fp")).distinct()
    dense = (
        hot.select("fp", F.explode(near_values(F.col("fp"), max_bits // 2)).alias("z"))
        .groupBy("z")
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("u", F.explode("fps").alias("v"))
        .filter("u <> v")
    )
    return pairs.filter("v is not null").union(dense).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
    bucket: int = BUCKET,
) -> DataFrame:
    """doc_id, fp, component_id (smallest id reachable over links), component_size in rows."""
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(
        marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")),
        "distinct",
    )
    roots = connected_components(links(distinct, max_bits, bucket))
    placed = distinct.join(
        roots.withColumnRenamed("node", "fp"), "fp", "left"
    ).withColumn("root", F.coalesce("root", "fp"))
    named = placed.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("n").alias("component_size")
    )
    classes = placed.select("fp", "root").join(named, "root").drop("root")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "component_size")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """`docs` without all but the smallest id of every component; columns unchanged."""
    found = near_duplicates(docs, id_col, **options)
    kept = (
        found.filter(same(F.col("doc_id"), F.col("component_id")))
        .select(F.col("doc_id").alias("_kept_id"))
        .distinct()
    )
    return docs.join(kept, same(docs[id_col], kept["_kept_id"]), "left_semi")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id", "component_size"
    )
