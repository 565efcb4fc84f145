"""Best-fit packing into sequences of several permitted lengths.

A document of n tokens becomes pieces of at most the largest length. Pieces are placed in order
of decreasing length, each into the open bin with the least room that still suffices. Where none
does, a bin is opened; its size is the permitted one with the least cost per token, looking ahead
at what the pieces still to come can fill. In the end every bin shrinks to the smallest permitted
length that holds its contents.

The plan is made on the histogram of piece lengths, which has at most max(lengths) rows whatever
the corpus size: equal pieces go to equal bins in runs. Pieces then find their run by their rank
among the pieces of equal length. Ranks come from counts per (length, hash block), so a length
that a third of all pieces share is numbered by many tasks. The plan is exact best fit over the
whole corpus, not over parts of it.

Defined results: a document without tokens (null or empty text) has no piece; repeated rows are
packed each; ties in rank follow (hash block, id, piece).
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import map_arrow, table
from rankloom.llm.tokens import VOCABULARY, encoder, read_ranks
from rankloom.runtime import materialize

LENGTHS = (512, 1024, 2048, 4096, 8192)
BLOCKS = 1024


def sequence_cost(length: int) -> float:
    """Work of a padded sequence: linear layers plus attention, which weighs as much as they
    do at 32,768 tokens."""
    return length * (1 + length / 32_768)


@dataclass(frozen=True)
class Run:
    """Pieces first_rank .. first_rank + count - 1 of one length go to bins first_bin ...,
    per_bin to each, from the same offset on."""

    length: int
    first_rank: int
    count: int
    per_bin: int
    first_bin: int
    offset: int


class _Open:
    """Runs of equal open bins by their room."""

    def __init__(self):
        self.rooms: list[int] = []
        self.groups: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, room: int, first: int, count: int, size: int) -> None:
        if room not in self.groups:
            bisect.insort(self.rooms, room)
            self.groups[room] = []
        heapq.heappush(self.groups[room], (size, first, count))

    def tightest(self, length: int) -> int | None:
        at = bisect.bisect_left(self.rooms, length)
        return self.rooms[at] if at < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, int, int]:
        """Of bins with equal room, those of the smallest size go first."""
        size, first, count = heapq.heappop(self.groups[room])
        used = min(count, most)
        if used < count:
            heapq.heappush(self.groups[room], (size, first + used, count - used))
        if not self.groups[room]:
            del self.groups[room]
            self.rooms.remove(room)
        return first, used, size


def _filled(size: int, length: int, left: dict[int, int], lengths: list[int]) -> int:
    """Tokens that one bin of `size` can take: a piece of `length`, then always the longest
    piece left that fits. `lengths` is sorted and holds the lengths that have pieces left."""
    room, total, taken = size - length, length, {length: 1}
    at = bisect.bisect_right(lengths, room) - 1
    while at >= 0 and room > 0:
        candidate = lengths[at]
        n = min(left[candidate] - taken.get(candidate, 0), room // candidate)
        if n > 0:
            taken[candidate] = taken.get(candidate, 0) + n
            room -= n * candidate
            total += n * candidate
        at = min(at - 1, bisect.bisect_right(lengths, room) - 1)
    return total


def plan(
    histogram: dict[int, int],
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
) -> tuple[list[Run], list[tuple[int, int]]]:
    """Runs, and (first bin, size) of runs of bins of one final size."""
    permitted = sorted(lengths)
    left = {n: c for n, c in histogram.items() if n > 0 and c > 0}
    if left and max(left) > permitted[-1]:
        raise ValueError("a piece is longer than the largest permitted length")
    runs: list[Run] = []
    opened = _Open()
    n_bins, pending = 0, sorted(left)
    for length in sorted(left, reverse=True):
        rank, todo = 0, left[length]
        while todo:
            room = opened.tightest(length)
            if room is None:
                left[length] = todo
                size = min(
                    (s for s in permitted if s >= length),
                    key=lambda s: (cost(s) / _filled(s, length, left, pending), s),
                )
                count = max(1, todo // (size // length))  # bins that these pieces fill
                opened.add(size, n_bins, count, size)
                n_bins += count
                room = size
            # The bin just used is the tightest one: it is filled before the next is begun.
            per_bin = min(todo, room // length)
            first, used, size = opened.take(room, todo // per_bin)
            runs.append(Run(length, rank, used * per_bin, per_bin, first, size - room))
            opened.add(room - per_bin * length, first, used, size)
            rank += used * per_bin
            todo -= used * per_bin
        pending.pop()
    sizes = []
    for room, groups in opened.groups.items():
        for size, first, _ in groups:
            sizes.append((first, permitted[bisect.bisect_left(permitted, size - room)]))
    return runs, sorted(sizes)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY
) -> DataFrame:
    """doc_id, n_tokens of whole texts."""
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    held: dict[str, object] = {}

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        if "encoder" not in held:
            held["encoder"] = encoder(sent.value)
        encode = held["encoder"].encode_ordinary
        counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n_tokens": counts}

    kind = dict(docs.dtypes)[id_col]
    return map_arrow(docs.select(id_col, text_col), step, f"doc_id {kind}, n_tokens long")


def pack(
    counts: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    cost: Callable[[int], float] = sequence_cost,
    id_col: str = "doc_id",
    count_col: str = "n_tokens",
    blocks: int = BLOCKS,
) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset, bin_size: one row per piece."""
    most = max(lengths)
    n = F.col(count_col)
    # Block and row number are fixed in a table, so that reading it again gives the same ranks.
    pieces = (
        counts.filter(n > 0)
        .select(
            F.col(id_col).alias("doc_id"),
            n.alias("total"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / most))).alias("piece"),
        )
        .select(
            "doc_id",
            "piece",
            F.least(F.lit(most), F.col("total") - F.col("piece") * most).cast("int").alias("length"),
            F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int").alias("block"),
        )
    )
    pieces = materialize(pieces, "pieces")
    per_block = materialize(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    histogram = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, sizes = plan(histogram, tuple(lengths), cost)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(
        F.col("length"), F.col("block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "piece")
    placed = pieces.withColumn("row", F.row_number().over(inside) - 1).join(starts, ["length", "block"])
    return _assigned(placed, runs, sizes, most)


def _assigned(placed: DataFrame, runs: list[Run], sizes: list[tuple[int, int]], most: int) -> DataFrame:
    table_ = np.array(
        sorted((r.length, r.first_rank, r.first_bin, r.offset, r.per_bin) for r in runs), np.int64
    ).reshape(-1, 5)
    spans = np.array(sizes, np.int64).reshape(-1, 2)
    sent = placed.sparkSession.sparkContext.broadcast((table_, spans))

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        table_, spans = sent.value
        length, rank = (batch.column(i).to_numpy() for i in (2, 3))
        at = np.zeros(len(length), np.int64)
        for value in np.unique(length):
            low, high = np.searchsorted(table_[:, 0], [value, value + 1])
            mine = length == value
            at[mine] = low + np.searchsorted(table_[low:high, 1], rank[mine], side="right") - 1
        turn, place = np.divmod(rank - table_[at, 1], table_[at, 4])
        bins = table_[at, 2] + turn
        size = spans[np.searchsorted(spans[:, 0], bins, side="right") - 1, 1]
        return {
            "doc_id": batch.column(0),
            "piece": batch.column(1),
            "first_token": batch.column(1).to_numpy() * most,
            "n_tokens": length,
            "bin_id": bins,
            "bin_offset": table_[at, 3] + place * length,
            "bin_size": size,
        }

    kind = dict(placed.dtypes)["doc_id"]
    ranked = placed.select(
        "doc_id", "piece", F.col("length").cast("long"), (F.col("start") + F.col("row")).alias("rank")
    )
    return map_arrow(
        ranked,
        step,
        f"doc_id {kind}, piece long, first_token long, n_tokens long, bin_id long, "
        "bin_offset long, bin_size long",
    )


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: tuple[int, ...] = LENGTHS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    return pack(token_counts(docs, id_col, text_col, vocabulary), lengths)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
