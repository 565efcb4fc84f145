"""Filter interaction audit as a retracting stream.

Every file of a table is one item of an available-now stream. A micro-batch turns each text into a
hash and a mask of the filters that it fails by itself, looks up its labels and sums equal rows
of a task before anything is dealt by text. State keyed by text holds the smallest id seen and
the rows that have it; the texts of one range of hashes are kept and updated together, because a
call per text costs a hundred times its work. When a smaller id arrives, the rows of the earlier
one become copies: their mask is taken back from the part counters and counted again with the
copy filter's bit. What a
micro-batch changes is summed and written as one small file per batch (a batch that runs again
replaces its own file), so the counters are the sum of these files after every batch, and new
files of the table cost only their own rows.

All orders of the filters are then read off the counters: a part has at most 32 masks x 4 label
combinations, whatever the number of documents.

Scale. Texts are read once and never moved. Two exchanges of short rows per batch: by id for the
labels (null ids are dealt out evenly) and by text for the state. A text that a third of all
documents share is at most one row per part, label combination and `FOLD` rows of a task when it
reaches the state. The number of hash ranges follows from the counted rows of the first run, so
that one holds about `RANGE_ROWS` texts. Where a task's share of the state would be more than
`HEAP_BYTES`, by the same count, it lives in RocksDB on the executors' disks, below that in the
session's own kind of store; both keep every change in the shared folder, so a lost executor
loses nothing.

Defined results: a null text is an empty text; a null part is the empty string; a document has
quality or toxic if any of its label rows says 1; a row without an id fails no copy filter and
makes no other row a copy; repeated rows of the smallest id are not copies of each other, the
rows of any larger id are; a table without rows has no part and so no row. Only the id, text and
part columns are read, whatever other columns are called. Labels count as they are when a
document's batch runs.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankloom.llm.common import binary, blank_free, map_arrow, quoted, table
from rankloom.runtime import fresh_dir, materialize

FILTERS = "ABCDE"
COPY = 16  # the bit of E; A to D have 1, 2, 4, 8
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 200
BATCHES = 4
FOLD = 100_000
RANGE_ROWS = 20_000
TEXT_BYTES = 150  # a text in the state, generously
HEAP_BYTES = 32 * 1024 * 1024

WHO = ["part", "mask", "good", "toxic"]
COUNTERS = "part string, mask int, good boolean, toxic boolean, n long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def own_mask(text: bytes) -> int:
    """The filters A to D that a text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, CONTINUATION))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 3 * points) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def digests(
    docs: DataFrame, ranges: int, id_col: str, text_col: str, part_col: str
) -> DataFrame:
    """id, part, key, range, mask, salt: what the audit needs of a document. Rows without an id
    get a salt, which no label row has, that spreads them over the tasks."""

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [t or b"" for t in binary(batch.column(1))]
        keys = [hashlib.sha256(t).digest() for t in texts]
        return {
            "id": batch.column(0),
            "part": batch.column(2),
            "key": keys,
            "range": [int.from_bytes(k[:4]) % ranges for k in keys],
            "mask": [own_mask(t) for t in texts],
            "salt": [0 if ok else 1 + row for row, ok in enumerate(batch.column(0).is_valid().to_pylist())],
        }

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(
        F.col(quoted(id_col)).alias("id"),
        F.col(quoted(text_col)).alias("text"),
        blank_free(F.col(quoted(part_col)).cast("string")).alias("part"),
    )
    return map_arrow(
        chosen, step, f"id {kind}, part string, key binary, range int, mask int, salt int"
    )


def label_flags(labels: DataFrame, id_col: str) -> DataFrame:
    """label_id, good, toxic, label_salt: one row for every labelled id."""

    def some(column: str) -> Column:
        return F.coalesce(F.max(F.col(column) == 1), F.lit(False))

    known = labels.filter(F.col(quoted(id_col)).isNotNull())
    return known.groupBy(F.col(quoted(id_col)).alias("label_id")).agg(
        some("quality").alias("good"), some("toxic").alias("toxic"), F.lit(0).alias("label_salt")
    )


def folded(rows: DataFrame, id_type: str) -> DataFrame:
    """Rows of a task with the same text, part and labels as one: n of them, the smallest id and
    how many have it. Rows without an id are kept apart."""
    by = ["range", "key", *WHO, "known"]

    def sums(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame = pa.Table.from_batches(found).to_pandas()
        groups = frame.groupby(by, sort=False)["id"]
        frame["least"] = frame["id"] == groups.transform("min")
        out = frame.groupby(by, sort=False).agg(n=("id", "size"), id=("id", "min"), n_id=("least", "sum"))
        return pa.RecordBatch.from_pandas(
            out.reset_index()[[*by, "n", "id", "n_id"]], preserve_index=False
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOLD:
                yield sums(held)
                held, n = [], 0
        if n:
            yield sums(held)

    filled = rows.select(
        "range", "key", *WHO,
        F.col("id").isNotNull().alias("known"),
        F.coalesce("id", F.lit("0").cast(id_type)).alias("id"),
    )
    return filled.mapInArrow(
        run,
        "range int, key binary, part string, mask int, good boolean, toxic boolean, known boolean, "
        f"n long, id {id_type}, n_id long",
    )


def retracted(
    key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Counter changes by the new rows of one range of texts.

    The state is an Arrow table with key, id, part, mask, good, toxic, n: the smallest id of every
    text and how many rows have it, by part and labels."""
    new = pd.concat(list(frames), ignore_index=True)
    held = pa.ipc.open_stream(bytes(state.get[0])).read_pandas() if state.exists else None
    changes = [counted(new[~new["known"]], 0, 1, "n"), counted(new[new["known"]], COPY, 1, "n")]
    new = new[new["known"]]
    least = new.groupby("key")["id"].min()
    if held is not None:
        older = held.groupby("key")["id"].min()
        older = older.loc[older.index.intersection(least.index)]
        lower = older.index[least.loc[older.index].to_numpy() < older.to_numpy()]
        beaten = held["key"].isin(lower)
        changes += [counted(held[beaten], 0, -1, "n"), counted(held[beaten], COPY, 1, "n")]
        held = held[~beaten]
        least = pd.concat([least, older]).groupby(level=0).min()
    first = new[new["id"] == new["key"].map(least)]
    changes += [counted(first, 0, 1, "n_id"), counted(first, COPY, -1, "n_id")]
    if len(first):
        first = first[["key", "id", *WHO, "n_id"]].rename(columns={"n_id": "n"})
        both = first if held is None else pd.concat([held, first], ignore_index=True)
        kept = both.groupby(["key", "id", *WHO], as_index=False, sort=False)["n"].sum()
        table = pa.Table.from_pandas(kept, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    summed = pd.concat(changes).groupby(WHO, as_index=False)["n"].sum()
    yield summed[summed["n"] != 0].astype({"mask": "int32"})


def counted(rows: pd.DataFrame, bits: int, sign: int, n: str) -> pd.DataFrame:
    """part, mask, good, toxic, n: `rows` with `bits` added to their mask, as counter changes."""
    return rows[WHO].assign(mask=rows["mask"] | bits, n=sign * rows[n])


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Session settings for a block."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class FilterAudit:
    """Counters of a growing table of files, kept in one folder of the shared store.

    `update` reads what files have come since the last call; a new object on the same folder
    goes on where the last one ended.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def update(
        self,
        path: str,
        labels: DataFrame,
        batches: int = BATCHES,
        id_col: str = "doc_id",
        text_col: str = "text",
        part_col: str = "lang",
    ) -> FilterAudit:
        """Take in the parquet files of `path` (a folder, a pattern or one file) in about
        `batches` micro-batches, counted over all of its files."""
        known = self.spark.read.parquet(path)
        id_type = known.schema[id_col].dataType.simpleString()
        files = max(1, math.ceil(len(known.inputFiles()) / batches))
        flags = materialize(label_flags(labels, id_col), "labels")
        source = self.spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files)
        # The last letter as a pattern, because a stream takes a folder or a pattern but no file.
        docs = source.parquet(f"{path[:-1]}[{path[-1]}]" if path[-1].isalnum() else path)
        ranges, provider = self._layout(known)
        marked = digests(docs, ranges, id_col, text_col, part_col)
        same_id = (marked["id"] == flags["label_id"]) & (marked["salt"] == flags["label_salt"])
        rows = marked.join(flags, same_id, "left").withColumns(
            {c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}
        )
        changes = (
            folded(rows, id_type)
            .groupBy("range")
            .applyInPandasWithState(
                retracted, COUNTERS, "texts binary", "append", GroupStateTimeout.NoTimeout
            )
        )
        with settings(self.spark, {PROVIDER: provider, CHANGELOG: "true"}):
            changes.writeStream.foreachBatch(self._add).trigger(availableNow=True).option(
                "checkpointLocation", f"{self.folder}/stream"
            ).start().awaitTermination()
        return self

    def _layout(self, known: DataFrame) -> tuple[int, str]:
        """The number of hash ranges and the kind of state store, chosen by the first run for
        its rows and kept."""
        place = f"{self.folder}/layout"
        try:
            return tuple(self.spark.read.parquet(place).first())
        except AnalysisException:
            pass
        rows, partitions = known.count(), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = max(4 * partitions, rows // RANGE_ROWS)
        large = rows * TEXT_BYTES > partitions * HEAP_BYTES
        chosen = ranges, ROCKSDB if large else self.spark.conf.get(PROVIDER)
        layout = self.spark.createDataFrame([chosen], "ranges int, provider string")
        layout.coalesce(1).write.parquet(place)
        return chosen

    def _add(self, changes: DataFrame, batch: int) -> None:
        summed = changes.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
        summed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/counters/batch={batch}")

    def counters(self) -> DataFrame:
        """part, mask, good, toxic, n: documents by the set of filters that they fail."""
        nothing = self.spark.createDataFrame([], COUNTERS)
        nothing.write.mode("overwrite").parquet(f"{self.folder}/counters/batch=-1")
        changes = self.spark.read.schema(COUNTERS).parquet(f"{self.folder}/counters")
        return (
            changes.groupBy("part", "mask", "good", "toxic")
            .agg(F.sum("n").alias("n"))
            .filter("n <> 0")
        )


def orders() -> list[tuple[str, int, str, int, int]]:
    """filter_order, step, filter, its bit, the bits of the filters before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [
        ("".join(order), k + 1, f, bit[f], sum(bit[x] for x in order[:k]))
        for order in itertools.permutations(FILTERS)
        for k, f in enumerate(order)
    ]


def report(counters: DataFrame) -> DataFrame:
    """One row per part, order and step, zeros included."""
    fields = ("filter_order", "step", "filter", "bit", "before")
    steps = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(fields, row))) for row in orders()))
    mask, bit, before, n = (F.col(c) for c in ("mask", "s.bit", "s.before", "n"))
    fails = mask.bitwiseAND(bit) != 0
    earlier = mask.bitwiseAND(before) != 0
    here = fails & ~earlier

    def total(*wanted: Column) -> Column:
        condition = wanted[0]
        for other in wanted[1:]:
            condition = condition & other
        return F.sum(F.when(condition, n).otherwise(0))

    # A filter comes first among the k that a document fails in 120 / k of all orders.
    share = F.when(fails, n * F.floor(F.lit(math.factorial(len(FILTERS))) / F.bit_count(mask)))
    return (
        counters.select("part", "mask", "good", "toxic", "n", F.explode(steps).alias("s"))
        .groupBy("part", "s.filter_order", "s.step")
        .agg(
            total(~fails, ~earlier).alias("kept"),
            total(here).alias("removed"),
            total(fails, earlier).alias("redundant"),
            total(mask == bit).alias("unique_fails"),
            total(here, F.col("good")).alias("good_lost"),
            total(here, F.col("toxic")).alias("toxic_lost"),
            F.sum(F.coalesce(share, F.lit(0))).alias("shapley"),
        )
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = FilterAudit(spark, fresh_dir(spark, "audit"))
    audit.update(f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
    return report(audit.counters())


OP11_SQL = r"""
WITH label AS (
    SELECT doc_id AS label_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
word AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents),
failed AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(w) < 200)::INT
        + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
    FROM word LEFT JOIN label ON doc_id = label_id),
counted AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS n_good,
        count(*) FILTER (WHERE toxic) AS n_toxic
    FROM failed GROUP BY 1, 2),
filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(letter, bit)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
        [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM filters a, filters b, filters c, filters d, filters e
    WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
    SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
    FROM orders, range(1, 6) r(step)),
summed AS (
    SELECT part, filter_order, step, bit,
        sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n_toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM counted, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM summed
"""
