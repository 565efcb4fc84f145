"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters of words
framed by a blank) over the training texts. A document is compared by its own most frequent
n-grams: each is out of place by the distance of its two ranks, or by the profile's length if the
language's profile lacks it; the language with the smallest sum wins, ties go to the first name.

Training counts whole texts of at most `train_docs` documents per language, picked by a hash of
the id (a documented bound); the counts are combined per task, so the shuffle holds one row per
n-gram and task. A profile set has train languages x `size` rows and is the only thing broadcast.
Prediction is one pass with no shuffle; each document's n-grams are counted over its whole text.

Defined results: `und` with score 0 for a text that is null or has no letter, and for every text
if nothing could be learned; the score is 1 - d/d_max for the smallest distance d; rows with a
null language do not train; repeated rows are predicted alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import binary, map_arrow, on_safe_names, table
from rankloom.runtime import hinted, materialize

SIZE = 300
TRAIN_DOCS = 20_000
BROADCAST_LANGUAGES = 100_000
BROADCAST_IDS = 1_000_000
BITS = np.uint64(21)
LARGEST = 0x110000


def letter_table() -> np.ndarray:
    """Code point → its lower-case letter; 0 for all that is no letter."""
    out = np.zeros(LARGEST, np.uint32)
    for point in range(LARGEST):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def grams(text: bytes | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of all n-grams of 1 to 3 letters; a word's frame counts as a letter.

    A code packs up to three code points; the frame is code point 32.
    """
    empty = np.zeros(0, np.uint64)
    if not text:
        return empty, empty.astype(np.int64)
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    chars = letters[points]
    chars = np.r_[np.uint32(0), chars, np.uint32(0)]
    chars = chars[np.r_[True, (chars[1:] != 0) | (chars[:-1] != 0)]]  # one frame between words
    chars = np.where(chars == 0, np.uint32(32), chars).astype(np.uint64)
    inner = chars != 32
    if not inner.any():
        return empty, empty.astype(np.int64)
    one = chars[inner]
    two = ((chars[:-1] << BITS) | chars[1:])[inner[:-1] | inner[1:]]
    three = ((chars[:-2] << (BITS + BITS)) | (chars[1:-1] << BITS) | chars[2:])[inner[1:-1]]
    return np.unique(np.concatenate([one, two, three]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, ties by code."""
    return codes[np.lexsort((codes, -counts))[:size]]


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    size: int = SIZE,
    train_docs: int = TRAIN_DOCS,
) -> dict[str, list[int]]:
    """Language → its profile, most frequent n-gram first."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    picked = materialize(
        _picked(known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")), train_docs),
        "picked",
    )
    picked = hinted(picked, picked.count() <= BROADCAST_IDS)  # texts stay where they are
    mine = (known[id_col] == picked["id"]) & (known[lang_col] == picked["lang"])
    chosen = known.join(picked, mine, "left_semi").select(lang_col, text_col)
    letters = letter_table()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                held = sums.setdefault(lang, [])
                held.append(grams(text, letters))
                if len(held) >= 64:
                    held[:] = [_summed(held)]
        for lang, held in sums.items():
            codes, counts = _summed(held)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(codes), pa.string()),
                    pa.array(codes.astype(np.int64)),
                    pa.array(counts),
                ],
                names=["lang", "code", "n"],
            )

    sums = (
        chosen.mapInArrow(count, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = sums.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "code", "rank").toLocalIterator():
        profiles.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {lang: [code for _, code in sorted(found)] for lang, found in profiles.items()}


def _picked(ids: DataFrame, most: int) -> DataFrame:
    """The `most` documents per language with the smallest hashes.

    Counts per language give a hash threshold that lets about twice as many through; only those
    are ranked, so that a language with most of the rows is no large group.
    """
    counts = materialize(ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    few = hinted(counts, counts.count() <= BROADCAST_LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(2.0 * most + 64) / F.col("n"))
    hashed = ids.withColumn("h", F.xxhash64("id")).join(few, "lang")
    near = hashed.filter(F.col("h").cast("double") <= F.lit(-(2.0**63)) + share * F.lit(2.0**64))
    place = Window.partitionBy("lang").orderBy("h", "id")
    ranked_ids = near.withColumn("place", F.row_number().over(place))
    return ranked_ids.filter(F.col("place") <= most).select("id", "lang").distinct()


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([n for _, n in held])) if len(codes) else []
    return codes, np.asarray(counts, np.int64)


class RankOrder:
    """Out-of-place distances of a text to every profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.size = size
        self.langs = sorted(profiles)
        self.codes = np.array(sorted({c for p in profiles.values() for c in p}), np.uint64)
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        for row, lang in enumerate(self.langs):
            at = np.searchsorted(self.codes, np.array(profiles[lang], np.uint64))
            self.ranks[row, at] = np.arange(len(at))
        self.letters = letter_table()

    def predict(self, text: bytes | None) -> tuple[str, float]:
        codes, counts = grams(text, self.letters)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at < len(self.codes)] = np.where(
            self.codes[at[at < len(self.codes)]] == own[at < len(self.codes)],
            at[at < len(self.codes)],
            len(self.codes),
        )
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        sums = away.sum(axis=1)
        best = int(np.argmin(sums))
        return self.langs[best], float(1 - sums[best] / (self.size * len(own)))


def predict(
    docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = SIZE
) -> DataFrame:
    """`docs` plus `_lang_pred` and `_lang_score`."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    held: dict[str, RankOrder] = {}

    def run(docs: DataFrame, safe: dict[str, str]) -> DataFrame:
        names, place = docs.columns, docs.columns.index(safe[text_col])
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema]

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            if "model" not in held:
                held["model"] = RankOrder(sent.value, size)
            found = [held["model"].predict(t) for t in binary(batch.column(place))]
            return {n: batch.column(i) for i, n in enumerate(names)} | {
                "_lang_pred": [x for x, _ in found],
                "_lang_score": [y for _, y in found],
            }

        return map_arrow(docs, step, ", ".join([*kinds, "_lang_pred string", "_lang_score double"]))

    return on_safe_names(docs, run)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = train(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), profiles).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_lang_pred").alias("lang_pred"),
        F.col("_lang_score").alias("score"),
    )
