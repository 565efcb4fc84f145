"""Edit-aware token counting.

A document's text is cut into leaves of about `leaf` characters at places where the pre-tokenizer
always starts a new pre-token: before a single blank character between two others. The counts of
the leaves add up to the count of the text. A binary tree over the leaves holds sums of
characters and tokens, so a leaf is found by its offset, and a count is updated, in logarithmic
time. An edit re-encodes only the leaves it touches, with two characters of context on either
side so that the region's outer cuts stay valid, and adds the differences on the paths above.

State is one row per document (text, trees), built and edited in passes without a shuffle when
the edits lie beside the text; a stored state joins a table of edits by id.

Defined results: a null text counts as empty; edits are given in characters of the old text, are
sorted, and the later one of two that overlap is left out, as is one outside the text; documents
without edits keep their count; repeated rows are counted each.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import map_arrow, table
from rankloom.llm.tokens import VOCABULARY, encoder, read_ranks

LEAF = 512
CONTEXT = 2
# A blank that starts a pre-token whatever stands further left or right.
SAFE = re.compile(r"(?<=\S)\s(?=\S)")

EDIT = "array<struct<start:int,stop:int,text:string>>"
Edit = tuple[int, int, str]
Count = Callable[[str], int]


def cuts(text: str, leaf: int) -> list[int]:
    """Ends of the leaves: the first safe place after every `leaf` characters, and the end."""
    out, at = [], 0
    while len(text) - at > leaf:
        found = SAFE.search(text, at + leaf)
        if not found:
            break
        at = found.start()
        out.append(at)
    return [*out, len(text)]


class CountTree:
    """Sums of characters and tokens over the leaves; node i has children 2i and 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1
        while self.width < len(chars):
            self.width *= 2
        self.leaves = len(chars)
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, values: list[int]) -> list[int]:
        sums = [0] * self.width + values + [0] * (self.width - len(values))
        for i in range(self.width - 1, 0, -1):
            sums[i] = sums[2 * i] + sums[2 * i + 1]
        return sums

    @classmethod
    def build(cls, text: str, count: Count, leaf: int) -> CountTree:
        ends = cuts(text, leaf)
        starts = [0, *ends[:-1]]
        return cls(
            [b - a for a, b in zip(starts, ends)], [count(text[a:b]) for a, b in zip(starts, ends)]
        )

    @classmethod
    def load(cls, chars: list[int], tokens: list[int]) -> CountTree:
        return cls(list(chars), list(tokens))

    def dump(self) -> tuple[list[int], list[int]]:
        part = slice(self.width, self.width + self.leaves)
        return self.chars[part], self.tokens[part]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character at `offset`; the
        last one that is not empty for the end of the text."""
        node, start = 1, 0
        offset = max(0, min(offset, self.chars[1] - 1))
        while node < self.width:
            node *= 2
            if offset - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        last = self.leaves - 1
        if node - self.width > last:  # only where all leaves are empty
            return last, self.chars[1] - self.chars[last + self.width]
        return node - self.width, start

    def add(self, leaf: int, chars: int, tokens: int) -> None:
        """Add differences to a leaf and all sums above it."""
        node = leaf + self.width
        while node:
            self.chars[node] += chars
            self.tokens[node] += tokens
            node //= 2

    def region(self, edit: Edit) -> tuple[int, int]:
        """(first, last) leaf that the edit touches, context included."""
        return self.find(edit[0] - CONTEXT)[0], self.find(edit[1] + CONTEXT)[0]

    def replace(self, text: str, edits: list[Edit], count: Count, leaf: int) -> tuple[str, int]:
        """Apply edits that lie close together; the new text and the characters re-encoded."""
        first, begin = self.find(edits[0][0] - CONTEXT)
        last, last_begin = self.find(edits[-1][1] + CONTEXT)
        end = last_begin + self.chars[last + self.width]
        parts, at = [], begin
        for start, stop, new in edits:
            parts += [text[at:start], new]
            at = stop
        region = "".join(parts) + text[at:end]
        ends = cuts(region, leaf)
        slots = last - first + 1
        if len(ends) > slots:  # the surplus stays in the last slot
            ends = [*ends[: slots - 1], len(region)]
        ends += [len(region)] * (slots - len(ends))
        at = 0
        for slot, upto in enumerate(ends):
            piece, node = region[at:upto], first + slot + self.width
            tokens = count(piece) if piece else 0
            self.add(first + slot, len(piece) - self.chars[node], tokens - self.tokens[node])
            at = upto
        return text[:begin] + region + text[end:], len(region)


def usable(edits: list[Edit], length: int) -> list[Edit]:
    out: list[Edit] = []
    for start, stop, new in sorted(edits):
        if 0 <= start <= stop <= length and (not out or start >= out[-1][1]):
            out.append((start, stop, new or ""))
    return out


def grouped(tree: CountTree, edits: list[Edit]) -> list[list[Edit]]:
    """Edits that share a leaf go together, so that no leaf is encoded twice."""
    out: list[list[Edit]] = []
    upto = -1
    for edit in edits:
        first, last = tree.region(edit)
        if first <= upto:
            out[-1].append(edit)
        else:
            out.append([edit])
        upto = max(upto, last)
    return out


def _counter(raw: bytes) -> Count:
    encode = encoder(raw).encode_ordinary
    return lambda text: len(encode(text))


def build(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf: int = LEAF,
    vocabulary: str = VOCABULARY,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """The state: doc_id, text, leaf_chars, leaf_tokens, n_tokens, and the `extra` columns."""
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    held: dict[str, Count] = {}

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        if "count" not in held:
            held["count"] = _counter(sent.value)
        trees = [CountTree.build(t or "", held["count"], leaf) for t in batch.column(1).to_pylist()]
        rest = {n: batch.column(i + 2) for i, n in enumerate(extra)}
        return rest | {
            "doc_id": batch.column(0),
            "text": batch.column(1),
            "leaf_chars": [t.dump()[0] for t in trees],
            "leaf_tokens": [t.dump()[1] for t in trees],
            "n_tokens": [t.n_tokens for t in trees],
        }

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds[id_col]}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
    return map_arrow(
        docs.select(id_col, text_col, *extra), step, ", ".join([schema, *(f"{n} {kinds[n]}" for n in extra)])
    )


def apply(
    state: DataFrame, edits_col: str = "edits", leaf: int = LEAF, vocabulary: str = VOCABULARY
) -> DataFrame:
    """The state after each row's own edits, with n_before, n_edits and n_reencoded (characters)."""
    sent = state.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    held: dict[str, Count] = {}

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        if "count" not in held:
            held["count"] = _counter(sent.value)
        out = {n: [] for n in ("text", "leaf_chars", "leaf_tokens", "n_tokens", "n_before", "n_edits", "n_reencoded")}
        rows = zip(*(batch.column(i).to_pylist() for i in range(1, 5)))
        for text, chars, tokens, edits in rows:
            tree, new, work = CountTree.load(chars, tokens), text or "", 0
            before = tree.n_tokens
            wanted = usable([(e["start"], e["stop"], e["text"]) for e in edits or ()], len(new))
            # From the end on, so that offsets stay those of the old text.
            for group in reversed(grouped(tree, wanted)):
                new, n = tree.replace(new, group, held["count"], leaf)
                work += n
            chars, tokens = tree.dump()
            for name, value in zip(
                out, (new if wanted else text, chars, tokens, tree.n_tokens, before, len(wanted), work)
            ):
                out[name].append(value)
        return out | {"doc_id": batch.column(0)}

    kind = dict(state.dtypes)["doc_id"]
    return map_arrow(
        state.select("doc_id", "text", "leaf_chars", "leaf_tokens", edits_col),
        step,
        f"doc_id {kind}, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long, "
        "n_before long, n_edits long, n_reencoded long",
    )


# The registered query's edits: cleaning steps found in every whole text.
CLEANING = ((re.compile(r"[#$%&*]{3,}"), ""), (re.compile(r"\d{9,}"), "0"), (re.compile(r" \| "), ", "))


def cleaning_edits(text: str | None) -> list[Edit]:
    found = [(m.start(), m.end(), new) for rule, new in CLEANING for m in rule.finditer(text or "")]
    return usable(found, len(text or ""))


def with_cleaning_edits(docs: DataFrame) -> DataFrame:
    def step(batch: pa.RecordBatch) -> dict[str, object]:
        edits = [
            [{"start": a, "stop": b, "text": t} for a, b, t in cleaning_edits(x)]
            for x in batch.column(1).to_pylist()
        ]
        return {"doc_id": batch.column(0), "text": batch.column(1), "edits": edits}

    kind = dict(docs.dtypes)["doc_id"]
    return map_arrow(docs.select("doc_id", "text"), step, f"doc_id {kind}, text string, edits {EDIT}")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_cleaning_edits(table(spark, sf_dir, "documents"))
    edited = apply(build(docs, extra=("edits",)))
    return edited.select(
        "doc_id",
        "n_before",
        "n_tokens",
        "n_edits",
        "n_reencoded",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
