"""Secret scan with a trigram inverted index.

Every rule is a regular expression; `trigrams` derives from it a Boolean query of trigrams that
any text with a match must satisfy. The index cuts a table's files into segments of 4,096 rows;
per segment and trigram it lists the rows whose folded text holds it. Intersecting and uniting
these lists gives a rule's candidate rows, and only there the expression is run. A rule without
a certain trigram is run on every text.

Scale. The index is one pass over the texts that gives short lists; all lists of a segment meet
in one row of bounded size, whatever the trigrams' frequency, so no posting list grows with the
corpus. Candidates are addresses (file, row) with rule numbers. They are broadcast if their
counted rows are few, so that texts stay where they are read; otherwise they are joined by
address, which is unique, so no key is hot. An address is the place of a row in its file: repeated and
null ids do no harm, and two files with the same 64-bit hash would only add candidates.
A table that is not read from files is written to the shared folder first.

Defined results: a null or empty text has no spans; matches of a rule are leftmost and do not
overlap, matches of different rules may; a match whose measured group is too short is dropped;
repeated rows give repeated results; an empty table gives an empty one. Only the id and text
columns are read, whatever other columns are called. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import trigrams
from rankloom.llm.common import binary, code_points, map_arrow, quoted, table
from rankloom.runtime import BROADCAST_BYTES, hinted, materialize

SEGMENT = 4096
CANDIDATE_BYTES = 128  # an address with its rules in a broadcast table, generously


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters. With `folded` the
    pattern is lower-case and meets letters A-Z in either case. Patterns use the syntax that this
    language and RE2 share, and match ASCII characters only."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    folded: bool = False
    base: bool = False


# The base rules, then further well-known forms.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""",
        least=12,
        group=2,
        folded=True,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=18, base=True),
    # Runs are as long as they can be, so the short ones need not be matched at all.
    Rule("hex", r"[0-9a-f]{16,}", least=16, base=True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("google", r"AIza[0-9A-Za-z_-]+", least=39),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]+", least=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=30),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule(
        "url",
        r"(https?|ftp|postgres(ql)?|mysql|redis|mongodb|amqp)://"
        r"[A-Za-z0-9._~%!$&*+,;=-]+:[A-Za-z0-9._~%!$&*+,;=-]+@",
    ),
)


def addressed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """file, row, id, text; (file, row) is the same in every reading of the table."""
    wanted = [F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")]
    place = [
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ]
    try:
        if "_metadata" not in docs.columns:
            return docs.select(*place, *wanted)
    except AnalysisException:  # not read from files
        pass
    return materialize(docs.select(*wanted), "scanned").select(*place, "id", "text")


@dataclass(frozen=True)
class TrigramIndex:
    """`segments`: file, segment, postings (trigram → sorted rows of the segment)."""

    segments: DataFrame
    grams: frozenset[str]

    @classmethod
    def build(cls, placed: DataFrame, grams: set[str]) -> TrigramIndex:
        """Postings of `grams` (folded) for the texts of `addressed` rows."""
        wanted = [(g, g.encode()) for g in sorted(grams)]

        def step(batch: pa.RecordBatch) -> dict[str, object]:
            found: dict[tuple, list[int]] = {}
            texts = binary(batch.column(2))
            for file, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                if text:
                    low = text.lower()
                    for gram, raw in wanted:
                        if raw in low:
                            found.setdefault((file, row // SEGMENT, gram), []).append(row % SEGMENT)
            places = list(found)
            columns = [list(c) for c in zip(*places)] if places else [[], [], []]
            return dict(zip(("file", "segment", "gram"), columns)) | {"rows": list(found.values())}

        lists = map_arrow(
            placed.select("file", "row", "text"),
            step,
            "file long, segment long, gram string, rows array<int>",
        )
        merged = (
            lists.repartition("file", "segment")
            .groupBy("file", "segment", "gram")
            .agg(F.array_sort(F.flatten(F.collect_list("rows"))).alias("rows"))
        )
        postings = F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("postings")
        segments = merged.groupBy("file", "segment").agg(postings)
        return cls(materialize(segments, "trigrams"), frozenset(grams))

    def rows(self, query: trigrams.Query) -> Column:
        """The rows of a segment that satisfy a query."""
        if isinstance(query, str):
            if query not in self.grams:
                raise ValueError(f"the index has no postings of {query!r}")
            return F.coalesce(F.col("postings")[query], F.array().cast("array<int>"))
        lists = [self.rows(q) for q in query[1]]
        out = lists[0]
        for other in lists[1:]:
            out = F.array_intersect(out, other) if query[0] == "and" else F.array_union(out, other)
        return out

    def candidates(self, queries: dict[int, trigrams.Query]) -> DataFrame:
        """file, row, rules: the rows that satisfy at least one of the numbered queries."""
        schema = "file long, row long, rules array<int>"
        if not queries:
            return self.segments.sparkSession.createDataFrame([], schema)

        def numbered(k: int, query: trigrams.Query) -> Column:
            return F.transform(self.rows(query), lambda at: F.struct(at.alias("at"), F.lit(k).alias("rule")))

        each = F.concat(*(numbered(k, q) for k, q in queries.items()))
        hit = self.segments.select("file", "segment", F.explode(each).alias("hit"))
        row = (F.col("segment") * SEGMENT + F.col("hit.at")).alias("row")
        return hit.groupBy("file", row).agg(F.array_sort(F.collect_list("hit.rule")).alias("rules"))


def scan(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: TrigramIndex | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """id_col, spans (array of start, rule number, kind, end, in this order) for every row.

    `index` may be one built before over the same stored table."""
    queries = {k: trigrams.query_of(r.pattern.encode()) for k, r in enumerate(rules)}
    indexed = {k: q for k, q in queries.items() if q is not None}
    everywhere = [k for k in queries if k not in indexed]
    placed = addressed(docs, id_col, text_col)
    if index is None:
        index = TrigramIndex.build(placed, set().union(*map(trigrams.grams_of, indexed.values())))
    found = materialize(index.candidates(indexed), "candidates")
    small = CANDIDATE_BYTES * found.count() <= limit
    joined = placed.join(hinted(found, small), ["file", "row"], "left")
    compiled = [re.compile(r.pattern.encode()) for r in rules]

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        listed = zip(binary(batch.column(1)), batch.column(2).to_pylist())
        return {id_col: batch.column(0), "spans": [spans(t, sorted({*everywhere, *(k or ())})) for t, k in listed]}

    def spans(text: bytes | None, numbers: list[int]) -> list[dict]:
        if not text:
            return []
        out = []
        for k in numbers:
            rule = rules[k]
            for hit in compiled[k].finditer(text.lower() if rule.folded else text):
                if hit.end(rule.group) - hit.start(rule.group) >= rule.least:
                    start = code_points(text[: hit.start()])
                    out.append((start, k, start + hit.end() - hit.start()))
        return [{"start": a, "rule": k, "kind": rules[k].kind, "end": z} for a, k, z in sorted(out)]

    kind = docs.schema[id_col].dataType.simpleString()
    span = "struct<start:bigint,rule:int,kind:string,end:bigint>"
    return map_arrow(
        joined.select("id", "text", "rules"), step, f"{quoted(id_col)} {kind}, spans array<{span}>"
    )


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in RULES if r.base]

    def of(*names: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*names))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds),
        F.sha2(listed(of(*kinds)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """Matches and the pieces between them alternate, so running lengths give the places."""

    def part(k: int, rule: Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        side = "low" if rule.folded else "t"
        return f"""
    SELECT doc_id, rid, {k} AS rule, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base,
        regexp_extract_all({side}, '{pattern}') AS m,
        list_transform(regexp_extract_all({side}, '{pattern}', {rule.group}), lambda x: length(x) >= {rule.least}) AS ok,
        string_split_regex({side}, '{pattern}') AS p
    FROM doc WHERE regexp_matches({side}, '{pattern}')"""

    every = "\n    UNION ALL".join(part(k, r) for k, r in enumerate(RULES))
    counts = "\n    ".join(
        f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}," for r in RULES if r.base
    )
    return f"""
WITH doc AS (
    SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
    FROM documents),
found AS ({every}),
place AS (
    SELECT rid, rule, kind, base, unnest(range(1, len(m) + 1)) AS i, m, p, ok FROM found),
span AS (
    SELECT rid, rule, kind, base,
        (list_sum(list_transform(p[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
        length(m[i]) AS width
    FROM place WHERE ok[i]),
line AS (SELECT *, kind || ':' || start || ':' || (start + width) AS line FROM span),
summed AS (
    SELECT rid,
    {counts}
    string_agg(line, ',' ORDER BY start, rule) FILTER (WHERE base) AS base_lines,
    string_agg(line, ',' ORDER BY start, rule) AS lines
    FROM line GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
    coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_lines, '')) AS base_sha256,
    coalesce(lines, '') AS spans
FROM doc LEFT JOIN summed USING (rid)
"""


OP12_SQL = _sql()
