"""Boolean trigram queries that every text with a match of a regular expression satisfies.

The expression is taken apart with the standard library's own parser. For each part are kept the
texts that it can match, if they are few; else what its matches begin and end with, and a query.
Joining two parts adds the trigrams that arise where they meet. A query is `None` (no trigram is
certain: every text is a candidate), a trigram, or ("and" | "or", queries). A-Z is folded, so one
index serves rules with and without case.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser as parser

MOST = 24  # texts kept for a part; with more it counts as unknown
LONGEST = 24  # characters of a kept text

Query = str | tuple | None


def conjunction(*queries: Query) -> Query:
    parts = set()
    for q in queries:
        if q is not None:
            parts |= set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q}
    return _made("and", parts) if parts else None


def disjunction(*queries: Query) -> Query:
    """Any query that is None makes the whole one None."""
    if not queries or None in queries:
        return None
    parts = set()
    for q in queries:
        parts |= set(q[1]) if isinstance(q, tuple) and q[0] == "or" else {q}
    return _made("or", parts)


def _made(kind: str, parts: set) -> Query:
    """Of two parts with the same trigrams the looser one absorbs the other, in both kinds."""
    own = {p: frozenset([p]) if isinstance(p, str) else frozenset(p[1]) for p in parts}
    kept = [p for p in parts if not any(own[q] < own[p] for q in parts)]
    return kept[0] if len(kept) == 1 else (kind, tuple(sorted(kept, key=repr)))


def of_text(text: str) -> Query:
    """The trigrams of one text; None if it has less than three characters."""
    return conjunction(*(text[i : i + 3] for i in range(len(text) - 2)))


def of_texts(texts: frozenset[str]) -> Query:
    return disjunction(*(of_text(t) for t in texts))


ANY = frozenset([""])


@dataclass(frozen=True)
class Part:
    """`exact`: all texts it matches, or None. `starts`, `ends`: every match begins and ends with
    one of these. `query`: what its matches satisfy besides."""

    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query

    @classmethod
    def texts(cls, texts: frozenset[str]) -> Part:
        if len(texts) <= MOST and max(map(len, texts)) <= LONGEST:
            return cls(texts, texts, texts, None)
        return cls.open(texts, texts, of_texts(texts))

    @classmethod
    def open(cls, starts: frozenset[str], ends: frozenset[str], query: Query) -> Part:
        """A part with unknown texts; two characters at an end are enough for the joints."""
        starts, ends = frozenset(t[:2] for t in starts), frozenset(t[-2:] for t in ends)
        return cls(None, starts if len(starts) <= MOST else ANY, ends if len(ends) <= MOST else ANY, query)

    @property
    def known(self) -> Query:
        return self.query if self.exact is None else of_texts(self.exact)

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None:
            if len(self.exact) * len(other.exact) <= MOST:
                return Part.texts(_joined(self.exact, other.exact))
        joint = None
        if len(self.ends) * len(other.starts) <= MOST * MOST:
            joint = of_texts(_joined(self.ends, other.starts))
        starts, ends = self.starts, other.ends
        if self.exact is not None and len(starts) * len(other.starts) <= MOST:
            starts = _joined(starts, other.starts)
        if other.exact is not None and len(self.ends) * len(ends) <= MOST:
            ends = _joined(self.ends, ends)
        return Part.open(starts, ends, conjunction(self.known, other.known, joint))

    def either(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None:
            return Part.texts(self.exact | other.exact)
        return Part.open(
            self.starts | other.starts, self.ends | other.ends, disjunction(self.known, other.known)
        )

    def some(self, least: int, most: int) -> Part:
        """`least` to `most` repetitions."""
        if least == 0:
            if most == 1 and self.exact is not None:
                return Part.texts(self.exact | ANY)
            return UNKNOWN
        out = self
        for _ in range(min(least, 3) - 1):
            out = out.then(self)
        if least == most <= 3:
            return out
        # Any number of copies begins and ends with the copies joined here.
        return Part.open(out.starts, out.ends, out.known)


def _joined(left: frozenset[str], right: frozenset[str]) -> frozenset[str]:
    return frozenset(a + b for a, b in product(left, right))


NOTHING = Part(ANY, ANY, ANY, None)
UNKNOWN = Part(None, ANY, ANY, None)


def _letters(items) -> Part:
    """A character class."""
    found = set()
    for op, value in items:
        if op is K.LITERAL:
            found.add(value)
        elif op is K.RANGE and value[1] - value[0] < MOST:
            found |= set(range(value[0], value[1] + 1))
        else:
            return UNKNOWN
    if not found or max(found) >= 0x80:
        return UNKNOWN
    return Part.texts(frozenset(chr(c).lower() for c in found)) if len(found) <= MOST else UNKNOWN


def _part(op, value) -> Part:
    if op is K.LITERAL:
        return Part.texts(frozenset([chr(value).lower()])) if value < 0x80 else UNKNOWN
    if op is K.IN:
        return _letters(value)
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = value
        return _sequence(inner).some(least, most)
    if op is K.SUBPATTERN:
        return _sequence(value[3])
    if op is K.ATOMIC_GROUP:
        return _sequence(value)
    if op is K.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        out = parts[0]
        for part in parts[1:]:
            out = out.either(part)
        return out
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return NOTHING
    return UNKNOWN


def _sequence(items) -> Part:
    out = NOTHING
    for op, value in items:
        out = out.then(_part(op, value))
    return out


def query_of(pattern: bytes) -> Query:
    """The Boolean trigram query of a bytes pattern."""
    return _sequence(parser.parse(pattern)).known


def grams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*(grams_of(q) for q in query[1]))


def holds(query: Query, text: str) -> bool:
    """Does a folded text satisfy the query?"""
    if query is None:
        return True
    if isinstance(query, str):
        return query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])
