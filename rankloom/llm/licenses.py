"""Licence scan with a positional index of rare words, in DataFrame functions only.

A template is a licence notice as a list of words with one or more mandatory key phrases at fixed
places. The index lists, for every word, the templates that it is a rarest word (highest IDF over
the scanned corpus) of the first key phrase of, with its place there. It lies in buckets by the
CRC-32 of the word: looking up one of a text's words costs the few entries of a bucket, whatever
the number of templates. Every hit votes for a (template, start); a start with a vote of each of
the template's indexed words is one where all of them stand in the right relative position. Every
key phrase must then stand there word by word. The score of a match is the share of the template's
words found at their places.

A key phrase's own words are indexed, so a place of a phrase is never missed whatever the IDF
values are: they decide only how few positions are looked at. The base phrases are templates of
their own. Index and templates are two constants of the plan, which has the same few expressions
for any number of templates. No shuffle but the document frequencies of the licence words (combined
before it, and as many rows as there are licence words); no Python in any task.

Defined results: a null or empty text has no words and no label; positions count words from 0;
texts shorter than a template match on their key phrases, at a lower score.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.vectors import bound
from rankloom.llm.common import UPPER, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 2
PHRASE_SCORE = 0.5

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, notice, mandatory key phrases.
NOTICES = (
    (
        "gpl-3.0",
        "This work is licensed under the GNU General Public License, version 3.",
        ("GNU General Public License, version 3",),
    ),
    (
        "gpl-2.0",
        "This work is licensed under the GNU General Public License, version 2.",
        ("GNU General Public License, version 2",),
    ),
    (
        "gpl-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        (
            "GNU General Public License as published by the Free Software Foundation",
            "either version 3 of the License, or (at your option) any later version",
        ),
    ),
    (
        "gpl-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        (
            "GNU General Public License as published by the Free Software Foundation",
            "either version 2 of the License, or (at your option) any later version",
        ),
    ),
    ("agpl", "Licensed under the GNU Affero General Public License", ("GNU Affero General Public License",)),
    ("lgpl", "Licensed under the GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0",
        ("Apache License, Version 2.0",),
    ),
    (
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        (
            "you may not use this file except in compliance with the License",
            "You may obtain a copy of the License at",
        ),
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("CC BY-NC 4.0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("CC BY-SA 4.0",)),
    (
        "cc-by-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        ("Creative Commons Attribution 4.0 International",),
    ),
    (
        "cc-by-sa-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        ("Creative Commons Attribution-ShareAlike 4.0 International",),
    ),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide.",
        ("copyright and related and neighboring rights", "public domain worldwide"),
    ),
    ("mit", "Released under the MIT License", ("MIT License",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        ("Permission is hereby granted, free of charge", "associated documentation files"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
        (
            "distribute this software for any purpose with or without fee is hereby granted",
            "this permission notice appear in all copies",
        ),
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer.",
        ("Redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software.",
        ("software is provided 'as-is'", "authors be held liable for any damages arising"),
    ),
    (
        "bsl-1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        ("Boost Software License, Version 1.0",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
        "of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License, v. 2.0",),
    ),
    (
        "epl-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0",
        ("Eclipse Public License 2.0",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software", "public domain"),
    ),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]  # place in the template, words
    base: bool = False

    @classmethod
    def of(cls, label: str, notice: str, phrases: Sequence[str], base: bool = False) -> Template:
        words = notice_words(notice)
        found = []
        for phrase in phrases:
            part = notice_words(phrase)
            at = next(i for i in range(len(words)) if words[i : i + len(part)] == part)
            found.append((at, tuple(part)))
        return cls(label, tuple(words), tuple(found), base)

    def anchors(self, idf: dict[str, float], most: int) -> list[tuple[str, int]]:
        """(word, place in the template) of the rarest words of the first key phrase."""
        at, part = self.phrases[0]
        order = sorted(range(len(part)), key=lambda i: (-idf.get(part[i], 0.0), part[i], i))
        return [(part[i], at + i) for i in order[:most]]


def notice_words(notice: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, notice.lower()) if w]


def templates() -> list[Template]:
    base = [Template.of(label, phrase, (phrase,), True) for phrase, label in BASE.items()]
    return base + [Template.of(*notice) for notice in NOTICES]


def text_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased.

    `lower` changes more letters than A-Z, but only two of them into ASCII ones; a text with
    one of those is translated letter by letter.
    """
    odd = text.rlike("[\u0130\u212A]")
    low = F.when(odd, F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, SEPARATORS), "")


def inverse_frequencies(texts: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, float]:
    """IDF of the licence words over all texts; one row per word reaches the driver."""
    words = texts.select(text_words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    wanted = constant(sorted(vocabulary), "array<string>")
    rows = (
        words.select(F.explode(F.array_union(F.array_intersect("words", wanted), F.array(F.lit("")))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    df = {r["word"]: r["count"] for r in rows}
    total = df.pop("", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary}


# What the two constants of the plan hold.
BUCKETS = "array<array<struct<w:string,t:int,place:int>>>"
TEMPLATES = (
    "array<struct<label:string,base:boolean,votes:int,first:int,words:array<string>,"
    "phrases:array<struct<place:int,words:array<string>>>>>"
)
PLACES = "array<struct<label:string,base:boolean,start:bigint,score:double>>"


def constant(value: object, kind: str) -> Column:
    """A nested value as one literal of the optimised plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def postings(chosen: list[list[tuple[str, int]]], size: int) -> list[list[dict]]:
    """(word, template, place) in `size` buckets by the word's CRC-32."""
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for t, found in enumerate(chosen):
        for word, place in found:
            buckets[zlib.crc32(word.encode()) % size].append({"w": word, "t": t, "place": place})
    return buckets


def scan(
    texts: DataFrame,
    text_col: str = "text",
    known: list[Template] | None = None,
    anchors: int = ANCHORS,
) -> DataFrame:
    """`texts` plus `_n_words`, `_places` (one array of label, base, start, score per template
    place, ordered by template and start), the raw material of every report."""
    known = templates() if known is None else known
    vocabulary = sorted({w for t in known for _, part in t.phrases[:1] for w in part})
    idf = inverse_frequencies(texts, text_col, vocabulary)
    chosen = [t.anchors(idf, anchors) for t in known]
    index = sorted({w for found in chosen for w, _ in found})
    size = 2 * len(index) + 1
    buckets = constant(postings(chosen, size), BUCKETS)
    described = constant(
        [
            {
                "label": t.label,
                "base": t.base,
                "votes": len(found),
                "first": t.phrases[0][0],
                "words": t.words,
                "phrases": [{"place": at, "words": part} for at, part in t.phrases],
            }
            for t, found in zip(known, chosen)
        ],
        TEMPLATES,
    )

    def looked_up(word: Column, at: Column) -> Column:
        bucket = F.get(buckets, F.pmod(F.crc32(word.cast("binary")), F.lit(size)).cast("int"))
        own = F.filter(bucket, lambda e: e["w"] == word)
        return F.transform(own, lambda e: F.struct(e["t"].alias("t"), (at - e["place"]).alias("s")))

    def intersected(votes: Column) -> Column:
        """The (template, start) with a vote of each indexed word. A word at a place votes once, so
        in sorted order they are runs as long as the template's number of indexed words."""
        return F.filter(
            votes,
            lambda v, i: (F.get(votes, i + F.get(described, v["t"])["votes"] - 1) == v)
            & ((i == 0) | (F.get(votes, i - 1) != v)),
        )

    def verified(words: Column, start: Column, template: Column) -> Column:
        return F.forall(
            template["phrases"],
            lambda p: (start + p["place"] >= 0)
            & (
                F.slice(words, F.greatest(start + p["place"], F.lit(0)) + 1, F.size(p["words"]))
                == p["words"]
            ),
        )

    def place(words: Column, start: Column, template: Column) -> Column:
        same = F.filter(
            template["words"], lambda w, k: F.coalesce(F.get(words, start + k) == w, F.lit(False))
        )
        share = F.size(same) / F.size(template["words"]).cast("double")
        return F.struct(
            template["label"].alias("label"),
            template["base"].alias("base"),
            (start + F.when(template["base"], template["first"]).otherwise(0)).cast("long").alias("start"),
            F.when(template["base"], F.lit(PHRASE_SCORE)).otherwise(share).alias("score"),
        )

    def places(words: Column) -> Column:
        votes = F.sort_array(F.flatten(F.transform(words, looked_up)))
        agreed = F.filter(
            bound(votes, intersected),
            lambda v: verified(words, v["s"], F.get(described, v["t"])),
        )
        return F.transform(agreed, lambda v: place(words, v["s"], F.get(described, v["t"])))

    worded = texts.withColumn("_words", text_words(F.coalesce(F.col(text_col), F.lit(""))))
    some = F.arrays_overlap("_words", constant(index, "array<string>"))
    return worded.select(
        *texts.columns,
        F.size("_words").cast("long").alias("_n_words"),
        F.when(some, places(F.col("_words"))).otherwise(F.array().cast(PLACES)).alias("_places"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = F.filter("_places", lambda p: p["base"])
    found = scan(docs).select("doc_id", "_n_words", "_places", base.alias("_base"))

    def joined(column: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(column)["label"])), ",")

    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.col("_base")["start"]).alias("first_word"),
        F.array_max(F.col("_base")["start"]).alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("_places").alias("labels"),
        F.coalesce(F.array_max(F.col("_places")["score"]), F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    def places(t: Template) -> str:
        (first, part), rest = t.phrases[0], t.phrases[1:]
        checks = [
            f"(i - {first} + {place} >= 0 AND w[i - {first} + {place} + 1:i - {first} + {place + len(p)}] = {list(p)!r})"
            for place, p in rest
        ]
        start = f"w[i + 1:i + {len(part)}] = {list(part)!r}"
        good = " AND ".join([start, *checks])
        if t.base:
            score = f"{PHRASE_SCORE}::DOUBLE"
        else:
            same = (
                f"len(list_filter(range({len(t.words)}), lambda k: i - {first} + k >= 0 "
                f"AND coalesce(w[i - {first} + k + 1] = {list(t.words)!r}[k + 1], false)))"
            )
            score = f"{same} / {float(len(t.words))}"
        # Words hold no blank, so the first phrase stands in `line` wherever it stands in `w`.
        return (
            f"CASE WHEN contains(line, ' {' '.join(part)} ') THEN "
            f"list_transform(list_filter(range(len(w)), lambda i: {good}), lambda i: "
            f"{{'label': '{t.label}', 'base': {str(t.base).lower()}, 'start': i, 'score': {score}}}) "
            "ELSE [] END"
        )

    every = ",\n        ".join(places(t) for t in templates())
    return rf"""
WITH doc AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{SEPARATORS}'), lambda x: x <> '') AS w
    FROM documents),
place AS (
    SELECT doc_id, len(w) AS n_words, flatten([
        {every}]) AS p
    FROM (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM doc)),
part AS (SELECT *, list_filter(p, lambda x: x.base) AS b FROM place)
SELECT doc_id, n_words::BIGINT AS n_words, len(b)::BIGINT AS n_base,
    list_min(list_transform(b, lambda x: x.start))::BIGINT AS first_word,
    list_max(list_transform(b, lambda x: x.start))::BIGINT AS last_word,
    array_to_string(list_sort(list_distinct(list_transform(b, lambda x: x.label))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS labels,
    coalesce(list_max(list_transform(p, lambda x: x.score)), 0)::DOUBLE AS score
FROM part
"""


OP5_SQL = _sql()
