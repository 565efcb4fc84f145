"""Surrogates for personal data: keyed, type-consistent, distinct and coreferent.

Detection finds e-mail addresses, phone, card, social security and account numbers, IP and MAC
addresses, secrets, and person names. Every entity has a canonical form; all its mentions, in all
documents, get the same surrogate, written in the format of the mention (separators, letter case,
grouping). Card numbers keep their first digit and a valid check digit, account numbers their
country and a valid checksum, phones their country code, addresses their family, names their
gender and script: given names are permuted inside their gender and script, surnames are built
from syllables of their script.

Bounds of detection: phones need a country code, a trunk 0 or one of the grouped national forms;
a number right behind a phone may be taken into it. Shortened IPv6 addresses need five hex digits
(::1 stays) and are not unified with their long form; those with an embedded IPv4 part are not found
as one address. Names are found only after a title of TITLES or as a name of GIVEN with a surname;
other given names, surnames alone and other scripts are not found.

A surrogate is a keyed hash of the canonical form and an attempt number. Collision checks: two
entities that would share one, and an entity whose surrogate is a real entity of the corpus, are
found by grouping and joining the entity table; the smallest entity keeps it, the others try
again with the next attempt number until none is left. So different entities stay different.
Private address blocks and social security numbers are closed spaces that a corpus may fill: one of
which more than a third occurs is permuted as a whole by a keyed circle without fixed points, like
the given names; only there may a surrogate be another real entity. Elsewhere an attempt finds
a free value as long as there is one; `ROUNDS` attempts in a row that place nothing are an error.

Scale: the entity table holds distinct entities, combined before the shuffle; mentions join it by
entity (a skewed join if one entity is everywhere) and are gathered per document, bounded by the
document. Texts move once. Nothing reaches the driver but the number of entities left to place.

Defined results: a null text stays null; repeated rows and ids are treated alike; empty tables
give empty tables; without entities a text is returned unchanged.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import map_arrow, on_safe_names, same, table
from rankloom.runtime import materialize

KEY = b"rankloom-surrogates"
ROUNDS = 64

# Given names by script and gender.
GIVEN = {
    ("latin", "f"): (
        "Alice Anna Barbara Carla Carmen Claire Diana Elena Emily Emma Eva Hannah Helen Ingrid Isabel "
        "Jane Jennifer Julia Karen Laura Linda Lisa Lucia Maria Marie Martha Mary Monika Nina Olivia "
        "Patricia Paula Petra Rosa Ruth Sandra Sarah Sophie Susan Teresa Ursula Victoria"
    ).split(),
    ("latin", "m"): (
        "Adam Albert Alex Andrew Anton Carlos Charles Daniel David Diego Edward Eric Felix Frank George "
        "Hans Henry Hugo James Javier Jean John Jorge Joseph Juan Karl Klaus Louis Luis Manuel Mark "
        "Martin Michael Miguel Oscar Otto Paul Pedro Peter Pierre Richard Robert Stefan Thomas Walter William"
    ).split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Надежда Наталья Ольга Светлана Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Αγγελική Άννα Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος".split(),
}

# Forms of address and the gender they tell.
TITLES = {
    "f": "Mrs Ms Miss Madame Mme Frau Señora Sra Г-жа Κυρία".split(),
    "m": "Mr Mister Monsieur Herr Señor Sr Г-н Κύριος".split(),
    "": "Dr Prof".split(),
}
SYLLABLES = {
    "latin": "ba be do du fa gi ha ka ke la li lo ma mi na ne ni or pe ra ri ro sa se si ta te ti to va vi zo".split(),
    "cyrillic": "ба бе во га ди до жа зо ка ке ла ли ло ма ми на не ни по ра ри ро са се си та те ти то ча ши".split(),
    "greek": "βα γα δε δο ζη θα κα κε λα λι λο μα μι να νε νι πα πε ρα ρι ρο σα σε σι τα τε τι το φα χι".split(),
}
ENDINGS = {"latin": "n", "cyrillic": "н", "greek": "ς"}

GENDER = {t: g for g, found in TITLES.items() for t in found}
KNOWN = {n: (script, g) for (script, g), names in GIVEN.items() for n in names}

CAPITAL = r"[^\W\d_a-zà-öø-ÿа-яα-ω]"
NAME = rf"{CAPITAL}[^\W\d_]+(?:-{CAPITAL}[^\W\d_]+)?"
HEX_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
# International numbers (without and with an area code in brackets) and trunk numbers that are no
# dates; their groups may have any width, 8 to 15 digits in total.
PHONES = "|".join(
    (
        r"(?<![\w.])\+\d(?:[ ./-]?\d){7,14}(?!\w)",
        r"(?<![\w.])\+\d{1,3}[ ./-]?\(\d{1,4}\)(?:[ ./-]?\d){6,10}(?!\w)",
        r"(?<![\w.+/:-])(?!\d\d([./-])\d\d\1\d\d(?:\d\d)?(?!\d|\1\d))(?=0\d{1,4}[ ./-]\d)00?[1-9](?:[ ./-]?\d){6,13}(?!\w)",
        r"(?<![\w.])\(0[1-9]\d{0,3}\)(?:[ ./-]?\d){6,10}(?!\w)",
    )
)
KEPT = re.compile(r"\+\d{1,3}(?=[ .(/-])|\+\d|\(?00?[1-9]")
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.U), "@"),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?\b"), "digit"),
    ("mac", re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"), "digit"),
    ("ipv6", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"), "digit"),
    ("ipv6", re.compile(rf"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?=(?::*[0-9A-Fa-f]){{5}})(?:{HEX_GROUPS})?::(?:{HEX_GROUPS})?(?![\w:])"), "digit"),
    ("secret", re.compile(r"\b(?=[0-9A-Za-z]*\d)(?=[0-9A-Za-z]*[A-Za-z])[0-9A-Za-z]{32,}\b"), "digit"),
    ("card", re.compile(r"(?<![\w.-])(?!(?:(?<=\+)|(?=00[1-9]\d{0,2}[ -]))\d(?:[ -]?\d){12,14}(?![ -]?\d))\d(?:[ -]?\d){12,18}(?![\w-])"), "digit"),
    ("ipv4", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), "digit"),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), "digit"),
    (
        "phone",
        re.compile(PHONES + r"|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3}[ .-]?\d{2,4}(?:[ .-]?\d{2})?(?![\w-])|(?<![\w.])\+\d{9,14}(?!\w)"),
        "digit",
    ),
)
TITLED = re.compile(rf"(?<!\w)({'|'.join(GENDER)})(?:\. ?| )({NAME})(?: ({NAME}))?")
GIVEN_FIRST = re.compile(rf"(?<!\w)({'|'.join(KNOWN)}) ({NAME})")
NAMED = re.compile(rf"(?<!\w)(?:{'|'.join([*GENDER, *KNOWN])})(?![^\W_])")

Mention = tuple[int, int, str, str]  # start, stop, kind, canonical form


def script_of(name: str) -> str:
    point = ord(name[0])
    return "cyrillic" if 0x400 <= point < 0x530 else "greek" if 0x370 <= point < 0x400 else "latin"


def canonical(kind: str, text: str) -> str:
    if kind in ("email", "mac", "ipv6"):
        return text.lower().replace("-", ":") if kind == "mac" else text.lower()
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"\D", "", text)
    if kind == "iban":
        return text.replace(" ", "")
    if kind.startswith(("surname", "given")):
        return text.lower()
    return text


def mentions(text: str | None) -> list[Mention]:
    """All entities of a whole text, in order, without overlaps; earlier patterns win."""
    if not text:
        return []
    found: list[Mention] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, stop: int, kind: str) -> None:
        if not _overlaps(taken, start, stop):
            bisect.insort(taken, (start, stop))
            found.append((start, stop, kind, canonical(kind, text[start:stop])))

    digits = any(c in text for c in "0123456789")
    for kind, pattern, trigger in PATTERNS:
        if (trigger == "@" and "@" in text) or (trigger == "digit" and digits):
            for start, stop in [m.span() for m in pattern.finditer(text)]:
                if kind != "iban" or valid_iban(text[start:stop]):
                    add(start, stop, kind)
    if NAMED.search(text):
        for m in TITLED.finditer(text):
            gender = GENDER[m[1]]
            script = script_of(m[2])
            names = [m.span(2), m.span(3)] if m[3] else [m.span(2)]
            if len(names) == 2 or text[slice(*names[0])] in KNOWN:
                first = text[slice(*names[0])]
                if first in KNOWN:
                    script, known = KNOWN[first]
                    add(*names[0], f"given:{script}:{known}")
                elif len(names) == 2 and gender:
                    add(*names[0], f"given:{script}:{gender}")
            last = names[-1]
            if text[slice(*last)] not in KNOWN:
                add(*last, f"surname:{script_of(text[last[0]])}")
        for m in GIVEN_FIRST.finditer(text):
            script, gender = KNOWN[m[1]]
            if m[2] not in KNOWN:
                add(*m.span(1), f"given:{script}:{gender}")
                add(*m.span(2), f"surname:{script_of(m[2])}")
    return sorted(found)


def _overlaps(spans: list[tuple[int, int]], start: int, stop: int) -> bool:
    at = bisect.bisect_left(spans, (stop, -1))
    return at > 0 and spans[at - 1][1] > start


class Stream:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.key, self.seed, self.turn, self.pool = key, "\0".join(parts).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.blake2b(
                self.seed + self.turn.to_bytes(4, "big"), key=self.key[:64], digest_size=64
            ).digest()
            self.turn += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def like(self, char: str) -> str:
        """A character of the same class."""
        if char.isdigit():
            return "0123456789"[self.below(10)]
        if char.isalpha():
            letter = "abcdefghijklmnopqrstuvwxyz"[self.below(26)]
            return letter.upper() if char.isupper() else letter
        return char


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def valid_iban(mention: str) -> bool:
    form = canonical("iban", mention)
    return 15 <= len(form) <= 34 and iban_check(form[:2], form[4:]) == form[2:4]


def iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def given_order(key: bytes, script: str, gender: str) -> list[str]:
    names = GIVEN[script, gender]
    return sorted(names, key=lambda n: hashlib.blake2b(n.encode(), key=key[:64], digest_size=16).digest())


class Circle:
    """All numbers below n in one keyed circle; `step` leads to the next. A permutation that moves
    every number (n > 1), computed without a table: a Feistel network numbers the places, and values
    beyond n are walked over."""

    TURNS = 6

    def __init__(self, key: bytes, label: str, n: int):
        self.n, self.key, self.label = n, key[:64], label.encode()
        self.width = max(1, ((n - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.width) - 1

    def _mix(self, half: int, turn: int) -> int:
        data = self.label + bytes([0, turn]) + half.to_bytes(16, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=16).digest(), "big") & self.mask

    def place(self, x: int) -> int:
        while True:
            left, right = x >> self.width, x & self.mask
            for turn in range(self.TURNS):
                left, right = right, left ^ self._mix(right, turn)
            x = left << self.width | right
            if x < self.n:
                return x

    def at(self, place: int) -> int:
        while True:
            left, right = place >> self.width, place & self.mask
            for turn in reversed(range(self.TURNS)):
                left, right = right ^ self._mix(left, turn), left
            place = left << self.width | right
            if place < self.n:
                return place

    def step(self, x: int) -> int:
        return self.at((self.place(x) + 1) % self.n)


PLAIN_OCTETS = [str(i) for i in range(256)]
PADDED_OCTETS = [f"0{i}" for i in range(10)]
DIGITS = list("0123456789")
BLOCK = re.compile(r"(?:10|127|192\.168|172\.16)(?=\.)")


def closed_space(kind: str, form: str) -> tuple[str, int] | None:
    """Name and size of the small space whose members an entity's surrogate must come from."""
    if kind == "ssn":
        return f"ssn {len(form)}", 10 ** len(form)
    block = BLOCK.match(form) if kind == "ipv4" else None
    return (f"ipv4 {block[0]}", 256 ** (3 - block[0].count("."))) if block else None


def permuted(key: bytes, kind: str, form: str) -> str:
    """The next form in the keyed circle of a closed space; padded octets stay padded."""
    name, _ = closed_space(kind, form)
    head = name.split(" ")[1].split(".") if kind == "ipv4" else []
    parts = form.split(".")[len(head) :] if kind == "ipv4" else list(form)
    if kind == "ssn":
        sets = [DIGITS] * len(parts)
    else:
        sets = [PADDED_OCTETS if p in PADDED_OCTETS else PLAIN_OCTETS for p in parts]
    number, n = 0, 1
    for part, values in zip(parts, sets):
        number, n = number * len(values) + values.index(part), n * len(values)
    number = Circle(key, f"{name} {[len(v) for v in sets]}", n).step(number)
    out = []
    for values in reversed(sets):
        number, value = divmod(number, len(values))
        out.append(values[value])
    return (".".join if kind == "ipv4" else "".join)([*head, *reversed(out)])


def surrogate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The canonical form of the surrogate."""
    rng = Stream(key, kind, form, str(attempt))
    if kind.startswith("given"):
        _, script, gender = kind.split(":")
        order = given_order(key, script, gender)
        lowered = [n.lower() for n in order]
        if form in lowered and attempt == 0:  # the next in a keyed circle: a permutation without fixed points
            return lowered[(lowered.index(form) + 1) % len(order)]
        return lowered[rng.below(len(order))] + "-" + "".join(
            SYLLABLES[script][rng.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 4)
        )
    if kind.startswith("surname"):
        script = kind.split(":")[1]
        n = max(2, min(4, len(form) // 2)) + attempt // 4
        return "".join(SYLLABLES[script][rng.below(len(SYLLABLES[script]))] for _ in range(n)) + ENDINGS[script]
    if kind == "email":
        local, _, domain = form.partition("@")
        host = Stream(key, "domain", domain, str(attempt // 8))
        *labels, top = domain.split(".")
        return "".join(map(rng.like, local)) + "@" + ".".join(
            ["".join(map(host.like, x)) for x in labels] + [top]
        )
    if kind == "ipv4":
        octets = form.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if form.startswith(("192.168.", "172.16.")) else 0
        return ".".join([*octets[:keep], *(str(1 + rng.below(254)) for _ in octets[keep:])])
    if kind == "ipv6" and "::" in form:  # digits stay digits, so that it still reads as an address
        return "".join("abcdef"[rng.below(6)] if c.isalpha() else rng.like(c) for c in form)
    if kind in ("ipv6", "mac"):
        return "".join("0123456789abcdef"[rng.below(16)] if c != ":" else c for c in form)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", form):
            made = "".join("0123456789abcdef"[rng.below(16)] for _ in form)
            return made.upper() if re.search("[A-F]", form) else made
        return "".join(map(rng.like, form))
    if kind == "iban":
        body = "".join(map(rng.like, form[4:]))
        return form[:2] + iban_check(form[:2], body) + body
    digits = "".join(str(rng.below(10)) for _ in form)
    if kind == "card":
        digits = form[0] + digits[1:]
        if luhn(form):
            digits = next(digits[:-1] + d for d in "0123456789" if luhn(digits[:-1] + d))
    return digits


def dressed(kind: str, mention: str, made: str) -> str:
    """The surrogate's canonical form in the format of the mention."""
    if kind in ("card", "phone", "ssn"):
        stay = KEPT.match(mention) if kind == "phone" else None
        head = mention[: stay.end()] if stay else ""
        rest = iter(made[sum(c.isdigit() for c in head) :])
        return head + "".join(next(rest) if c.isdigit() else c for c in mention[len(head) :])
    if kind == "iban":
        rest = iter(made)
        return "".join(c if c == " " else next(rest) for c in mention)
    if kind == "mac":
        made = made.replace(":", "-") if "-" in mention else made
        return made.upper() if re.search("[A-F]", mention) else made
    if kind == "ipv6":
        return made.upper() if re.search("[A-F]", mention) else made
    if kind == "email":
        return made.upper() if mention.isupper() else made
    if kind.startswith(("given", "surname")):
        return made.upper() if mention.isupper() else "-".join(p.capitalize() for p in made.split("-"))
    return made


def phone_form(mention: str, made: str) -> str:
    """Canonical form of the dressed phone number: its country code stays."""
    return re.sub(r"\D", "", dressed("phone", mention, made))


ENTITY = "kind string, form string"


def detected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, kind, form, code: the distinct entities of every row; `code` is the number of
    leading digits that a phone number keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds, forms, codes = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for start, stop, kind, form in mentions(text):
                    seen.add((kind, form, kept_digits(kind, text[start:stop])))
                for kind, form, code in sorted(seen):
                    rows.append(row)
                    kinds.append(kind)
                    forms.append(form)
                    codes.append(code)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(kinds, pa.string()),
                    pa.array(forms, pa.string()),
                    pa.array(codes, pa.int32()),
                ],
                names=["doc_id", "kind", "form", "code"],
            )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {ENTITY}, code int")


def kept_digits(kind: str, mention: str) -> int:
    if kind != "phone":
        return 0
    stay = KEPT.match(mention)
    return sum(c.isdigit() for c in stay[0]) if stay else 0


def assign(entities: DataFrame, key: bytes = KEY, rounds: int = ROUNDS) -> DataFrame:
    """`entities(kind, form, code)`, distinct by kind and form → kind, form, made."""

    def propose(batch: pa.RecordBatch) -> dict[str, object]:
        rows = zip(*(batch.column(i).to_pylist() for i in range(4)))
        made = []
        for kind, form, code, attempt in rows:
            new = surrogate(key, kind, form, attempt)
            made.append(form[:code] + new[code:] if code else new)
        return {n: batch.column(i) for i, n in enumerate(("kind", "form", "code"))} | {
            "attempt": batch.column(3),
            "made": made,
        }

    entities, settled = _crowded(entities, key)
    pending = entities.withColumn("attempt", F.lit(0))
    taken = entities.select("kind", F.col("form").alias("made"))
    left, idle = entities.count(), 0
    while left and idle < rounds:
        tried = materialize(
            map_arrow(
                pending.select("kind", "form", "code", "attempt"),
                propose,
                f"{ENTITY}, code int, attempt int, made string",
            ),
            "surrogates",
        )
        # A proposal is free unless it is an entity of the corpus or given away already; given
        # names are permuted inside their list, which cannot collide.
        real = taken.filter(~F.col("kind").startswith("given:")).union(settled.select("kind", "made"))
        free = tried.join(real, ["kind", "made"], "left_anti")
        won = free.groupBy("kind", "made").agg(F.min("form").alias("form"))
        won = materialize(won.select("kind", "form", "made"), "settled")
        settled = settled.union(won)
        pending = tried.join(won, ["kind", "form"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        pending = materialize(pending.select("kind", "form", "code", "attempt"), "pending")
        before, left = left, pending.count()
        idle = idle + 1 if left == before else 0
    if left:
        raise RuntimeError("surrogates are still colliding; the space of some kind of entity is exhausted")
    return settled


def _crowded(entities: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """The entities to be placed by attempts, and those of crowded closed spaces with surrogates."""

    def spaces(batch: pa.RecordBatch) -> dict[str, object]:
        found = [closed_space(k, f) for k, f in zip(*(batch.column(i).to_pylist() for i in range(2)))]
        return {n: batch.column(i) for i, n in enumerate(("kind", "form", "code"))} | {
            "space": [x and x[0] for x in found],
            "size": [x and x[1] for x in found],
        }

    def permute(batch: pa.RecordBatch) -> dict[str, object]:
        kinds, forms = (batch.column(i).to_pylist() for i in range(2))
        made = [permuted(key, kind, form) for kind, form in zip(kinds, forms)]
        return {"kind": kinds, "form": forms, "made": made}

    kinds = F.col("kind").isin("ssn", "ipv4")
    placed = map_arrow(
        entities.filter(kinds).select("kind", "form", "code"),
        spaces,
        f"{ENTITY}, code int, space string, size long",
    )
    counts = placed.filter("space IS NOT NULL").groupBy("space", "size").count()
    full = [r["space"] for r in counts.filter("3 * count > size").collect()]  # one row per block
    crowd = F.coalesce(F.col("space").isin(full), F.lit(False))
    made = map_arrow(placed.filter(crowd).select("kind", "form"), permute, f"{ENTITY}, made string")
    rest = placed.filter(~crowd).select("kind", "form", "code")
    rest = entities.filter(~kinds).select("kind", "form", "code").unionByName(rest)
    return materialize(rest, "uncrowded"), materialize(made, "permuted")


def pseudonymize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY
) -> DataFrame:
    """`docs` with surrogates in the texts, and `_n_entities` (mentions replaced) and
    `_entity_kinds` (their sorted distinct kinds)."""
    return on_safe_names(docs, lambda d, names: _replaced(d, names[id_col], names[text_col], key))


def _replaced(docs: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    found = materialize(detected(docs, id_col, text_col), "mentions")
    entities = materialize(
        found.groupBy("kind", "form").agg(F.max("code").alias("code")), "entities"
    )
    made = assign(entities, key)
    per_doc = (
        found.select("doc_id", "kind", "form")
        .distinct()
        .join(made, ["kind", "form"])
        .groupBy(F.col("doc_id").alias("_pii_id"))
        .agg(F.collect_list(F.struct("kind", "form", "made")).alias("_pii"))
    )
    joined = docs.join(per_doc, same(docs[id_col], per_doc["_pii_id"]), "left").drop("_pii_id")
    names, place = docs.columns, docs.columns.index(text_col)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def step(batch: pa.RecordBatch) -> dict[str, object]:
        texts, counts, sorts = [], [], []
        for text, own in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
            here = mentions(text) if own else []
            known = {(e["kind"], e["form"]): e["made"] for e in own or ()}
            parts, at = [], 0
            for start, stop, kind, form in here:
                parts += [text[at:start], dressed(kind, text[start:stop], known[kind, form])]
                at = stop
            texts.append("".join(parts) + text[at:] if here else text)
            counts.append(len(here))
            sorts.append(sorted({kind.split(":")[0] for _, _, kind, _ in here}))
        return {n: batch.column(i) for i, n in enumerate(names)} | {
            text_col: texts,
            "_n_entities": counts,
            "_entity_kinds": sorts,
        }

    return map_arrow(
        joined, step, ", ".join([*kinds, "_n_entities long", "_entity_kinds array<string>"])
    )


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return replaced.select(
        "doc_id",
        "text",
        F.col("_n_entities").alias("n_entities"),
        F.array_join("_entity_kinds", ",").alias("kinds"),
    )
