"""Personal data: patterns propose, checksums confirm, context scores.

Base kinds are e-mail and network addresses, payment cards (16 to 19 digits, Luhn) and
international phone numbers. The method adds three kinds that are only believable with a
checksum or with words near by:

* ``iban`` — a country code, two check digits and 11 to 30 characters, mod 97 is 1;
* ``card_short`` — 13 to 15 digits that pass Luhn, with a card word near by;
* ``phone_local`` — 9 to 15 digits in groups without ``+``, with a phone word near by.

Every span has a score: the prior of its kind, raised if its checksum holds and by each kind's
words within ``CONTEXT`` code points before it or after it, lowered by words that tell of test
data. Added spans need ``THRESHOLD``; base spans stay whatever their score. Added spans never
overlap base spans.

Defined results: a null text is empty; texts are scanned whole, in time linear in their length;
repeated rows give repeated results; extra columns are kept, and one named as a result is
replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklens.llm.common import map_columns, quoted, sha256_hex, texts

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "card_short", "phone_local")
KINDS = BASE_KINDS + ADDED_KINDS
CONTEXT = 40
THRESHOLD = 0.6
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "card_short": 0.3, "phone_local": 0.3}
CHECKED = {"card": 0.4, "iban": 0.5, "card_short": 0.2}
NEAR = 0.35
FAR_FROM_REAL = 0.3

#: Words that speak for a kind, in the languages of the corpus, and against any.
WORDS = {
    "email": "email e-mail mail contact write correo courriel kontakt",
    "ip": "ip address host server login client adresse",
    "card": "card visa mastercard amex credit debit tarjeta carte kreditkarte karte pan",
    "phone": "phone tel telephone mobile cell call fax teléfono móvil téléphone telefon handy",
    "iban": "iban account bank konto cuenta compte",
    "card_short": "card visa mastercard amex credit debit tarjeta carte kreditkarte",
    "phone_local": "phone tel telephone mobile cell fax teléfono móvil téléphone telefon handy",
    "against": "example sample test dummy fake version isbn order invoice",
}
_NEAR = {k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, w.split()))})(?!\w)", re.I) for k, w in WORDS.items()}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive repeats and look-behinds change no match: what they skip could never start or end one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: The longest IBAN at each place; shorter ends are tried down to the least length.
_IBAN_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])")
_GROUPS = re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){2,5}(?![\w+-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(double[d] for d in values[1::2])) % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 as used by IBAN: first four characters last, letters as 10 to 35."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``.

    No character of the local part is an ``@``, so a match is an ``@`` with a domain behind it and
    the longest local part before it, down to the end of the match before. Going from the ``@``
    takes linear time where trying every start does not.
    """
    done = at = 0
    while m := _DOMAIN.search(text, at):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Base spans, by kind and place."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of groups from each start that passes mod 97; the scan goes on behind it.

    Words behind an IBAN (a BIC, a currency, a year) look like groups of it, so every end of a
    group is tried. A start has at most 34 characters, so the time stays linear.
    """
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        for end in reversed([e.end() for e in _IBAN_END.finditer(text, m.start() + 4, m.end())]):
            code = text[m.start() : end]
            if len(code.replace(" ", "")) >= 15 and mod97(code):
                yield m.start(), end
                at = end
                break


def additions(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 15 and luhn(digits):
            yield "card_short", *m.span()
    for m in _GROUPS.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield "phone_local", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    around = text[max(0, start - CONTEXT) : start] + "\n" + text[end : end + CONTEXT]
    s = PRIOR[kind] + CHECKED.get(kind, 0.0)
    if _NEAR[kind].search(around):
        s += NEAR
    if _NEAR["against"].search(around):
        s -= FAR_FROM_REAL
    return round(min(1.0, max(0.0, s)), 2)


def scan(text: str) -> list[Span]:
    """All spans, by kind as listed, then by start."""
    base = [Span(k, a, b, score(text, k, a, b)) for k, a, b in proposals(text)]
    ends = list(accumulate((s.end for s in sorted(base, key=lambda s: s.start)), max))
    starts = sorted(s.start for s in base)
    added, free = [], 0
    for k, a, b in sorted(additions(text), key=lambda x: (x[1], KINDS.index(x[0]))):
        before = bisect_left(starts, b)  # the base spans that start before this one ends
        if a < free or (before and ends[before - 1] > a) or (sc := score(text, k, a, b)) < THRESHOLD:
            continue
        added.append(Span(k, a, b, sc))
        free = b
    return base + sorted(added, key=lambda s: (KINDS.index(s.kind), s.start))


SPANS = T.StructType([
    T.StructField(
        "pii",
        T.ArrayType(
            T.StructType([
                T.StructField("kind", T.StringType()),
                T.StructField("start", T.IntegerType()),
                T.StructField("end", T.IntegerType()),
                T.StructField("score", T.DoubleType()),
            ])
        ),
    )
])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with ``pii``: the spans of every text, in code points, end exclusive."""

    def work(columns: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([[s._asdict() for s in scan(t)] for t in texts(columns[0])], _ARROW)]

    return map_columns(df, [quoted(text_col)], df.columns if keep is None else keep, SPANS, work)


def digest(base: list[Span]) -> str:
    return sha256_hex(",".join(f"{s.kind}:{s.start}:{s.end}" for s in base).encode())


def redact(text: str, spans: list[Span], mark: str = "[{}]") -> str:
    """The text with every span replaced by its kind; of overlapping spans the first stands for all."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], mark.format(s.kind.upper())]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def counts(found: DataFrame) -> DataFrame:
    """Adds a count per base kind, digests and the joined spans to the result of ``find``."""
    names = ", ".join(f"'{k}'" for k in BASE_KINDS)
    base = f"filter(pii, s -> s.kind IN ({names}))"
    join = lambda a: f"array_join(transform({a}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.withColumns(
        {f"n_{k}": F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as bigint)") for k in KINDS}
        | {
            "base_sha256": F.sha2(F.expr(join(base)), 256),
            "spans": F.expr(join("pii")),
            "scores": F.expr("array_join(transform(pii, s -> format_number(s.score, 2)), ',')"),
        }
    )
