"""Operator 9: personal data.

Regular expressions propose spans, checks (address parts, Luhn, mod-97, digit counts)
confirm them, and words near a span raise or lower its score. The four base kinds
stay whatever their score; spans of further kinds stay where the score reaches
``ACCEPT`` and no base span overlaps them.

Each pattern is anchored so that a failing run of letters or digits is scanned once,
whatever its length, and spans are compared by their order, so that very long texts
with very many spans take time in proportion. Positions are code points, ends exclusive.

Cases: a null text counts as empty and has no spans; an empty table gives an empty
table; equal rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import map_batches, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
#: Where a kind's score starts, and what a good or bad word nearby adds.
START = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.8, "iban": 0.8, "ssn": 0.4, "local_phone": 0.4}
NEAR, LIFT, LOWER, ACCEPT = 40, 0.2, -0.3, 0.6
#: Words that speak for a kind, and words that speak against any.
FOR = {
    "email": "email e-mail mail contact write",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard payment amex",
    "phone": "phone call tel telephone mobile fax contact",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security",
    "local_phone": "phone call tel telephone mobile fax",
}
AGAINST = "version example sample test dummy isbn serial order part"

#: Length of an international bank account number, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match can start only where a run of digits starts, for it would else start earlier.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
WORDS = {k: re.compile(rf"\b(?:{v.replace(' ', '|')})\b") for k, v in FOR.items()}
NOT_WORDS = re.compile(rf"\b(?:{AGAINST.replace(' ', '|')})\b")
ANY = re.compile(r"[0-9@]")
NOT_DIGITS = re.compile(r"[^0-9]+")

Span = tuple[int, int, str, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of an international bank account number without spaces."""
    turned = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Bank account numbers: a run cut to its country's length, or for other countries to the longest end of a word that fits."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 1  # an account may start within a run that is none
        signs = [i for i in range(*m.span()) if text[i] != " "]
        known = IBAN_LENGTHS.get(m[0][:2])
        for n in [known] if known else range(len(signs), 14, -1):
            if n > len(signs):
                continue
            end = signs[n - 1] + 1
            if not re.match("[A-Za-z0-9]", text[end : end + 1]) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", at + 1)


def ip_parts(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in found.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The four base kinds: leftmost, not overlapping within a kind; failing matches dropped."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if ip_parts(m[0])]
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def score(text: str, start: int, end: int, kind: str) -> float:
    """Where the kind starts, moved by the words within NEAR characters of the span."""
    around = (text[max(0, start - NEAR) : start] + "\n" + text[end : end + NEAR]).lower()
    moved = START[kind] + LIFT * bool(WORDS[kind].search(around)) + LOWER * bool(NOT_WORDS.search(around))
    return round(min(1.0, max(0.0, moved)), 3)


def find_spans(text: str) -> list[Span]:
    """All spans with their scores, by start and then kind."""
    if not ANY.search(text):
        return []
    base = base_spans(text)
    more = [(a, b, "iban") for a, b in accounts(text)]
    more += [(m.start(), m.end(), "ssn") for m in SSN.finditer(text) if m[0][:3] not in ("000", "666") and m[0][0] != "9"]
    more += [(m.start(), m.end(), "local_phone") for m in LOCAL_PHONE.finditer(text)]
    found = [(*s, score(text, *s)) for s in base]
    taken = sorted((a, b) for a, b, _ in base)
    starts, upto = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for a, b, kind in more:
        # Of the base spans that start before this one's end, none may end after its start.
        before = bisect_left(starts, b)
        if not (before and upto[before - 1] > a) and (points := score(text, a, b, kind)) >= ACCEPT:
            found.append((a, b, kind, points))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind, _ in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "scores array<double>"
)


def personal_data(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, their digest, and all spans with scores."""

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, list]:
            all_spans = [find_spans(t) for t in texts_of(batch)]
            base = [[s for s in spans if s[2] in BASE] for spans in all_spans]
            return {
                "doc_id": batch.column("doc_id"),
                **{f"n_{k}": [sum(s[2] == k for s in spans) for spans in base] for k in BASE},
                "base_sha256": [hashlib.sha256(joined(s).encode()).hexdigest() for s in base],
                "spans": [joined(s) for s in all_spans],
                "scores": [[s[3] for s in spans] for spans in all_spans],
            }

        return work

    return map_batches(docs.select("doc_id", "text"), make, SCHEMA)


def redact(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stays."""
    out, done = [], 0
    for a, b, kind, _ in find_spans(text):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = b
    return "".join(out) + text[done:]
