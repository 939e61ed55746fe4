"""Personal data in texts: patterns propose spans, checksums confirm them, context weighs them.

Four base kinds are found as plain leftmost matches, and a match that fails its
validator is dropped as it stands (``BASE``):

* ``email``: a local part, ``@`` and a domain of two labels or more;
* ``ip``: four numbers joined by dots, each at most 255;
* ``card``: digits with single spaces or hyphens, 14 to 19 of them, that pass Luhn;
* ``phone``: ``+`` and 10 to 15 digits with spaces, dots, hyphens and brackets.

The method adds what plain matching loses or does not know, if its score reaches
``LEAST_SCORE``: card numbers within a longer run of digit groups (Luhn, then the
issuer's prefix or a word nearby), national phone numbers and US social security
numbers (a word nearby), and IBANs (length by country and mod-97, sure by themselves).
Base spans always stay; their scores say how sure they are.

The walk over a text is linear: maximal runs of digits are found once and then cut,
and a local part is read backwards from its ``@``. So a text of any length is read
whole; a task holds one slice of texts (``text.SLICE_BYTES``), or one longer text.
A null text is an empty one and has no spans. Spans count code points, the end
excluded; repeated rows and repeated values are found each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.llm.text import slices

#: The order in which kinds are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
#: An added span is reported from this score on.
LEAST_SCORE = 0.5
#: Characters before and behind a span that are searched for words.
BEFORE, BEHIND = 48, 24

#: Prior score of a confirmed span, and what a word nearby adds or takes.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.7, "iban": 0.9, "ssn": 0.3,
         "card_part": 0.3, "phone_national": 0.3}
WITH_ISSUER, WITH_WORD, AGAINST = 0.3, 0.3, 0.3

#: Words that speak for a kind, in English, German, French and Spanish.
WORDS = {
    "email": "email e-mail mail contact kontakt courriel correo",
    "ip": "ip ipv4 address host server client adresse dirección serveur servidor",
    "card": "card credit debit visa mastercard amex payment karte kreditkarte zahlung carte paiement tarjeta pago",
    "phone": "phone tel telephone call fax mobile cell telefon handy anruf téléphone appelez teléfono llame móvil",
    "iban": "iban account bank konto bankverbindung compte banque cuenta banco",
    "ssn": "ssn social security",
}
#: Words that speak against every kind of number.
OTHERWISE = "version release build isbn issn order invoice sku serial example figure table"

#: Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: Digits joined by single spaces, hyphens or dots: every card and address lies within one such run.
_RUN = re.compile(r"[0-9](?:[ .-]?[0-9])++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]++")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_NOT_DIGIT = re.compile("[^0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|ipv4")
#: Issuers of cards by prefix and number of digits, and the ways digits are grouped on cards.
_ISSUED = re.compile(
    r"4(?:[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}"
    r"|3[47][0-9]{13}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12}|35(?:2[89]|[3-8][0-9])[0-9]{12}"
    r"|3(?:0[0-5]|[68][0-9])[0-9]{11}|62[0-9]{14,17}")
#: Digits per group as card numbers are written.
_LAYOUTS = ((14,), (15,), (16,), (17,), (18,), (19,), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3))

_SPEAK = {kind: frozenset(words.split()) for kind, words in WORDS.items()}
_AGAINST = frozenset(OTHERWISE.split())


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    base: bool
    score: float


# --- validators ------------------------------------------------------------------


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right: every second digit from the right counts twice."""
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces has its country's length and the remainder 1."""
    if IBAN_LENGTH.get(iban[:2]) != len(iban):
        return False
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def social_security(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


# --- spans -----------------------------------------------------------------------


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for domain in _DOMAIN.finditer(text) if "@" in text else ():
        start = at = domain.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = domain.end()
            yield start, last


def _addresses(run: str, base: int) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(run):
        if chain.group().count(".") < 3:
            continue
        parts = list(_GROUP.finditer(run, chain.start(), chain.end()))
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            # a number is at most 255 if it has at most three digits behind its zeros
            if all(len(n) <= 3 and int(n or "0") <= 255 for n in (p.group().lstrip("0") for p in four)):
                yield base + four[0].start(), base + four[-1].end()


def _card_parts(run: str, base: int) -> Iterator[tuple[str, int, int, float]]:
    """Neighbouring groups of a run that are written as a card number and pass Luhn, no group twice."""
    groups = list(_GROUP.finditer(run))
    sizes, k = [len(g.group()) for g in groups], 0
    while k < len(groups):
        step = 1
        for layout in _LAYOUTS:
            n = len(layout)
            if tuple(sizes[k : k + n]) == layout:
                digits = "".join(g.group() for g in groups[k : k + n])
                if luhn(digits):
                    prior = PRIOR["card_part"] + _issued(digits)
                    yield "card", base + groups[k].start(), base + groups[k + n - 1].end(), prior
                    step = n
                    break
        k += step


def _nearby(text: str, start: int, end: int) -> set[str]:
    around = text[max(start - BEFORE, 0) : start] + " " + text[end : end + BEHIND]
    return set(_WORD.findall(around.lower()))


def _score(kind: str, prior: float, text: str, start: int, end: int) -> float:
    words = _nearby(text, start, end)
    score = prior + WITH_WORD * bool(words & _SPEAK[kind]) - AGAINST * bool(words & _AGAINST)
    return round(min(max(score, 0.0), 1.0), 2)


def spans(text: str) -> list[Span]:
    """All spans of a text, by start and then kind as listed."""
    found: list[Span] = []
    more: list[tuple[str, int, int, float]] = []

    def base(kind: str, start: int, end: int, prior: float) -> None:
        found.append(Span(start, KINDS.index(kind), end, True, _score(kind, prior, text, start, end)))

    for start, end in _emails(text):
        base("email", start, end, PRIOR["email"])
    for match in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_NOT_DIGIT.sub("", match.group())) <= 15:
            base("phone", match.start(), match.end(), PRIOR["phone"])
    for match in _RUN.finditer(text):
        run, at, stop = match.group(), match.start(), match.end()
        if text[max(at - 2, 0) : at] in IBAN_LENGTH:
            more += _ibans(text, at - 2)
        if len(run) < 7:
            continue
        for start, end in _addresses(run, at):
            base("ip", start, end, PRIOR["ip"])
        for card in _CARD.finditer(run) if len(run) >= 14 else ():
            digits = _NOT_DIGIT.sub("", card.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                base("card", at + card.start(), at + card.end(), PRIOR["card"] + _issued(digits))
            elif len(digits) > 14:
                more += _card_parts(card.group(), at + card.start())
        for number in _SSN.finditer(text, at, min(stop + 1, len(text))):
            if social_security(number.group()):
                more.append(("ssn", number.start(), number.end(), PRIOR["ssn"]))
        for number in _NATIONAL.finditer(text, max(at - 6, 0), min(stop + 1, len(text))):
            more.append(("phone", number.start(), number.end(), PRIOR["phone_national"]))
    return sorted([*found, *_added(text, found, more)])


def _added(text: str, found: list[Span], more: list[tuple[str, int, int, float]]) -> Iterator[Span]:
    """The further spans that are sure enough and overlap neither a base span nor each other;
    of overlapping ones the first that starts stays."""
    reach, k, base = 0, 0, sorted((s.start, s.end) for s in found)
    for kind, start, end, prior in sorted(more, key=lambda m: (m[1], KINDS.index(m[0]), m[2])):
        while k < len(base) and base[k][0] < end:
            reach, k = max(reach, base[k][1]), k + 1
        if start >= reach:
            score = _score(kind, prior, text, start, end)
            if score >= LEAST_SCORE:
                reach = end
                yield Span(start, KINDS.index(kind), end, False, score)


def _issued(digits: str) -> float:
    return WITH_ISSUER if _ISSUED.fullmatch(digits) else 0.0


def _ibans(text: str, start: int) -> Iterator[tuple[str, int, int, float]]:
    """The IBAN that starts at a place, if there is one."""
    if start and text[start - 1].isalnum():
        return
    match = _IBAN.match(text, start)
    if match:
        run, length = match.group(), IBAN_LENGTH[text[start : start + 2]]
        places = [k for k, c in enumerate(run) if c != " "]
        if len(places) >= length:
            end = places[length - 1] + 1
            whole = len(run) == end or run[end] == " "
            if whole and mod97(run[:end].replace(" ", "")):
                yield "iban", start, start + end, PRIOR["iban"]


# --- columns ---------------------------------------------------------------------

SPAN_TYPE = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"
_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))


def find(text: str | Column) -> Column:
    """The spans of a text column, each with its kind, place, score and whether it is a base one."""
    @F.arrow_udf(SPAN_TYPE)
    def column(texts: pa.Array) -> pa.Array:
        out = []
        for part in slices(texts):
            rows = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "base": s.base, "score": s.score}
                     for s in spans(t)] for t in part.to_pylist()]
            out.append(pa.array(rows, _SPANS))
        return pa.concat_arrays(out) if out else pa.array([], _SPANS)
    return column(text)


def masked(text: str) -> str:
    """A text with each span replaced by its kind in angle brackets; overlapping spans are one."""
    out, at = [], 0
    for span in spans(text):
        if span.start >= at:
            out += [text[at : span.start], f"<{KINDS[span.kind]}>"]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def mask(text: str | Column) -> Column:
    """A text column without its personal data. Null stays null."""
    @F.arrow_udf("string")
    def column(texts: pa.Array) -> pa.Array:
        out = [masked(t) for part in slices(texts) for t in part.to_pylist()]
        return pa.array([t if valid else None for t, valid in zip(out, texts.is_valid().to_pylist())], pa.string())
    return column(text)


def digests(docs: DataFrame, text: str = "text", name: str = "_pii") -> DataFrame:
    """``docs`` with a struct column ``name``: counts of base spans, their digest, all spans as text."""
    fields = [(f"n_{k}", pa.int64()) for k in KINDS[:BASE]] + [
        ("n_added", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
    kind = pa.struct(fields)

    def listed(some: list[Span]) -> str:
        return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in some)

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {'bigint' if t == pa.int64() else 'string'}" for n, t in fields) + ">")
    def column(texts: pa.Array) -> pa.Array:
        rows = []
        for part in slices(texts):
            for t in part.to_pylist():
                every = spans(t)
                plain = [s for s in every if s.base]
                counts = [sum(s.kind == k for s in plain) for k in range(BASE)]
                digest = hashlib.sha256(listed(plain).encode()).hexdigest()
                values = [*counts, len(every) - len(plain), digest, listed(every)]
                rows.append(dict(zip([n for n, _ in fields], values)))
        return pa.array(rows, kind)
    return docs.withColumn(name, column(text))
