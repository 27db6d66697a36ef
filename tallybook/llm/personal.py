"""Personal data: patterns propose spans, checksums confirm them, words nearby move their scores."""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds in the order of all listings. Spans of the first four are kept whatever their score.
KINDS = ["email", "ip", "card", "phone", "iban", "ip6", "ssn", "national_phone", "short_card"]
BASE = 4
LEAST = 0.6  # score from which a span of another kind counts
# Score of a confirmed span, before the words around it are looked at.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ip6": 0.7, "ssn": 0.4, "national_phone": 0.4, "short_card": 0.4}
STEP = 0.3  # by which a word nearby raises or lowers a score
BEFORE, AFTER = 48, 24  # characters around a span in which words count

# Characters of a mail address before its sign.
MAIL_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# Length of a bank account number by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
# Words that speak for a kind or against it, in English, French, German, Spanish and Italian.
FOR = {
    "email": {"mail", "email", "courriel", "correo", "contact", "kontakt"},
    "ip": {"ip", "address", "adresse", "host", "server", "client", "login", "ping"},
    "card": {"card", "visa", "mastercard", "credit", "carte", "karte", "kreditkarte", "tarjeta", "carta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "anruf", "appeler", "móvil", "teléfono", "telefono"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "conto", "bank"},
    "ssn": {"ssn", "social", "security"},
}
FOR |= {"ip6": FOR["ip"], "national_phone": FOR["phone"], "short_card": FOR["card"] | {"amex", "diners"}}
AGAINST = {
    "ip": {"version", "release", "build", "section", "chapter"},
    "card": {"isbn", "order", "invoice", "serial"},
    "phone": {"order", "invoice", "serial"},
    "ssn": {"order", "part", "serial", "invoice"},
}
AGAINST |= {"ip6": AGAINST["ip"], "national_phone": AGAINST["phone"], "short_card": AGAINST["card"]}

DIGIT = re.compile("[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,39}+(?![0-9A-Za-z:])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])")
WORDS = re.compile(r"[^\W\d_]+")

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPANS = "array<struct<kind:int,start:bigint,end:bigint,score:double>>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    doubled = "0246813579"
    return sum(int(doubled[int(c)]) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(number: str) -> bool:
    """Whether a bank account number leaves 1 when its letters are read as 10 to 35 and its head goes last."""
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


def mails(text: str) -> Iterator[Span]:
    """Mail addresses, found from their signs, so that a long run without a sign costs nothing."""
    free, sign = 0, text.find("@")
    while sign >= 0:
        before = text[free:sign]
        start = free + len(before.rstrip(MAIL_CHARACTERS))
        found = DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            yield Span("email", start, found.end())
        # neither part of an address holds a sign, so nothing before this one is needed again
        free = found.end() if found else sign + 1
        sign = text.find("@", free)


def addresses(text: str) -> Iterator[Span]:
    """Four numbers joined by dots. A longer chain is cut into fours from its start; numbers over 255 drop a four."""
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in four):
                yield Span("ip", at, end)
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    """Chains of digits, single spaces or hyphens between them, as long as a card number and confirmed by Luhn."""
    for chain in CARD.finditer(text):
        # 19 digits and 18 marks between them
        digits = chain.group().replace(" ", "").replace("-", "") if chain.end() - chain.start() <= 37 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield Span("card" if len(digits) >= 16 else "short_card", chain.start(), chain.end())


def phones(text: str) -> Iterator[Span]:
    """International numbers of 8 to 15 digits."""
    if "+" in text:
        for found in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
                yield Span("phone", found.start(), found.end())


def accounts(text: str) -> Iterator[Span]:
    """Bank account numbers of their country's length, confirmed by the remainder 1 modulo 97."""
    found = IBAN.search(text)
    while found:
        size, start, end = IBAN_LENGTHS.get(found.group()[:2], 0), found.start(), 0
        places = [i for i, c in enumerate(found.group()) if c != " "][:size]
        if size and len(places) == size:
            end = start + places[-1] + 1
        confirmed = end and not text[end : end + 1].isalnum() and mod97(text[start:end].replace(" ", ""))
        if confirmed:
            yield Span("iban", start, end)
        found = IBAN.search(text, end if confirmed else start + 4)


def six(text: str) -> Iterator[Span]:
    """Addresses of the sixth version with three groups at least."""
    if text.count(":") < 2:
        return
    for found in IP6.finditer(text):
        if len([g for g in found.group().split(":") if g]) >= 3 and DIGIT.search(found.group()):
            try:
                ipaddress.IPv6Address(found.group())
            except ValueError:
                continue
            yield Span("ip6", found.start(), found.end())


def social(text: str) -> Iterator[Span]:
    """Numbers of the form 3-2-4 whose parts can be given out."""
    for found in SSN.finditer(text):
        area, group, serial = found.group().split("-")
        if area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000":
            yield Span("ssn", found.start(), found.end())


def national(text: str) -> Iterator[Span]:
    """Numbers of the form 3-3-4 without a country."""
    for found in NATIONAL.finditer(text):
        yield Span("national_phone", found.start(), found.end())


def proposals(text: str) -> list[Span]:
    """Confirmed spans: all of the base kinds, and those of the other kinds that overlap none before them."""
    found = list(mails(text))
    if not DIGIT.search(text):
        return found
    numbers = list(cards(text))
    found += [*addresses(text), *(s for s in numbers if s.kind == "card"), *phones(text)]
    for more in (accounts(text), six(text), social(text), national(text), (s for s in numbers if s.kind != "card")):
        starts, ends = _covered(found)
        # the last stretch that starts before a span's end is the only one that can reach into it
        found += [s for s in more if not (i := bisect_left(starts, s.end)) or ends[i - 1] <= s.start]
    return found


def _covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the separate stretches that spans cover, in order."""
    starts, ends = [], []
    for start, end in sorted((s.start, s.end) for s in spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def score(text: str, span: Span) -> float:
    """The kind's score, moved by the words shortly before and after the span."""
    around = text[max(0, span.start - BEFORE) : span.start] + " | " + text[span.end : span.end + AFTER]
    words = {w.lower() for w in WORDS.findall(around)}
    moved = SCORES[span.kind] + STEP * bool(words & FOR.get(span.kind, set())) - STEP * bool(words & AGAINST.get(span.kind, set()))
    return round(min(1.0, max(0.0, moved)), 4)


def find_spans(text: str, least: float = LEAST) -> list[dict]:
    """All spans of a text with their scores, by kind, then start."""
    rated = [(KINDS.index(s.kind), s.start, s.end, score(text, s)) for s in proposals(text)]
    kept = sorted(r for r in rated if r[0] < BASE or r[3] >= least)
    return [dict(zip(("kind", "start", "end", "score"), r)) for r in kept]


def personal_spans(text: Column, least: float = LEAST) -> Column:
    """The spans of a text column; none for null."""

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        return pa.array([find_spans(t.as_py() or "", least) for t in texts], pa.list_(SPAN))

    return find(text)


def scan(docs: DataFrame, text_col: str = "text", out: str = "personal", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with a column ``out``: spans (kind number, start, end, score), by kind, then start.

    Places are code points of the whole text, ends exclusive. Null and empty texts have no spans; repeated rows are
    scanned each; a column named ``out`` is replaced. One text is one task's work, in time linear in its length.
    """
    return docs.withColumn(out, personal_spans(F.col(text_col), least))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans of each base kind counted, ``base_sha256`` and ``spans``.

    Texts without spans, null ones among them, have counts 0 and an empty ``spans``. A null id stays null, repeated rows
    stay repeated, an empty table gives no rows; other columns are ignored.
    """
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "personal")
    count = lambda i: F.size(F.filter("personal", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    base = F.filter("personal", lambda s: s["kind"] < BASE)
    return found.select(
        F.col("doc_id").alias(id_col), *[count(i) for i in range(BASE)],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("personal")).alias("spans"),
    )


def redacted(docs: DataFrame, text_col: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` with every span, or run of overlapping spans, replaced by its first kind in angle brackets.

    Null texts stay null; rows without spans stay as they are.
    """

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([_masked(t.as_py(), least) for t in texts], pa.string())

    return docs.withColumn(text_col, mask(F.col(text_col)))


def _masked(text: str | None, least: float) -> str | None:
    spans = sorted((s["start"], s["end"], KINDS[s["kind"]]) for s in find_spans(text or "", least))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text
