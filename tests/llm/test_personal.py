"""Personal data: base spans against the plain patterns, checksums, context and masking."""

import hashlib
import random
import re
import time

import pytest

from tallybook.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    """Base spans straight from the patterns."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fit = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fit:
                out.append((kind, m.start(), m.end()))
    return out


def spans(text, **more):
    return [(personal.KINDS[s["kind"]], s["start"], s["end"]) for s in personal.find_spans(text, **more)]


def base(text):
    return [s for s in spans(text) if s[0] in PATTERNS]


def awkward(rng):
    bits = ["a.b@c.d", "@", ".", "x@y", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "é", "😀", " ", "-", "007", "+3", "@b.c@d.e_f@g.h", "0000000000000000", "1", "23", "\n"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(6000):
        text = awkward(rng)
        assert base(text) == plain(text), text


def test_checksums():
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")
    assert personal.mod97("DE89370400440532013000") and not personal.mod97("DE88370400440532013000")
    assert spans("IBAN DE89 3704 0044 0532 0130 00 FR14 2004 1010 0505 0001 3M02 606 ENDE") == [("iban", 5, 32), ("iban", 33, 66)]
    assert spans("GB82WEST12345698765432 and GB83WEST12345698765432 and GB82WEST123456987654321") == [("iban", 0, 22)]
    assert spans("XX89370400440532013000 DE8937040044053201300") == []


def test_context_moves_the_score():
    by = lambda text: {personal.KINDS[s["kind"]]: s["score"] for s in personal.find_spans(text, least=0)}
    assert by("server 10.0.0.1")["ip"] > by("see 10.0.0.1")["ip"] > by("version 10.0.0.1")["ip"]
    assert spans("number 123-45-6789 here") == [] and spans("my SSN is 123-45-6789") == [("ssn", 10, 21)]
    assert spans("SSN 000-45-6789 SSN 666-45-6789 SSN 923-45-6789 SSN 123-00-6789 SSN 123-45-0000") == []
    assert spans("code (415) 555-2671") == [] and spans("call (415) 555-2671") == [("national_phone", 5, 19)]
    assert spans("amex 378282246310005") == [("short_card", 5, 20)] and spans("see 378282246310005") == []
    assert spans("host 2001:db8::ff00:42:8329 std::vector 12:30:45") == [("ip6", 5, 27)]


def test_added_spans_overlap_no_others():
    rng = random.Random(9)
    bits = ["call ", "card ", "SSN ", "123-45-6789", "(415) 555-2671", "+1 415 555 2671", "378282246310005", "4111111111111111", "DE89370400440532013000", " ", "10.0.0.1"]
    for _ in range(1500):
        found = spans("".join(rng.choice(bits) for _ in range(12)), least=0)
        for i, (kind, a, b) in enumerate(found):
            if kind not in PATTERNS:
                assert not any(c < b and a < d for j, (_, c, d) in enumerate(found) if i != j)


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1 " * 130_000, "1 " * 200_000, "AB12 " * 80_000, "a@b.c " * 60_000, "call 415-555-2671 " * 20_000, "ab:" * 130_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    personal.find_spans(text)
    assert time.time() - began < 20


def test_query_columns(spark, docs, corpus, no_docs):
    extra = [(500, "mail a@b.co, card 4111 1111 1111 1111 ip 1.2.3.4 tel +39 06 1234 5678 IBAN DE89370400440532013000"), (None, "ü@x a@b.c"), (501, "")]
    rows = [(r[0], r[1]) for r in corpus] + extra
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, personal int, kind string")
    got = sorted((tuple(r) for r in personal.find_personal(frame).collect()), key=str)
    want = []
    for doc_id, text in rows:
        found = plain(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        everything = ",".join(f"{k}:{a}:{b}" for k, a, b in spans(text or ""))
        want.append((doc_id, *[sum(k == kind for k, _, _ in found) for kind in PATTERNS], hashlib.sha256(listed.encode()).hexdigest(), everything))
    assert got == sorted(want, key=str)
    assert personal.find_personal(no_docs).count() == 0
    scanned = personal.scan(frame)
    assert scanned.columns == frame.columns and scanned.count() == len(rows)


def test_masking(spark):
    rows = [(1, "mail a@b.co now"), (2, None), (3, "plain"), (4, "+14111 1111 1111 111 x"), (5, "é 1.2.3.4 SSN 123-45-6789")]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, personal string")
    got = {r.doc_id: (r.text, r.personal) for r in personal.redacted(frame).collect()}
    assert got[1] == ("mail <email> now", "k") and got[2] == (None, "k") and got[3] == ("plain", "k")
    assert got[5] == ("é <ip> SSN <ssn>", "k")
