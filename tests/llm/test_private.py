from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loanline.llm.private import KINDS, Tape, disguised, find_private, identifiers

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(p[-5000:].lstrip("0")[:9] or 0) <= 255 for p in found.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 8 <= len(digits) <= 15


def base(text):
    """The patterns as they are written."""
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if passes(k, m[0])]


def joined(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


CARD = "4845168114407329"
TEXTS = [
    "a@b.com%x@c.org a@b.c@d.e .@-.- x@y x@.com @b.com é@b.com ü.34@mail7.example.com.",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 9.9.9.9999 1..2.3.4",
    f"{CARD} 4845-1681-1440-7329 4845 1681 1440 7329 4845  1681 x{CARD}1 {CARD[:-1]}0",
    "+1 (017) 555-7713 +1 2 +12345678 +1234567 ++49 30 1234567- +1 555 1234567 8901234",
    "+" + "1" * 16,
    "",
    None,
    "é" * 5 + f" {CARD} é a@b.de",
    "1" * 6000 + ".1.1.1 " + "0" * 5000 + "1.1.1.1",
]


def test_base_against_patterns_as_written(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[3]), (3, TEXTS[3])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, n_email int").repartition(3)
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in find_private(frame).collect())
    want = sorted((str(d), *[sum(k == i for k, _, _ in base(t)) for i in range(4)], hashlib.sha256(joined(base(t)).encode()).hexdigest()) for d, t in rows)
    assert got == want


@settings(max_examples=400, deadline=None)
@given(st.text("ab1249.@+- ()%é", max_size=60))
def test_any_text(text):
    assert sorted(identifiers(text)) == sorted(base(text))


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail john.doe at example dot com now", 0, "john.doe at example dot com"),
        ("mail john [at] example [dot] com, x", 0, "john [at] example [dot] com"),
        ("(user(at)host(dot)org)", 0, "user(at)host(dot)org"),
        ("write to ana arroba casa punto es hoy", 0, "ana arroba casa punto es"),
        ("jоhn@exаmple.com here", 0, "jоhn@exаmple.com"),
        ("éé john＠example．com", 0, "john＠example．com"),
        ("x j​ohn@exam​ple.c​om​ y", 0, "j​ohn@exam​ple.c​om"),
        ("john @ example . com", 0, "john @ example . com"),
        ("host 192 dot 168 dot 0 dot 1 up", 1, "192 dot 168 dot 0 dot 1"),
        ("host 10[.]0[.]0[.]1 up", 1, "10[.]0[.]0[.]1"),
        ("call plus one two three, four five six seven eight nine now", 3, "plus one two three, four five six seven eight nine"),
        ("call +1 (four one five) 555 zero one two three ok", 3, "+1 (four one five) 555 zero one two three"),
        ("ruf +4 neun drei null eins zwei drei vier an", 3, "+4 neun drei null eins zwei drei vier"),
        ("card " + " ".join("zero one two three four five six seven eight nine".split()[int(d)] for d in CARD) + " x", 2, None),
        ("\U0001d7d2８٤٥ 1681 1440 7329", 2, "\U0001d7d2８٤٥ 1681 1440 7329"),
    ],
)
def test_disguises(text, kind, part):
    base_spans = identifiers(text)
    found = disguised(text, base_spans)
    assert [k for k, _, _ in found] == [kind]
    start, end = found[0][1:]
    assert text[start:end] == (part or text[5:-2])


@pytest.mark.parametrize(
    "text",
    [
        "meet me at example.com tomorrow . and at noon",
        "look at the dot on the line",
        "one two three four five",
        "the seven of nine, one at a time",
        f"a@b.com 1.2.3.4 {CARD} +1 (017) 555-7713",
        f"a@b.com dot org 1.2.3.4 dot 5 {CARD} two",
        "абв где éè",
        "x at y dot",
    ],
)
def test_clean_texts_and_plain_identifiers_get_nothing_more(text):
    assert disguised(text, identifiers(text)) == []


def test_base_spans_stay(spark):
    text = f"a@b.com, b at c dot com, {CARD}, 1 dot 2 dot 3 dot 4 +1 (017) 555-7713"
    row = find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = row.spans.split(",")
    assert set(joined(base(text)).split(",")) < set(spans) and len(spans) == 5 and row.n_disguised == 2
    assert [s.split(":")[0] for s in spans] == ["email", "email", "ip", "card", "phone"]
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 1, 1)


def test_places_through_several_rewrites():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choices("abcd", k=30))
        tape = Tape(text)
        for old, new in (("ab", "X"), ("c", ""), ("d", "YZ"), ("Xa", "W")):
            tape = tape.rewrite((m.start(), m.end(), new) for m in re.finditer(old, tape.text))
        for i in range(len(tape.text)):
            start, end = tape.source(i, i + 1)
            assert 0 <= start < end <= len(text)
            shown = {"X": "ab", "Y": "d", "Z": "d"}.get(tape.text[i])
            assert text[start:end].replace("c", "") == (shown or tape.text[i] if tape.text[i] != "W" else "aba")


def test_long_texts_in_linear_time():
    began = time.perf_counter()
    for piece in ("a", "1", "1 ", "a@", "+1 ", "1.", "one ", "at ", " dot at", "[", "one-", "а", "​", "(at"):
        text = piece * (200_000 // len(piece))
        disguised(text, identifiers(text))
    assert time.perf_counter() - began < 30


def test_empty(spark):
    assert find_private(spark.createDataFrame([], "doc_id long, text string")).count() == 0
