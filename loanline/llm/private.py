"""Personal data in texts, also where it is disguised.

Addresses and numbers are found as they stand. Then small transducers rewrite the text one after the other: look-alike
characters to ASCII, spelled digits to digits, at and dot disguises to ``@`` and ``.``. Each keeps what it rewrote and
where, so that an identifier found in the rewritten text is mapped back to the characters it came from.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanline.llm.text import steps

KINDS = ["email", "ip", "card", "phone"]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Each can begin only where a run of digits does, so no run is read again from its second digit.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@``, back over the name as far as the match before, and on over the host: no name is read twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            floor = host.end()
            yield begin, floor
        at = text.find("@", max(floor, at + 1))


def _luhn(digits: str) -> bool:
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in found.split(".")))


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(found: str) -> bool:
    return 8 <= sum("0" <= c <= "9" for c in found) <= 15


def identifiers(text: str) -> list[Span]:
    """(kind, start, end) in code points: per kind leftmost and without overlap; matches that fail their test are dropped."""
    found = [(0, start, end) for start, end in _emails(text)]
    for kind, (pattern, test) in enumerate([(_IP, _is_ip), (_CARD, _is_card), (_PHONE, _is_phone)], 1):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if test(m[0])]
    return found


class Tape:
    """A text, and where each rewritten piece of it came from in the text before."""

    def __init__(self, text: str, before: Tape | None = None, pieces: list[tuple[int, int, int, int]] | None = None):
        self.text, self.before = text, before
        #: (start, end here; start, end before) of what was rewritten, in order.
        self.pieces = pieces or []
        self.starts = [p[0] for p in self.pieces]

    def rewrite(self, edits: Iterator[tuple[int, int, str]]) -> Tape:
        """The text with each (start, end, replacement) done; ``edits`` are in order and do not overlap."""
        parts, pieces, at, size = [], [], 0, 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            size += start - at
            pieces.append((size, size + len(new), start, end))
            at, size = end, size + len(new)
        return Tape("".join([*parts, self.text[at:]]), self, pieces) if pieces else self

    def _origin(self, place: int) -> tuple[int, int]:
        """Start and end, in the text before, of what the character at ``place`` came from."""
        k = bisect_right(self.starts, place) - 1
        if k < 0:
            return place, place + 1
        begin, stop, old_begin, old_stop = self.pieces[k]
        if place < stop:
            return old_begin, old_stop
        return old_stop + place - stop, old_stop + place - stop + 1

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The span of the first text that became [start, end); a piece rewritten as one counts whole."""
        tape = self
        while tape.before is not None:
            start, end = tape._origin(start)[0], tape._origin(end - 1)[1]
            tape = tape.before
        return start, end


# Characters that look like an ASCII one without being compatible with it.
_ALIKE = dict(zip("аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅ", "aeopcyxijsdqwhABEKMHOPCTXIJS", strict=True))
_ALIKE |= dict(zip("αονρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aovpikABEZHIKMNOPTYX", strict=True))
_ALIKE |= dict(zip("‐‑‒–—―−․·。", "-------...", strict=True))
#: Blocks of characters that are compatible with ASCII ones: spaces, full-width, superscript, circled, mathematical.
_BLOCKS = [(0xA0, 0xA1), (0x2000, 0x200B), (0x2024, 0x2025), (0x202F, 0x2030), (0x2070, 0x20A0), (0x2460, 0x2500), (0x3000, 0x3001), (0xFE50, 0xFE70), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)]
#: Characters without width, which are left out.
_HIDDEN = "­​‌‍⁠﻿"


def _alike_table() -> dict[int, str]:
    table = {ord(c): a for c, a in _ALIKE.items()}
    for low, high in _BLOCKS:
        for point in range(low, high):
            plain = unicodedata.normalize("NFKC", chr(point))
            if len(plain) == 1 and plain.isascii():
                table[point] = plain
    for point in range(0x660, 0x10000):  # decimal digits of all scripts
        value = unicodedata.decimal(chr(point), None)
        if value is not None:
            table[point] = str(value)
    return table


_TABLE = _alike_table()
# Beyond the first plane a pattern tries characters one by one, so they stand as one range.
_STRANGE = re.compile(f"[{''.join(re.escape(chr(c)) for c in _TABLE if c < 0x10000)}\U0001D400-\U0001D7FF]")
_HIDDEN_RUN = re.compile(f"[{_HIDDEN}]+")

# Names of the digits.
_DIGITS = [
    "zero one two three four five six seven eight nine".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
]
_VALUES = {name: str(value) for names in _DIGITS for value, name in enumerate(names)}
_NAME = rf"(?:{'|'.join(sorted(_VALUES))})"
_GAP = r"[\x20,-]{1,3}"
#: Two digits or more, names among them; a single name is a word like any other.
_SPELLED = re.compile(rf"(?<!\w)(?:{_NAME}{_GAP}(?:{_NAME}|[0-9])|[0-9]{_GAP}{_NAME})(?:{_GAP}(?:{_NAME}|[0-9]+))*+(?!\w)", re.IGNORECASE)
_TOKEN = re.compile(rf"({_NAME})|([0-9]+)|({_GAP})", re.IGNORECASE)
_PLUS = re.compile(r"(?<!\w)plus\x20(?=[0-9])", re.IGNORECASE)

# How an at sign and a dot are called.
_AT, _DOT = r"(?:at|arroba|arobase|klammeraffe)", r"(?:dot|punkt|punto|point)"
_OPEN, _CLOSE = r"\x20{0,2}[\[({<]\x20?", r"\x20?[\])}>]\x20{0,2}"
_DOTS = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_DOT}|\.){_CLOSE}|[\x20_-]{_DOT}[\x20_-]|\x20\.\x20)(?=[A-Za-z0-9])", re.IGNORECASE)
_ATS = re.compile(rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_AT}|@){_CLOSE}|\x20{{1,2}}@\x20{{0,2}}|@\x20{{1,2}}|([\x20_-]{_AT}[\x20_-]))(?=[A-Za-z0-9])", re.IGNORECASE)
# Frequent last labels of hosts; a bare "at" is a word unless such a host follows.
_TOP = frozenset("com org net edu gov info biz io co app dev ai me de fr es it nl eu uk us ca ch at be se pl pt br mx ar cl".split())


def _look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    tape = tape.rewrite((m.start(), m.end(), "") for m in _HIDDEN_RUN.finditer(tape.text))
    return tape.rewrite((m.start(), m.end(), _TABLE[ord(m[0])]) for m in _STRANGE.finditer(tape.text) if ord(m[0]) in _TABLE)


def _spelled_digits(tape: Tape) -> Tape:
    def edits() -> Iterator[tuple[int, int, str]]:
        for run in _SPELLED.finditer(tape.text):
            for m in _TOKEN.finditer(tape.text, run.start(), run.end()):
                if m[1]:
                    yield m.start(), m.end(), _VALUES[m[1].lower()]
                elif m[3] and len(m[3]) > 1:
                    yield m.start(), m.end(), " "

    tape = tape.rewrite(edits())
    return tape.rewrite((m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text))


def _at_and_dot(tape: Tape) -> Tape:
    dotted = tape.rewrite((m.start(), m.end(), ".") for m in _DOTS.finditer(tape.text))
    rewritten = {p[0] for p in dotted.pieces}

    def edits() -> Iterator[tuple[int, int, str]]:
        for m in _ATS.finditer(dotted.text):
            if m[1]:  # a bare word: only in front of a host whose dot was disguised too, or "at a.org" would be an address
                host = _HOST.match(dotted.text, m.end())
                if not host or dotted.text.index(".", m.end()) not in rewritten or host[0].rpartition(".")[2].lower() not in _TOP:
                    continue
            yield m.start(), m.end(), "@"

    return dotted.rewrite(edits())


TRANSDUCERS: list[Callable[[Tape], Tape]] = [_look_alikes, _spelled_digits, _at_and_dot]


def disguised(text: str, base: list[Span]) -> list[Span]:
    """(kind, start, end) of identifiers that only the rewritten text has, in places of ``text``; none overlaps one of ``base`` of its kind."""
    tape = Tape(text)
    for transducer in TRANSDUCERS:
        tape = transducer(tape)
    if tape.before is None:
        return []
    taken = {kind: sorted((s, e) for k, s, e in base if k == kind) for kind in range(len(KINDS))}
    found = []
    for kind, start, end in identifiers(tape.text):
        start, end = tape.source(start, end)
        held = taken[kind]
        k = bisect_right(held, (start, end)) - 1
        clear = (k < 0 or held[k][1] <= start) and (k + 1 >= len(held) or held[k + 1][0] >= end)
        if clear:
            found.append((kind, start, end))
    return found


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


_COUNTS = [f"n_{kind}" for kind in KINDS]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        counts, digests, shown, added = [[] for _ in KINDS], [], [], []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            base = identifiers(text or "")
            more = disguised(text or "", base)
            for kind, column in enumerate(counts):
                column.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            shown.append(_joined(base + more))
            added.append(len(more))
        columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(added, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "base_sha256", "spans", "n_disguised"])


def find_private(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_disguised): a row for each row of ``docs``.

    The counts and the digest are those of identifiers that stand in the text as they are; ``spans`` lists them and the
    disguised ones as kind:start:end (code points of the text, end exclusive) by kind and start. A null text is empty and
    has none; texts of any length are read once a pattern; repeated rows and null ids are scanned alike; an empty table
    gives no rows; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    counts = ", ".join(f"{name} long" for name in _COUNTS)
    return rows.mapInArrow(_scan, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_disguised long")
