"""Personal data in plain and disguised text, with spans in source code points.

Transducers rewrite disguises: look-alike characters, digits spelled as words,
and "at" and "dot" in place of the signs. Each keeps for every character of
its output the source characters that it came from. Detectors run over the
source and over the rewritten text; what only the rewritten text shows is
mapped back to the source and added.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Characters that look like ASCII ones.
LOOKALIKES = dict(zip(
    "абеорсухіѕјԁһԛԝАВЕКМНОРСТХУІЅЈαινορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧℓ\u2024\u3002\ufe52\u00b7\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\u00a0\u2009\u202f",
    "abeopcyxisjdhqwABEKMHOPCTXYISJaivopuxABEZHIKMNOPTYXl....-------   "))
#: Characters without width.
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Digit words of English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
# The gap between two digit words is taken whole and never given back, so a gap that no digit follows is read once.
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?:plus|\+)[ ,-]*+)?(?:{_WORD}|[0-9])(?:(?:[ ,-]|(?:dot|point)(?= ))++(?:{_WORD}|[0-9])(?![^\W\d_]))+", re.I)
_SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_WORD})[ ,-]{{1,3}}(?:(?:dot|point) )?(?:{_WORD})(?![^\W_])", re.I)
_SPELLED_PART = re.compile(rf"plus|dot|point|{_WORD}|[0-9]|\+", re.I)
_ODD = re.compile(r"[^\x00-\x7f\xc0-\xff]|[\xad\xa0]")
_AT = r"(?:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?)"
_BRACKETED = re.compile(rf"({_AT})|({_DOT})", re.I)
_SPOKEN = re.compile(rf"(?<=[A-Za-z0-9])( at |@)(?=[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+)", re.I)
_SPOKEN_DOT = re.compile(r"(?<=[A-Za-z0-9-])( dot )(?=[A-Za-z0-9-])", re.I)
_AT_DOT_HINT = re.compile(r"dot|[\[({<] ?(?:at|@|\.)", re.I)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def detect(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the plain identifiers of ``text``, sorted; kinds count from 0."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(found)


@lru_cache(maxsize=100_000)
def plain(char: str) -> str | None:
    """The ASCII reading of a character that disguises one; None if it disguises none."""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if char in INVISIBLE:
        return ""
    if 0xFF01 <= ord(char) <= 0xFF5E:  # full-width forms
        return chr(ord(char) - 0xFEE0)
    digit = unicodedata.digit(char, None)
    if digit is not None:
        return str(digit)
    simple = unicodedata.normalize("NFKC", char)
    return simple if simple != char and len(simple) == 1 and simple.isascii() else None


class Rewritten:
    """A text with, for each character, the source span that it came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] | None = None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply sorted, disjoint ``(start, end, replacement)``."""
        if not edits:
            return
        if self.starts is None:
            self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _spelled_edits(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        if sum(p.group().lower() in DIGIT_WORDS for p in _SPELLED_PART.finditer(m.group())) < 4:
            continue
        out = "".join(DIGIT_WORDS.get(w, {"plus": "+", "dot": ".", "point": "."}.get(w, w)) for w in (p.group().lower() for p in _SPELLED_PART.finditer(m.group())))
        edits.append((m.start(), m.end(), out))
    return edits


def rewritten(text: str) -> Rewritten | None:
    """The text after all transducers; None if none of them changes it."""
    r = Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        r.rewrite([(m.start(), m.end(), p) for m in _ODD.finditer(text) if (p := plain(m.group())) is not None])
    if _SPELLED_HINT.search(r.text):
        r.rewrite(_spelled_edits(r.text))
    if _AT_DOT_HINT.search(r.text):
        r.rewrite([(m.start(), m.end(), "@" if m.group(1) else ".") for m in _BRACKETED.finditer(r.text)])
        if " dot " in r.text.lower():
            spoken = [(m.start(1), m.end(1), "@") for m in _SPOKEN.finditer(r.text) if m.group(1) != "@"]
            if spoken or "@" in r.text:
                r.rewrite(sorted(spoken + [(m.start(1), m.end(1), ".") for m in _SPOKEN_DOT.finditer(r.text)]))
    return None if r.starts is None else r


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and those that only the rewritten text shows."""
    base = detect(text)
    r = rewritten(text)
    if r is None:
        return base, base
    every = list(base)
    for a, kind, b in detect(r.text):
        start, end = r.source(a, b)
        if not any(k == kind and s < end and start < e for s, k, e in base):
            every.append((start, kind, end))
    return base, sorted(set(every))


def joined(found: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[] for _ in KINDS]
        sums, every, added, total = [], [], [], []
        for text in batch.column("text").to_pylist():
            base, found = spans(text or "")
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in base))
            sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(found))
            added.append(len(found) - len(base))
            total.append(len(found))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(every, pa.string()), pa.array(added, pa.int64()), pa.array(total, pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_found"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_found`` for each row of ``docs``.

    Counts and the hash are of the identifiers in plain text; ``spans`` has
    these and the ``n_added`` that a disguise hid, ``n_found`` in all, as
    kind:start:end in code points. A null text counts as empty; texts of any
    length are read whole in linear time; repeated rows and null ids give a row
    each. Other columns of ``docs``, of any name, are ignored. No rows give no
    rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_found long")
