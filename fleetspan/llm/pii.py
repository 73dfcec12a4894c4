"""Personal data in texts, also disguised, with spans in the characters of the source.

Plain identifiers are found in the text as it is. Then transducers rewrite the
text and remember for every character they emit which source characters it stands
for: homoglyphs and invisible characters, spelled digits, and at / dot disguises.
Identifiers found in the rewritten text are mapped back to source spans and added
unless they overlap one of their kind that is already there.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Patterns of plain identifiers.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")  # from the first of the digits only: the others would be read again and again
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "м": "m", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S",
    "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X",
    "ı": "i", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Digits as words.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8",
    "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8",
    "nueve": "9",
}
PLUS_WORDS = ("plus",)
AT_WORDS = ("at", "arroba", "chez")
DOT_WORDS = ("dot", "punkt", "point", "punto")

_ANY = lambda words: "|".join(sorted(words, key=len, reverse=True))
# One spelled digit, and a run of at least four of them, possibly with signs and dots between.
_DIGIT = rf"(?<!\w)(?:{_ANY(DIGIT_WORDS)})(?!\w)"
_JOINT = rf"(?:[\s,/-]{{1,3}}|[\s,]*(?:{_ANY(DOT_WORDS)}|[.])[\s,]*)"
SPELLED_RUN = re.compile(rf"(?:(?<!\w)(?:{_ANY(PLUS_WORDS)})\s+|\+\s*)?(?:{_DIGIT}|[0-9])(?:{_JOINT}(?:{_DIGIT}|[0-9])){{3,}}", re.I)
SPELLED_PART = re.compile(rf"(?P<digit>{_DIGIT})|(?P<plain>[0-9])|(?P<plus>{_ANY(PLUS_WORDS)}|\+)|(?P<dot>{_ANY(DOT_WORDS)}|\.)|.", re.I | re.S)
SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_ANY(DIGIT_WORDS)})[\s,./-]+(?:{_ANY(DIGIT_WORDS)}|{_ANY(DOT_WORDS)}|[0-9])(?!\w)", re.I)
# Disguised signs: bracketed ones always, with the white space around them; bare words only as part of "name at host dot zone".
BRACKETED = re.compile(rf"[(\[{{<]\s*(?:(?P<at>{_ANY(AT_WORDS)}|@)|(?P<dot>{_ANY(DOT_WORDS)}|\.))\s*[)\]}}>]", re.I)
_LABEL = r"[A-Za-z0-9-]+"
BARE_AT = re.compile(rf"\s(?:{_ANY(AT_WORDS)})\s(?!(?:the|an?|this|that|its|my|your|our)\s)|@", re.I)
BARE_DOMAIN = re.compile(rf"{_LABEL}(?:(?:\.|\s(?:{_ANY(DOT_WORDS)})\s){_LABEL})+", re.I)
NAME_CHARS = LOCAL_CHARS - {"."}
BARE_PART = re.compile(rf"(?P<at>\s(?:{_ANY(AT_WORDS)})\s)|(?P<dot>\s(?:{_ANY(DOT_WORDS)})\s)|.", re.I | re.S)
BRACKET_HINT = re.compile(rf"[(\[{{<]\s*(?:{_ANY(AT_WORDS + DOT_WORDS)}|@|\.)\s*[)\]}}>]", re.I)
DOT_HINT = re.compile(rf"\s(?:{_ANY(DOT_WORDS)})\s", re.I)

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost local part before each @, bounded by the match before; linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            out.append((start, free))
        else:
            free = at + 1
        at = text.find("@", max(free, at + 1))
    return out


def ips(text: str) -> list[Span]:
    """Groups of four parts along each dotted run of digits; a group with a part over 255 is dropped."""
    out = []
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        ends, place = [], at
        for p in parts:
            ends.append((place, place + len(p)))
            place += len(p) + 1
        for k in range(0, len(parts) - 3, 4):
            if all(len(n := p.lstrip("0")) <= 3 and int(n or 0) <= 255 for p in parts[k : k + 4]):
                out.append((ends[k][0], ends[k + 3][1]))
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    out = []
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(m.span())
    return out


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones}


class Rewritten:
    """A text made of pieces, with the source span behind each of its characters."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def replaced(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """Replace spans of this text; each new character stands for the whole replaced span."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for start, end, new in edits:
            text.append(self.text[at:start])
            starts += self.starts[at:start]
            ends += self.ends[at:start]
            text.append(new)
            starts += [self.starts[start]] * len(new)
            ends += [self.ends[end - 1]] * len(new)
            at = end
        return Rewritten("".join((*text, self.text[at:])), starts + self.starts[at:], ends + self.ends[at:])

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def _plain_letter(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～":  # full-width forms of ASCII
        return chr(ord(c) - 0xFEE0)
    digit = unicodedata.digit(c, None)
    return c if digit is None else str(digit)


# Outside ASCII and the Latin letters with marks: whatever the first transducer may change.
LOOKALIKE = re.compile(f"[{re.escape(''.join(c for c in HOMOGLYPHS if ord(c) < 0x370) + INVISIBLE)}²³¹Ͱ-\U0010ffff]")


def plain_letters(at: Rewritten) -> Rewritten:
    edits = []
    for m in LOOKALIKE.finditer(at.text):
        new = _plain_letter(m[0])
        if new != m[0]:
            edits.append((m.start(), m.end(), new))
    return at.replaced(edits)


def plain_digits(at: Rewritten) -> Rewritten:
    edits = []
    for run in SPELLED_RUN.finditer(at.text):
        new = []
        for m in SPELLED_PART.finditer(run[0]):
            if m["digit"]:
                new.append((m.start(), m.end(), DIGIT_WORDS[m["digit"].lower()]))
            elif m["dot"]:
                new.append((m.start(), m.end(), "."))
            elif m["plus"]:
                new.append((m.start(), m.end(), "+"))
            elif not m["plain"]:
                new.append((m.start(), m.end(), ""))
        if any(n.isdigit() for _, _, n in new):  # a run of figures alone stays as it is
            edits += [(run.start() + a, run.start() + b, n) for a, b, n in new]
    return at.replaced(edits)


def _dot_before(text: str, end: int, least: int) -> int | None:
    """Where a sign for a dot that ends at ``end`` starts, if there is one: a dot, or such a word between blanks."""
    if end > least and text[end - 1] == ".":
        return end - 1
    if end > least and text[end - 1].isspace():
        for word in DOT_WORDS:
            start = end - 2 - len(word)
            if start >= least and text[start].isspace() and text[start + 1 : end - 1].lower() == word:
                return start
    return None


def _local_start(text: str, end: int, least: int) -> int | None:
    """Where the name before an at sign starts: words joined by dots, as far to the left as they go; None without a name."""
    found, at = None, end
    while True:
        start = at
        while start > least and text[start - 1] in NAME_CHARS:
            start -= 1
        if start == at:
            return found
        if start == least or text[start - 1] != ".":  # no name begins behind a dot
            found = start
        dot = _dot_before(text, start, least)
        if dot is None:
            return found
        at = dot


def bare_addresses(text: str) -> list[Span]:
    """Addresses with signs as bare words. Each sign for at is tried once, and no part of the text is read again behind a match."""
    out, free = [], 0
    for sign in BARE_AT.finditer(text):
        if sign.start() < free:
            continue
        start = _local_start(text, sign.start(), free)
        domain = BARE_DOMAIN.match(text, sign.end()) if start is not None else None
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        else:
            free = sign.end()
    return out


def plain_signs(at: Rewritten) -> Rewritten:
    edits, free, text = [], 0, at.text
    for m in BRACKETED.finditer(text):
        start, end = m.span()
        while start > free and text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end].isspace():
            end += 1
        edits.append((start, end, "@" if m["at"] else "."))
        free = end
    at = at.replaced(edits)
    edits = []
    for start, end in bare_addresses(at.text):
        for m in BARE_PART.finditer(at.text, start, end):
            if m["at"] or m["dot"]:
                edits.append((m.start(), m.end(), "@" if m["at"] else "."))
    return at.replaced(edits)


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in FINDERS.items()}


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the rewritten text shows; each transducer runs where its signs occur."""
    look = bool(LOOKALIKE.search(text))
    start = plain_letters(Rewritten(text)) if look else Rewritten(text, [], [])
    spelled = SPELLED_HINT.search(start.text)
    signs = BRACKET_HINT.search(start.text) or DOT_HINT.search(start.text)
    if start.text == text and not spelled and not signs:
        return {}
    at = start if look else Rewritten(text)
    at = plain_signs(plain_digits(at) if spelled else at) if signs else plain_digits(at) if spelled else at
    if at.text == text:
        return {}
    out = {}
    for kind, find in FINDERS.items():
        taken = sorted(base[kind])  # they do not overlap
        starts = [x for x, _ in taken]
        added = []
        for span in find(at.text):
            a, b = at.source(span)
            before = bisect_left(starts, b) - 1  # the last that starts before the end
            if before < 0 or taken[before][1] <= a:
                added.append((a, b))
        if added:
            out[kind] = added
    return out


def written_spans(spans: dict[str, list[Span]]) -> str:
    """kind:start:end by start, then kind in the fixed order, joined by commas."""
    rows = sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in spans.get(kind, ()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in rows)


def find_identifiers(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts of plain identifiers by kind, base_spans, spans (with the disguised ones) and n_added.

    Spans are code points of the source text, the end not included. A null text
    counts as empty and has none; repeated rows give equal rows; the whole text is
    searched whatever its length, each document by itself, so nothing is shuffled.
    Other columns of ``docs`` play no part.
    """

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string, n_added long")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text or "")
                added = disguised_spans(text or "", base)
                both = {k: base[k] + added.get(k, []) for k in KINDS}
                plain = written_spans(base)
                rows.append((*(len(base[k]) for k in KINDS), plain, written_spans(both) if added else plain, sum(map(len, added.values()))))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans", "n_added"])

    found = docs.select(F.col(key).alias("doc_id"), search(F.col(text)).alias("found"))
    return found.select("doc_id", "found.*")
