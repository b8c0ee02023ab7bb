"""Personal data behind disguises, with spans in the source text.

Four kinds of identifier are searched twice: in the text as it is (base spans), and in a normalised
form made by three transducers in a row, each of which carries for every output character the source
characters it stands for:
1. look-alikes: letters of other alphabets, full-width and mathematical forms, zero-width characters
2. written-out or spaced "at" and "dot", in brackets, or between the words of an address or the numbers of an ip
3. runs of spelled digits, with "plus" before and "dot" between them, and letters inside numbers that look
   like a digit
Spans found in the normalised form are mapped back and added; base spans always stay.

Everything happens inside one row, so there is no shuffle and no skew between documents.

Defined cases
* null text counts as empty and has no spans; empty texts likewise
* very long texts are scanned whole, in time linear in their length
* repeated rows and null ``doc_id`` give one result row each; ties in a start are ordered by kind
* an empty table gives an empty result; extra columns are ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# every ip, card or phone lies inside one of these runs
ZONE = re.compile(r"[0-9+][0-9 ().+-]{6,}")
IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters that look like a Latin one.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "А": "A", "В": "B", "С": "C",
    "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y",
    "Х": "X", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɡ": "g", "ℓ": "l", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "․": ".", "。": ".", "٫": ".", "·": ".",
}
ZERO_WIDTH = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
DIGIT_LETTERS = str.maketrans("OoIl", "0011")
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
AT_WORDS = "at|arroba|ät|chez"
DOT_WORDS = "dot|punkt|punto|point"
BETWEEN = rf"(?: (?:{DOT_WORDS}) |[ ,.-]{{1,2}})"
# runs of at least three spelled digits; figures may stand between them
SPELLED = re.compile(rf"\b(?:plus[ ,-]{{1,2}})?(?:(?:{WORD}|[0-9]+){BETWEEN}){{2,}}(?:{WORD}|[0-9]+)\b", re.IGNORECASE)
A_WORD = re.compile(rf"plus|{DOT_WORDS}|{WORD}|[0-9]", re.IGNORECASE)
A_DIGIT_WORD = re.compile(WORD, re.IGNORECASE)
# Each HAS_* finds something in every text in which the pattern it guards would rewrite something.
# on lower case, after a leading blank: a set of first characters makes this many times faster than ignoring case
HAS_WORD = re.compile(rf"\W(?:{WORD}){BETWEEN}(?:{WORD}|[0-9])")
# figures alone also count as spelled between these, which hold a digit word
HAS_UN = re.compile(" pun(?:kt|to) ")
BRACKETED = re.compile(rf"\s{{0,3}}[\[({{<]\s{{0,3}}(?:({AT_WORDS}|@)|(?:{DOT_WORDS}|\.))\s{{0,3}}[\])}}>]\s{{0,3}}", re.IGNORECASE)
# written-out signs without brackets count only before one of these endings
ENDINGS = "com|org|net|edu|gov|info|biz|io|ai|co|me|de|at|ch|fr|es|it|nl|be|uk|eu|us|mx|ar"
WRITTEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:(?: {{1,3}}(?:{DOT_WORDS}) {{1,3}}|\.)[A-Za-z0-9_%+-]{{1,64}}){{0,8}}"
    rf" {{1,3}}(?:{AT_WORDS}) {{1,3}}[A-Za-z0-9-]{{1,64}}(?:(?: {{1,3}}(?:{DOT_WORDS}) {{1,3}}|\.)[A-Za-z0-9-]{{2,64}})*?"
    rf" {{1,3}}(?:{DOT_WORDS}) {{1,3}}(?:{ENDINGS})\b", re.IGNORECASE,
)
A_SIGN = re.compile(rf" {{1,3}}(?:({AT_WORDS})|(?:{DOT_WORDS})) {{1,3}}", re.IGNORECASE)
# "first.last at site.org": only local parts that no ordinary word looks like
PLAIN_AT = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+-]{{1,64}}[._0-9][A-Za-z0-9._%+-]{{0,64}}( {{1,3}}(?:{AT_WORDS}) {{1,3}})(?:[A-Za-z0-9-]{{1,64}}\.){{1,8}}(?:{ENDINGS})\b",
    re.IGNORECASE,
)
HAS_AT = re.compile(rf" (?:{AT_WORDS}) +[A-Za-z0-9-]+\.[A-Za-z0-9-]", re.IGNORECASE)
SPACED = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}( {{0,3}}@ {{0,3}})[A-Za-z0-9-]{{1,64}}(?: {{0,3}}\. {{0,3}}[A-Za-z0-9-]{{1,64}}){{0,8}}? {{0,3}}\. {{0,3}}(?:{ENDINGS})\b", re.IGNORECASE)
HAS_SPACED = re.compile(r" @|@ |@[A-Za-z0-9.-]++(?: {1,3}\.|(?<=\.) )", re.IGNORECASE)
A_GAP = re.compile(r" *([@.]) *")
DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?: {{1,3}}(?:{DOT_WORDS}) {{1,3}}[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
INNER_LETTER = re.compile(r"[0-9][ -]?[OoIl]+(?=[ -]?[0-9])")
HAS_DOT = re.compile(rf" (?:{DOT_WORDS}) ", re.IGNORECASE)


def lower(text: str) -> str:
    """Lower case as patterns see it that ignore case: a capital I with a dot is an i."""
    return text.replace("İ", "i").lower()


def luhn(digits: str) -> bool:
    total = 0
    for at, d in enumerate(map(int, reversed(digits))):
        total += d if at % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of a local part, an at sign and a domain.

    A local part holds no at sign, so it is what lies between the last sign (or match) and this one, and a
    domain is tried once per sign: no character is looked at more than a few times.
    """
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        domain = DOMAIN.match(text, at + 1) if left < at else None
        if domain:
            done = domain.end()
            out.append((left, done))
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of addresses, cards and phones."""
    for zone in ZONE.finditer(text):
        start, end = zone.span()
        part = zone.group()
        if part.count(".") >= 3:
            for m in IP.finditer(text, start, end):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    yield m.start(), 1, m.end()
        if end - start >= 14:
            for m in CARD.finditer(text, start, end):
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield m.start(), 2, m.end()
        if "+" in part:
            for m in PHONE.finditer(text, start, end):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    yield m.start(), 3, m.end()


def identifiers(text: str) -> set[tuple[int, int, int]]:
    return {(s, 0, e) for s, e in emails(text)} | set(numbers(text))


class Mapped:
    """A text and, for each of its characters, the source characters it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start: np.ndarray | None = None  # every character stands for itself until a rewrite moves one
        self.end: np.ndarray | None = None
        self.changed = False

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of a span of the text."""
        return (start, end) if self.start is None else (int(self.start[start]), int(self.end[end - 1]))

    def rewrite(self, parts: list[tuple[int, int, str]]) -> None:
        """Replace the spans (in order) by texts whose characters stand for the whole span each."""
        if not parts:
            return
        self.changed = True
        if self.start is None:
            self.start = np.arange(len(self.text))
            self.end = self.start + 1
        texts, starts, ends, done = [], [], [], 0
        for a, b, new in parts:
            texts += [self.text[done:a], new]
            starts += [self.start[done:a], np.full(len(new), self.start[a])]
            ends += [self.end[done:a], np.full(len(new), self.end[b - 1])]
            done = b
        self.text = "".join([*texts, self.text[done:]])
        self.start = np.concatenate([*starts, self.start[done:]])
        self.end = np.concatenate([*ends, self.end[done:]])


class LookalikeTable(dict):
    """Translation of one character, by the table above or by its compatibility form; filled on demand."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = char
        if code > 127:
            form = unicodedata.normalize("NFKC", char)
            plain = LOOKALIKES.get(char) or (form if len(form) == 1 and form.isascii() and form.isprintable() else char)
        self[code] = plain
        return plain


TABLE = LookalikeTable()


def normalise(text: str) -> Mapped:
    """The three transducers in a row; ``changed`` tells whether any of them fired."""
    out = Mapped(text)
    if not text.isascii():
        plain = text.translate(TABLE)
        if plain != text:
            out.text, out.changed = plain, True
        if not ZERO_WIDTH.isdisjoint(out.text):
            out.rewrite([(m.start(), m.end(), "") for m in re.finditer("[" + "".join(ZERO_WIDTH) + "]+", out.text)])
    out.rewrite([(m.start(), m.end(), "@" if m[1] else ".") for m in BRACKETED.finditer(out.text)])
    if HAS_DOT.search(out.text):
        signs = [
            (s.start(), s.end(), "@" if s[1] else ".")
            for m in WRITTEN.finditer(out.text)
            for s in A_SIGN.finditer(out.text, m.start(), m.end())
        ]
        out.rewrite(signs)
        out.rewrite([
            (s.start(), s.end(), ".") for m in DOTTED.finditer(out.text) for s in A_SIGN.finditer(out.text, m.start(), m.end())
        ])
    if HAS_AT.search(out.text):
        out.rewrite([(*m.span(1), "@") for m in PLAIN_AT.finditer(out.text)])
    if HAS_SPACED.search(out.text):
        out.rewrite([
            (s.start(), s.end(), s[1])
            for m in SPACED.finditer(out.text)
            for s in A_GAP.finditer(out.text, m.start(), m.end())
            if len(s.group()) > 1
        ])
    if INNER_LETTER.search(out.text):
        plain = INNER_LETTER.sub(lambda m: m.group().translate(DIGIT_LETTERS), out.text)
        out.text, out.changed = plain, True
    small = " " + lower(out.text)
    if HAS_WORD.search(small) or HAS_UN.search(small):
        parts = []
        for m in SPELLED.finditer(out.text):
            if len(A_DIGIT_WORD.findall(m.group())) < 3:
                continue
            last = m.start()
            for w in A_WORD.finditer(out.text, m.start(), m.end()):
                if w.start() > last:
                    parts.append((last, w.start(), ""))
                word = lower(w.group())
                if not word.isdigit():
                    parts.append((w.start(), w.end(), "+" if word == "plus" else DIGIT_WORDS.get(word, ".")))
                last = w.end()
        out.rewrite(parts)
    return out


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, as (start, kind, end), sorted."""
    base = identifiers(text)
    mapped = normalise(text)
    every = set(base)
    if mapped.changed:
        for start, kind, end in identifiers(mapped.text):
            first, last = mapped.source(start, end)
            every.add((first, kind, last))
    return sorted(base), sorted(every)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, ``base`` and ``spans``: arrays of (kind, start, end) in code points of the source text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shown = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]
        for batch in batches:
            found = [spans_of(t.as_py() or "") for t in batch.column("text")]
            columns = [pa.array([shown(f[n]) for f in found], kind) for n in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, base {span}, spans {span}")
