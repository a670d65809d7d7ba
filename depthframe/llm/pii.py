"""Personal data with offsets into the source text, through disguises.

A chain of transducers rewrites a text and keeps, for every character it writes, the
span of source characters that this one stands for: look-alike characters become plain
ones, spelled digits become digits, ``[at]`` and ``dot`` become signs. The detectors run
over the rewritten text and each match is mapped back to source characters.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows
each get their own result; spans are code points, end exclusive. Texts that no
transducer changes skip them; the rules themselves are what is asked.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, plain

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits, so looking behind changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ԛ": "q", "г": "r", "п": "n",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "З": "3", "з": "3",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ѵ": "v", "ⅼ": "l", "ӏ": "l",
}
# Digits spelled in the four languages, and the words for signs.
_SPELLED = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "oh": 0,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "fuenf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_DOTS, _ATS, _PLUS, _DASH = "dot|point|punkt|punto", "at|arroba|arobase|ät", "plus|más", "dash|hyphen|minus"
# The last labels of hosts for which bare words are taken as signs. Labels that are frequent words are not among them.
_LAST = "com|net|org|edu|gov|mil|info|biz|io|dev|eu|uk|ca|au|nz|de|fr|ch|nl|pl|pt|dk|fi|gr|cz|ru|cn|jp|kr|br|mx|ar|cl|co|pe|localhost|invalid"
_SPACE = r"[ \t ]"
#: Stands for a dot that a disguise gave; a bare "at" is taken only before such a dot.
_MARK = ""

_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_RUN = re.compile(rf"(?<!\w)(?:{_NUMBER}|[0-9])(?:(?:[ \t ,\-]{{1,3}}|{_SPACE}*(?:{_DOTS}|{_DASH}){_SPACE}*)(?:{_NUMBER}|[0-9]+)(?!\w)){{3,}}", re.I)
_WORD = re.compile(rf"(?<!\w)(?:{_NUMBER})(?!\w)", re.I)
_JOIN = re.compile(r"(?<=[0-9])[ \t ,\-]{1,3}(?=[0-9])")
_PLUS_RULE = re.compile(rf"(?<!\w)(?:{_PLUS}){_SPACE}+(?=[0-9])", re.I)
_DASH_RULE = re.compile(rf"(?<=[0-9]){_SPACE}*(?:{_DASH}){_SPACE}*(?=[0-9])", re.I)
_DOT_RULE = re.compile(rf"(?<=[A-Za-z0-9])(?:{_SPACE}*[\[({{<]{_SPACE}*(?:{_DOTS}|\.){_SPACE}*[\])}}>]{_SPACE}*|{_SPACE}+(?:{_DOTS}){_SPACE}+|[_-](?:{_DOTS})[_-])(?=[A-Za-z0-9])", re.I)
_HOST = rf"[A-Za-z0-9-]+(?:[.{_MARK}][A-Za-z0-9-]+)*"
_AT_RULE = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?:{_SPACE}*[\[({{<]{_SPACE}*(?:{_ATS}|@){_SPACE}*[\])}}>]{_SPACE}*(?={_HOST}[.{_MARK}])|(?:{_SPACE}+@{_SPACE}*|@{_SPACE}+)(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*{_MARK})|(?:{_SPACE}+(?:{_ATS}){_SPACE}+|[_-](?:{_ATS})[_-])(?=[A-Za-z0-9-]+(?:[.{_MARK}][A-Za-z0-9-]+)*{_MARK}(?:{_LAST})(?![A-Za-z0-9]))|(?:{_SPACE}+@{_SPACE}*|@{_SPACE}+)(?={_HOST}\.[A-Za-z]))", re.I)


@lru_cache(1 << 16)
def _plain_char(c: str) -> str:
    """What a character looks like: itself, a plain character, or nothing if it is invisible."""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Pd" or c == "−":
        return "-"
    if kind == "Zs":
        return " "
    if c in "。｡":
        return "."
    seen = unicodedata.normalize("NFKC", c)
    if seen.isascii():
        return seen
    value = unicodedata.digit(c, None)
    return c if value is None else str(value)


def _runs(text: str) -> list[tuple[int, int]]:
    """Runs of at least four digits with a spelled one among them."""
    return [m.span() for m in _RUN.finditer(text) if _WORD.search(m[0])]


def _touched(text: str) -> bool:
    """Whether any transducer changes the text: the first one to do so sees it as it was written."""
    if not text.isascii() and (_MARK in text or any(_plain_char(c) != c for c in set(text) if c >= "\x80")):
        return True
    if _PLUS_RULE.search(text) or _DASH_RULE.search(text) or _DOT_RULE.search(text):
        return True
    # Without a mark, which is a change already, an "at" takes its sign or a bracket.
    if any(c in text for c in "@[({<") and _AT_RULE.search(text):
        return True
    return bool(_runs(text))


class Tape:
    """A rewritten text; ``start[i]`` and ``end[i]`` are the source span of its character i."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def characters(self) -> None:
        out, start, end = [], [], []
        for i, c in enumerate(self.text):
            seen = c if c < "\x80" else _plain_char(c)
            out.append(seen)
            start += [self.start[i]] * len(seen)
            end += [self.end[i]] * len(seen)
        self.text, self.start, self.end = "".join(out), start, end

    def rewrite(self, rule: re.Pattern, by) -> None:
        """Writes by(match) for each match; all its characters stand for the whole match."""
        out, start, end, at = [], [], [], 0
        for m in rule.finditer(self.text):
            new = by(m)
            out += [self.text[at : m.start()], new]
            start += self.start[at : m.start()] + [self.start[m.start()]] * len(new)
            end += self.end[at : m.start()] + [self.end[m.end() - 1]] * len(new)
            at = m.end()
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end = start + self.start[at:], end + self.end[at:]

    def spelled(self) -> None:
        """Digits in words, only within runs of at least four; then what parts them goes. Each run is taken out once and put back once."""
        out, start, end, at = [], [], [], 0
        for a, b in _runs(self.text):
            part = Tape("")
            part.text, part.start, part.end = self.text[a:b], self.start[a:b], self.end[a:b]
            part.rewrite(_WORD, lambda m: str(_SPELLED[m[0].lower()]))
            part.rewrite(_JOIN, lambda m: "")
            out += [self.text[at:a], part.text]
            start += self.start[at:a] + part.start
            end += self.end[at:a] + part.end
            at = b
        if at:
            self.text = "".join(out) + self.text[at:]
            self.start, self.end = start + self.start[at:], end + self.end[at:]

    def normalise(self) -> Tape:
        if not self.text.isascii():
            self.characters()
        self.spelled()
        self.rewrite(_PLUS_RULE, lambda m: "+")
        self.rewrite(_DASH_RULE, lambda m: "-")
        self.rewrite(_DOT_RULE, lambda m: _MARK)
        self.rewrite(_AT_RULE, lambda m: "@")
        self.text = self.text.replace(_MARK, ".")
        return self

    def source(self, a: int, b: int) -> tuple[int, int]:
        return min(self.start[a:b]), max(self.end[a:b])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[tuple[str, int, int]]:
    """The base spans: leftmost, not overlapping within a kind; in the order of KINDS, then by start."""
    found: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", i, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that only the rewritten text shows; none overlaps a base span of its kind."""
    if not _touched(text):
        return []
    tape = Tape(text).normalise()
    if tape.text == text:
        return []
    added = []
    for kind, a, b in detect(tape.text):
        a, b = tape.source(a, b)
        if not any(k == kind and a < e and s < b for k, s, e in base):
            added.append((kind, a, b))
    return added


def find(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, of a text."""
    base = detect(text or "")
    added = disguised(text, base) if text else []
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = "doc_id long, base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for every row of docs. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            both = [find(t) for t in batch.column("text").to_pylist()]
            cols = [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in x[i]] for x in both], _SPAN) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], ["doc_id", "base", "spans"])

    src = plain(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(src, run, _SCHEMA)
