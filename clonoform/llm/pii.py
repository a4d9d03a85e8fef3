"""Personal data by offset-preserving deobfuscation.

Three transducers normalise a text: homoglyphs, spelled digits, and at/dot disguises. Each
is a list of edits; the composed edits map a span of the normalised text back to the
characters it came from. Base identifiers are found in the text as it is; the normalised
text only adds spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import spans_text

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Each match has one "@"; its local part is the run of local characters before it."""
    out, free = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end(), "email"))
            free = m.end()
    return out


def find_identifiers(text: str) -> list[tuple[int, int, str]]:
    """Base spans: leftmost and non-overlapping per kind; failing matches are dropped."""
    out = _emails(text)
    for m in _DIGITS.finditer(text):
        if m.group(1) and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


class Rewriting:
    """A text after edits, and the way back to the characters of the source."""

    def __init__(self, text: str):
        self.text = text
        self.layers: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply ascending, disjoint edits (start, end, replacement)."""
        if not edits:
            return
        parts, at, now, spans = [], 0, 0, []
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            now += start - at
            spans.append((now, now + len(new), start, end))
            now += len(new)
            at = end
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.layers.append(([s[0] for s in spans], spans))

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a span of the text, and whether an edit lies in it."""
        touched = False
        for keys, spans in reversed(self.layers):
            # edits of one character to one keep the place; others give their whole source
            def back(p: int, last: bool, keys=keys, spans=spans) -> int:
                i = bisect_right(keys, p) - 1
                if i < 0:
                    return p
                a, b, s, e = spans[i]
                if p < b:
                    return e - 1 if last else s
                return p - b + e

            lo = bisect_right(keys, start - 1)
            touched = touched or (lo < len(keys) and keys[lo] < end) or (lo > 0 and spans[lo - 1][1] > start)
            start, end = back(start, False), back(end - 1, True) + 1
        return start, end, touched


#: Letters that look like an ASCII letter or digit.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅαεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ＠．。․‐‑‒–—−",
        "aeopcyxijsdqwhABEKMHOPCTXIJSaeikvoptuxABEZHIKMNOPTYX@...------",
        strict=True,
    )
)
#: Characters without width.
_NO_WIDTH = "​‌‍⁠﻿­"
_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + _NO_WIDTH + "！-～٠-٩   ]")


def _homoglyph(c: str) -> str:
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in _NO_WIDTH:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    return str(ord(c) - 0x660) if "٠" <= c <= "٩" else " "


#: Spelled digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: A spelled dot.
_DOTS = r"(?:dot|punkt|point|punto)"
_STEP = rf"(?:[ ,-]{{1,2}}|[ ]{_DOTS}[ ])"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[ ])?(?:{_WORD}|[0-9]++)(?:{_STEP}(?:{_WORD}|[0-9]++))+(?![^\W_])", re.IGNORECASE)
_RUN_PART = re.compile(rf"(?P<plus>plus[ ])|(?P<dot>[ ]{_DOTS}[ ])|(?P<gap>[ ,-]{{1,2}})|(?P<word>{_WORD})|(?P<number>[0-9]+)", re.IGNORECASE)
#: What each run with three spelled parts has, in lower case; most texts have none.
_HINT = re.compile(rf"{_WORD}(?={_STEP}(?:{_WORD}|[0-9]))|[0-9](?=[ ]{_DOTS}[ ](?:{_WORD}|[0-9]))")

_AT = re.compile(r"\s*[\(\[\{<]\s*(?:at|@)\s*[\)\]\}>]\s*|\s+at\s+|\s*@\s*", re.IGNORECASE)
_DOT = r"(?:\s*[\(\[\{<]\s*(?:dot|\.)\s*[\)\]\}>]\s*|\s+dot\s+|\.)"
_DOT_ONLY = re.compile(_DOT, re.IGNORECASE)
_LOCAL_PART = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++)*+", re.IGNORECASE)
_DOMAIN_PART = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.IGNORECASE)
_AT_HINT = re.compile(r"[\(\[\{<]\s*(?:at|@|dot|\.)\s*[\)\]\}>]|\sdot\s", re.IGNORECASE)
#: Endings that let a bare "at" and "dot" in prose count as an address.
ENDINGS = frozenset("com org net edu gov mil int info biz dev app io ai co me tv eu de fr es uk us it nl ch at be pt pl se no fi dk ie br mx ar ca au in jp cn ru".split())

#: Those of them that are common words.
COMMON = frozenset("it me in at be no us de es se au".split())
_MARKED = re.compile(r"[0-9._+-]")
_BRACKET_DOT = r"[\(\[\{<]\s*(?:dot|\.)\s*[\)\]\}>]"
_BRACKET_IP = re.compile(rf"(?<![0-9.])[0-9]++(?:(?:\s*{_BRACKET_DOT}\s*|\.)[0-9]++){{3}}(?![0-9])", re.IGNORECASE)
_BETWEEN = re.compile(rf"\s*{_BRACKET_DOT}\s*", re.IGNORECASE)


def _bracketed_numbers(text: str) -> list[tuple[int, int, str]]:
    """Edits of the dots in brackets between the four numbers of an address."""
    return [(d.start(), d.end(), ".") for m in _BRACKET_IP.finditer(text) for d in _BETWEEN.finditer(text, m.start(), m.end())]


def _at_dot(text: str) -> list[tuple[int, int, str]]:
    """Edits inside addresses that write "at" or "dot" in words or brackets. A bare "at"
    counts only beside a spelled dot and before a known ending, so that prose stays; an ending
    that is a common word also needs a digit or a sign in the local part."""
    edits, place = [], 0
    while (local := _LOCAL_PART.search(text, place)) is not None:
        place = local.end()
        at = _AT.match(text, place)
        domain = _DOMAIN_PART.match(text, at.end()) if at else None
        if domain is None:
            continue
        place = domain.end()
        own = [(at.start(), at.end(), "@")]
        own += [(d.start(), d.end(), ".") for part in (local, domain) for d in _DOT_ONLY.finditer(text, part.start(), part.end())]
        bracket = re.search(r"[\(\[\{<]", at.group())
        spelled = any(text[a:b] != "." for a, b, n in own if n == ".")
        ending = domain.group().lower().split()[-1]
        if bracket or spelled and ending in ENDINGS and (ending not in COMMON or _MARKED.search(local.group())):
            edits += [e for e in own if text[e[0] : e[1]] != e[2]]
    return sorted(edits)


def _spelled(text: str, lists: bool = False) -> list[tuple[int, int, str]]:
    """Edits of the runs with at least three spelled parts (digits, dots, plus), word by word,
    so that any part of a run maps back to its own words. A space or hyphen beside a spelled
    digit goes. A comma ends a number, or with ``lists`` stands between the digits of one."""
    edits = []
    for m in _RUN.finditer(text):
        parts = [(x.lastgroup, x.start(), x.end(), x.group()) for x in _RUN_PART.finditer(text, m.start(), m.end())]
        digits = [DIGIT_WORDS.get(t.lower()) if k == "word" else None for k, _, _, t in parts]
        if sum(d is not None or k in ("plus", "dot") for (k, *_), d in zip(parts, digits, strict=True)) < 3:
            continue
        for i, (kind, start, end, own) in enumerate(parts):
            if kind == "plus":
                edits.append((start, end, "+"))
            elif kind == "dot":
                edits.append((start, end, "."))
            elif kind == "word" and digits[i] is not None:
                edits.append((start, end, digits[i]))
            elif kind == "gap" and (digits[i - 1] or digits[i + 1]):
                if own in (" ", "-"):
                    edits.append((start, end, ""))
                elif lists or "," not in own:
                    edits.append((start, end, " "))
    return edits


def normalise(text: str, lists: bool = False) -> Rewriting:
    """The three transducers, one after the other."""
    out = Rewriting(text)
    if not text.isascii():
        out.edit([(m.start(), m.end(), _homoglyph(m.group())) for m in _ODD.finditer(text)])
    low = out.text.lower()
    if any(not (m.start() and low[m.start() - 1].isalpha()) for m in _HINT.finditer(low)):
        out.edit(_spelled(out.text, lists))
    if _AT_HINT.search(out.text):
        out.edit(_at_dot(out.text))
        out.edit(_bracketed_numbers(out.text))
    return out


def find_pii(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of a text, in code points, end exclusive. An added span
    touches a normalised place and lies in no base span of its kind; it may hold one, as the
    base finds the plain end of an address whose start is disguised."""
    base = find_identifiers(text)
    plain = normalise(text)
    if not plain.layers:
        return base, []
    readings = [(plain, KINDS)]
    if "," in text:
        listed = normalise(text, lists=True)
        if listed.text != plain.text:
            readings.append((listed, ("card", "phone")))
    added: dict[tuple[int, int, str], None] = {}
    for reading, kinds in readings:
        for start, end, kind in find_identifiers(reading.text):
            if kind in kinds:
                a, b, touched = reading.source(start, end)
                if touched and not any(k == kind and s <= a and b <= e for s, e, k in base):
                    added[a, b, kind] = None
    return base, list(added)


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans and
    n_added with the spans that deobfuscation adds.

    Null text counts as empty; null ``doc_id`` stays null; repeated rows are scanned each;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 500):
                found = [find_pii(t or "") for t in texts.slice(lo, 500).to_pylist()]
                columns = [ids.slice(lo, 500)]
                columns += [pa.array([sum(s[2] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
                columns.append(pa.array([hashlib.sha256(spans_text(b, KINDS).encode()).hexdigest() for b, _ in found], pa.string()))
                columns.append(pa.array([spans_text(b + a, KINDS) for b, a in found], pa.string()))
                columns.append(pa.array([len(a) for _, a in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
