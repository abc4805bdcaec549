"""Personal data, disguised or not, with spans in the source text.

Plain identifiers (email, ip, card, phone) are matched on the text itself. Then a chain of small transducers
rewrites a text: homoglyphs and invisible characters, spelled digits, at/dot disguises. Each rewriting keeps, for every
output character, the source span it came from, so identifiers found in the normalised text are mapped back. Plain
spans always stay; a disguised one is added where it overlaps no plain span, or holds each that it overlaps and is longer.

Defined results: null and empty texts have no spans; spans count code points, end exclusive; equal rows give equal rows; an
empty table gives no rows; columns named like the results, in any case, are replaced.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices, with_columns

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ---------------------------------------------------------------- plain identifiers

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits can only match from its start, so it is never tried from within
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from the at signs: an at sign is never part of a local name."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            floor = after = m.end()
        at = text.find("@", after)
        floor = max(floor, after if at < 0 else floor)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find(text: str) -> list[Span]:
    """Plain identifiers by start, then kind."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# ---------------------------------------------------------------- transducers

# Letters of other scripts that look like Latin ones, and spelled digits.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһкмтвнАВЕКМНОРСТХУІЅЈαοινκρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmtbhABEKMHOPCTXYISJaoivkptuABEZHIKMNOPTYX", strict=True))
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:{_WORD}|[0-9])(?:(?:[ ,]|, |-|\s*\bdot\b\s*)(?:{_WORD}|[0-9])(?!\w))+")
_SPELLED_PART = re.compile(rf"(?i){_WORD}|[0-9]|dot")
_PLUS = re.compile(rf"(?i)(?<!\w)plus(?=[ -]?(?:[0-9]|{_WORD})(?!\w[a-z]))[ -]?")
# begins at the bracket: a run of spaces is never tried from each of its places
_BRACKET_AT = re.compile(r"(?i)[\[({<]\s*(?:at|arroba|@)\s*[\])}>]\s*")
_BRACKET_DOT = re.compile(r"(?i)[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]\s*")
_SPOKEN = re.compile(
    r"(?i)(?<=[A-Za-z0-9])\s+(?:at|arroba)\s+(?=[A-Za-z0-9-]+(?:(?:\s+(?:dot|punkt|punto)\s+|\.)[A-Za-z0-9-]+)*\s+(?:dot|punkt|punto)\s+[A-Za-z]{2,}(?![A-Za-z0-9]))"
)
_SPOKEN_DOT = re.compile(r"(?i)(?<=[A-Za-z0-9])\s+(?:dot|punkt|punto)\s+(?=[A-Za-z0-9])")


class Traced:
    """A text and, for each character, the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1

    def replace(self, found: list[tuple[int, int, str]]) -> None:
        """Rewrites disjoint ranges, in order; every new character stands for its whole range."""
        if not found:
            return
        text, start, end, last = [], [], [], 0
        for a, b, new in found:
            text += [self.text[last:a], new]
            start += [self.start[last:a], np.full(len(new), self.start[a])]
            end += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        text.append(self.text[last:])
        self.text = "".join(text)
        self.start = np.concatenate([*start, self.start[last:]]).astype(np.int64)
        self.end = np.concatenate([*end, self.end[last:]]).astype(np.int64)


def _glyphs(text: str) -> list[tuple[int, int, str]]:
    out = []
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        new = _LOOKALIKE.get(c)
        if new is None:
            if "！" <= c <= "～":
                new = chr(ord(c) - 0xFEE0)
            elif unicodedata.category(c) == "Cf":
                new = ""
            elif unicodedata.category(c) == "Nd":
                new = str(unicodedata.digit(c))
            elif c in "․。．·":
                new = "."
            elif unicodedata.category(c) in ("Zs", "Pd"):
                new = " " if unicodedata.category(c) == "Zs" else "-"
        if new is not None and new != c:
            out.append((i, i + 1, new))
    return out


def _digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _SPELLED.finditer(text):
        parts = [(p.start(), p.end(), p[0].lower()) for p in _SPELLED_PART.finditer(m[0])]
        if sum(p not in "0123456789" for _, _, p in parts) < 3:
            continue  # digits as such are left to the plain patterns
        # each word becomes its digit; the gap after it belongs to the word before
        for i, (a, b, p) in enumerate(parts):
            stop = parts[i + 1][0] if i + 1 < len(parts) else b
            out.append((m.start() + a, m.start() + stop, "." if p == "dot" else _DIGIT_WORDS.get(p, p)))
    return out


def _bracketed(pattern: re.Pattern, text: str, new: str) -> list[tuple[int, int, str]]:
    """Matches with the white space before them."""
    out, floor = [], 0
    for m in pattern.finditer(text):
        a = m.start()
        while a > floor and text[a - 1].isspace():
            a -= 1
        floor = m.end()
        out.append((a, floor, new))
    return out


def normalise(text: str) -> Traced:
    out = Traced(text)
    out.replace(_glyphs(out.text))
    out.replace(_bracketed(_BRACKET_AT, out.text, "@"))
    out.replace(_bracketed(_BRACKET_DOT, out.text, "."))
    spoken = [(m.start(), m.end(), "@") for m in _SPOKEN.finditer(out.text)]
    out.replace(spoken)
    if "@" in out.text:
        # spoken dots count in the words after an at sign only
        found, floor = [], 0
        for at in re.finditer("@", out.text):
            at = at.start()
            while m := re.compile(r"[A-Za-z0-9.-]*").match(out.text, max(at + 1, floor)):
                dot = _SPOKEN_DOT.match(out.text, m.end())
                if not dot:
                    break
                found.append((dot.start(), dot.end(), "."))
                floor = dot.end()
        out.replace(found)
    out.replace([(m.start(), m.end(), "+") for m in _PLUS.finditer(out.text)])
    out.replace(_digits(out.text))
    return out


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Further spans of the source, found in the normalised text; none overlaps another of its kind, or a plain one unless it
    holds that whole and is longer (a plain match of the rest of a disguised name)."""
    traced = normalise(text)
    if traced.text == text:
        return []
    out: list[Span] = []
    # spans of a kind are apart and in order, so those that a span meets follow each other
    by_kind = {k: [x for x in plain if x[0] == k] for k in KINDS}
    ends = {k: [e for _, _, e in x] for k, x in by_kind.items()}
    last = dict.fromkeys(KINDS, 0)
    for kind, a, b in find(traced.text):
        start, end = int(traced.start[a]), int(traced.end[b - 1])
        # the gap swallowed after a spelled digit isn't part of the identifier
        while end > start and text[end - 1].isspace():
            end -= 1
        apart = start >= last[kind]
        for k in KINDS if apart else ():
            for i in range(bisect_right(ends[k], start), len(ends[k])):
                _, s, e = by_kind[k][i]
                if s >= end:
                    break
                apart = start <= s and e <= end and e - s < end - start
                if not apart:
                    break
            if not apart:
                break
        if apart:
            out.append((kind, start, end))
            last[kind] = end
    return out


# ---------------------------------------------------------------- operator

# A text without any of these, and without characters that _glyphs rewrites, is left as it is by normalise.
_TRIGGER = re.compile(
    rf"(?i)[\[({{<]\s*(?:at|arroba|@|dot|punkt|point|punto|\.)\s*[\])}}>]|\s(?:dot|punkt|punto)\s|{_PLUS.pattern.removeprefix('(?i)')}"
    rf"|(?<!\w)(?:(?:{_WORD})(?:[ ,]|, |-)(?:{_WORD}|[0-9])|[0-9](?:[ ,]|, |-)(?:{_WORD}))(?!\w)"
)
_LEADS = np.zeros(256, dtype=bool)
#: first bytes of all characters that _glyphs rewrites; a test holds them against every code point
_LEADS[[0xC2, *range(0xCE, 0xD3), 0xD4, 0xD6, 0xD8, 0xD9, 0xDB, 0xDC, 0xDF, *range(0xE0, 0xE4), 0xEA, 0xEF, 0xF0, 0xF3]] = True
_WATCH = np.zeros(256, dtype=bool)
_WATCH[[*range(48, 58), 64]] = True

FIELDS = [
    *(T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS),
    T.StructField("base_spans", T.StringType(), False),
    T.StructField("base_sha256", T.StringType(), False),
    T.StructField("spans", T.StringType(), False),
]


def _join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: str, watched: bool, odd: bool) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans); watched: has a digit or an at sign, odd: has characters of a homoglyph block."""
    base = find(text) if watched else []
    if odd or _TRIGGER.search(text):
        more = disguised(text, base)
        if more:
            return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
    return base, base


def personal_data(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with counts of plain spans by kind, their list and digest, and the list of all spans."""
    nothing = hashlib.sha256(b"").hexdigest()

    def make(col: pa.Array) -> list[pa.Array]:
        watched, odd = np.zeros(len(col), bool), np.zeros(len(col), bool)
        for lo, hi, data, offs in text_slices(col):
            for out, mask in ((watched, _WATCH), (odd, _LEADS)):
                sums = np.concatenate([[0], np.cumsum(mask[data])])
                out[lo:hi] = sums[offs[1:]] > sums[offs[:-1]]
        rows = []
        for text, w, o in zip(col.to_pylist(), watched.tolist(), odd.tolist()):
            base, every = scan(text, w, o)
            if not every:
                rows.append((0, 0, 0, 0, "", nothing, ""))
                continue
            joined = _join(base)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), joined, hashlib.sha256(joined.encode()).hexdigest(), _join(every)))
        columns = list(zip(*rows))
        return [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(columns)]

    return with_columns(docs, FIELDS, make)
