"""Personal data: spans of e-mail addresses, IPv4 addresses, card and phone numbers, plain and disguised."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# possessive: a run of digits is tried once from its first digit, so no text is slow
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]|\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Each @ is looked at once: to its left the run of local characters since the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            out.append((start, end))
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of what the base patterns find; matches that fail their test are dropped."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _HAS_DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


# Look-alike characters and the ASCII ones they stand for; full-width forms, other decimal digits follow a rule.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ѵ": "v", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", "．": ".", "·": ".", "﹒": ".", "﹫": "@", "＠": "@", "﹢": "+", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: Characters that are not seen and are left out.
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits and signs.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "dash": "-", "hyphen": "-"}


def _ascii_of(c: str) -> str | None:
    """What a character stands for; None: itself."""
    import unicodedata

    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.decimal(c, None)
    return str(d) if d is not None and not c.isascii() else None


_STANDS: dict[str, str | None] = {}


class Traced:
    """A text that has been rewritten, with the source characters [start, end) that each of its characters comes from."""

    def __init__(self, text: str, start: np.ndarray, end: np.ndarray, changed: np.ndarray):
        self.text, self.start, self.end, self.changed = text, start, end, changed

    @classmethod
    def of(cls, text: str) -> Traced:
        n = np.arange(len(text))
        return cls(text, n, n + 1, np.zeros(len(text), dtype=bool))

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Traced:
        """With each [start, end) of the text replaced, in order; every new character comes from the whole place it replaces."""
        if not edits:
            return self
        text, start, end, changed, at = [], [], [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            start += [self.start[at:s], np.full(len(new), self.start[s])]
            end += [self.end[at:s], np.full(len(new), self.end[e - 1])]
            changed += [self.changed[at:s], np.ones(len(new), dtype=bool)]
            at = e
        text.append(self.text[at:])
        start.append(self.start[at:])
        end.append(self.end[at:])
        changed.append(self.changed[at:])
        return Traced("".join(text), np.concatenate(start), np.concatenate(end), np.concatenate(changed))

    def source(self, s: int, e: int) -> tuple[int, int]:
        return int(self.start[s]), int(self.end[e - 1])


def plain_letters(t: Traced) -> Traced:
    """First transducer: look-alike characters to ASCII, unseen ones left out. Accented letters stay."""
    for c in set(t.text) - _STANDS.keys():
        _STANDS[c] = None if c.isascii() else _ascii_of(c)
    odd = [c for c in set(t.text) if _STANDS[c] is not None]
    if not odd:
        return t
    return t.rewritten([(m.start(), m.end(), _STANDS[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", t.text)])


_UNIT = "(?:" + "|".join(sorted([*DIGITS, *SIGNS], key=len, reverse=True)) + "|double|triple|\\+|[0-9])"
_GAP = r"(?:[\x20,./-]{1,3})"
_SPELLED_RUN = re.compile(rf"(?<![A-Za-z0-9]){_UNIT}(?:{_GAP}?{_UNIT}(?![A-Za-z]))+", re.I)
# a spelled digit beside a digit, a sign, a multiplier or another spelled digit
_SPELLED = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED_SEEN = re.compile(rf"\b{_SPELLED}\b[\x20,./-]{{1,3}}(?:[0-9]|(?:{_SPELLED}|plus|dot|point|dash|hyphen|double|triple)\b)|(?:[0-9+]|\b(?:plus|dot|point|dash|hyphen|double|triple))[\x20,./-]{{1,3}}{_SPELLED}\b|\+{_SPELLED}\b", re.I)
#: Spelled digits from which a run reads as one number whatever stands between them.
SURE = 4
_TOKEN = re.compile(r"[A-Za-z]+|[0-9+]|[^A-Za-z0-9+]+")


def plain_digits(t: Traced) -> Traced:
    """Second transducer: runs of spelled digits and signs ('plus four four two zero ...') to the characters they name.

    Between two spelled or plain digits the gap is dropped, so that a run reads as one number. A run with fewer than SURE
    spelled digits keeps its full stops and ends where a stop or comma is followed by a blank, as in prose; whether it
    is a number is up to the tests of the base patterns.
    """
    if not _SPELLED_SEEN.search(t.text):
        return t
    edits = []
    for m in _SPELLED_RUN.finditer(t.text):
        tokens = [(x.start() + m.start(), x.end() + m.start(), x[0].lower()) for x in _TOKEN.finditer(m[0])]
        times, n = 1, 0
        for _, _, w in tokens:
            n += times * (w in DIGITS)
            times = 2 + (w == "triple") if w in ("double", "triple") else 1 if w.isalnum() else times
        if not n:
            continue
        times, at = 1, None
        for s, e, w in tokens:
            if w in ("double", "triple"):
                times, at = 2 + (w == "triple"), s
            elif w in DIGITS or w in SIGNS or at is not None and w.isdigit():
                edits.append((s if at is None else at, e, (DIGITS.get(w) or SIGNS.get(w) or w) * times))
                times, at = 1, None
            elif not w.isalnum() and w != "+":
                if at is None and (n >= SURE or w != "." and not (w[0] in ".,/" and w[-1] == " ")):
                    edits.append((s, e, ""))
    return t.rewritten(edits)


_DIGIT_DOT = re.compile(r"(?<=[0-9])(?:\x20?[\[({<]\x20?(?:dot|punkt|point|punto|\.)\x20?[\])}>]\x20?|\x20(?:dot|point)\x20)(?=[0-9])", re.I)


def plain_dots(t: Traced) -> Traced:
    """Spelled and bracketed dots between digits ('192 dot 168', '192[.]168') to dots."""
    return t.rewritten([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(t.text)])


_AT = r"(?:\x20?[\[({<]\x20?(?:at|@)\x20?[\])}>]\x20?|\x20(?:at)\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[({<]\x20?(?:dot|punkt|point|punto|\.)\x20?[\])}>]\x20?|\x20(?:dot)\x20|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.I)
_DOT_BEFORE = re.compile(rf"{_DOT}\Z", re.I)
#: Characters of the longest dot that _DOT knows.
_DOT_WIDTH = 12
_LABEL_CHARS = _LOCAL_CHARS - {"."}
_AT_ONE, _DOT_ONE = re.compile(_AT, re.I), re.compile(_DOT, re.I)
_AT_SEEN = re.compile(r"[\[({<]\x20?(?:at|@)\x20?[\])}>]|[\x20\])}>]dot[\x20\[({<]|[\[({<]\x20?(?:dot|punkt|point|punto|\.)\x20?[\])}>]|@|[A-Za-z0-9_%+-]\x20at\x20[A-Za-z0-9-]+\.[A-Za-z0-9]", re.I)
_BRACKET_AT = re.compile(r"[\[({<]\x20?(?:at|@)\x20?[\])}>]|@", re.I)
_MAILBOX = re.compile(r"[0-9._%+-]")
_DOTTED = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
_WORD_DOT = re.compile(r"\x20dot\x20|[\[({<]\x20?(?:dot|punkt|point|punto|\.)\x20?[\])}>]", re.I)


def _local_start(text: str, end: int) -> int:
    """Where the local part that ends at `end` begins, through spelled dots as well; `end` if there is none."""
    start, at = end, end
    while True:
        while at > 0 and text[at - 1] in _LABEL_CHARS:
            at -= 1
        if at == start or at == end:
            return start
        start = at
        dot = _DOT_BEFORE.search(text, max(0, at - _DOT_WIDTH), at)
        if dot is None:
            return start
        at = end = dot.start()


def plain_addresses(t: Traced) -> Traced:
    """Third transducer: 'name (at) host [dot] tld' and 'name at host dot tld' to name@host.tld. A bare ' at ' needs a spelled dot
    after it, or a dotted host whose last part is letters and a name that reads as a mailbox ('john.doe at example.com'),
    so that prose ('look at example.com') stays as it is."""
    if not _AT_SEEN.search(t.text):
        return t
    edits = []
    for hit in _AT_ONE.finditer(t.text):
        host = _HOST.match(t.text, hit.end())
        start = _local_start(t.text, hit.start()) if host else hit.start()
        if start == hit.start():
            continue
        left, right = t.text[start:hit.start()], host[0]
        spelled = _WORD_DOT.search(right)
        if not _BRACKET_AT.search(hit[0]) and not spelled and not (_MAILBOX.search(left) and _DOTTED.match(right)):
            continue
        if hit[0] == "@" and not spelled and not _WORD_DOT.search(left):
            continue
        # a spelled dot joins what stands left of the at sign only if it is bracketed or a word between words there
        for part, off in ((left, start), (right, hit.end())):
            edits += [(off + d.start(), off + d.end(), ".") for d in _DOT_ONE.finditer(part) if d[0] != "."]
        if hit[0] != "@":
            edits.append((hit.start(), hit.end(), "@"))
    edits = sorted(set(edits))
    clean, last = [], 0
    for e in edits:
        if e[0] >= last:
            clean.append(e)
            last = e[1]
    return t.rewritten(clean)


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What the base patterns find in the normalised text, mapped back to source characters; only spans with a rewritten
    character, and none that lies inside a base span of its kind."""
    t = Traced.of(text) if not text.isascii() or _AT_SEEN.search(text) or _SPELLED_SEEN.search(text) or _DIGIT_DOT.search(text) else None
    if t is None:
        return []
    t0 = t
    t = plain_letters(t)
    t = plain_addresses(plain_dots(plain_digits(t)))
    if t is t0:
        return []
    out = []
    for s, kind, e in base_spans(t.text):
        if t.changed[s:e].any():
            a, b = t.source(s, e)
            if not any(k == kind and x <= a and b <= y for x, k, y in base):
                out.append((a, kind, b))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) of a text; null is empty."""
    text = text or ""
    base = base_spans(text)
    return base, added_spans(text, base)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _found(batches):
    for b in batches:
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            base, added = scan(text.as_py())
            rows.append((doc, *[sum(k == kind for _, k, _ in base) for kind in range(4)], hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
        cols = zip(*rows, strict=True) if rows else [[]] * 8
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts and digest of the base spans, all spans as text, and how many the method added.

    n_email, n_ip, n_card, n_phone and base_sha256 are those of the base patterns; spans also has what only the
    normalised text shows. Null and empty texts have none; repeated rows give a row each; other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_found, _OUT)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if text is None:
        return None
    base, added = scan(text)
    if not base and not added:
        return text
    merged: list[list[int]] = []
    for s, k, e in sorted(base + added):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced by [EMAIL], [IP], [CARD] or [PHONE]; all columns stay."""

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        return pa.array([mask(x.as_py()) for x in texts], pa.string())

    return docs.withColumn(text_col, cleaned(F.col(f"`{text_col}`").cast("string")))
