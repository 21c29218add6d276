"""Personal data in plain and disguised writing, with offsets into the source text.

Plain identifiers (email, ip, card, phone) are found in the source itself. A
transducer then rewrites the source: homoglyphs and digits of other scripts become
ASCII, zero-width characters vanish, spelled digits become digits, and bracketed or
spelled "at" and "dot" become signs. It keeps, for each character written, the
source span it came from. Identifiers found in the rewritten text are mapped back
to source spans, and those that overlap no plain span of their kind are added.

Cases: a null or empty text has no spans. Spans are code point offsets, end
exclusive. Whole texts are read, of any length, in time linear in the length.
Repeated rows give repeated results; extra columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wayfold.llm.frames import text_batches

KINDS = ("email", "ip", "card", "phone")

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαικνορυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcyxijshdqwABEKMHOPCTXIJSaiknopuxABEZHIKMNOPTYX",
        strict=True,
    )
)
# Digit words of the four languages that the corpus holds.
_DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Characters without width.
_WIDTHLESS = "​‌‍⁠﻿­"


def _folds() -> dict[int, str]:
    """One character to one ASCII character: look-alikes, and whatever compatibility folding takes there."""
    table = {ord(k): v for k, v in _LOOKALIKES.items()}
    for block in (range(0x2070, 0x20A0), range(0x2460, 0x24EB), range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)):
        for code in block:
            folded = unicodedata.normalize("NFKC", chr(code))
            if len(folded) == 1 and folded.isascii() and folded.isprintable():
                table[code] = folded
    for code in range(0x0660, 0x1E960):
        if chr(code).isdecimal():
            table.setdefault(code, str(unicodedata.decimal(chr(code))))
    return table


_FOLDS = _folds()
_FOLDED = frozenset(map(chr, _FOLDS)) | frozenset(_WIDTHLESS)
_BEYOND_LATIN = re.compile("[\u00ad\u0250-\U0010ffff]")  # all that is folded lies there

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)+")  # a run of digits is read from its beginning or not at all
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each sign is tried once: the run of local characters before it, the domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = 0
        if start < at and (m := _EMAIL_DOMAIN.match(text, at + 1)):
            end = last = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m[0].split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


_FINDERS = (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones))


def plain(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the identifiers written plainly, by start and kind."""
    found = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    if _TWO_DIGITS.search(text):
        for kind, find in _FINDERS[1:]:
            found += [(a, b, kind) for a, b in find(text)]
    return _ordered(found)


_TWO_DIGITS = re.compile(r"[0-9][ ().-]*[0-9]")


def _ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_DIGIT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
#: What the transducer rewrites, in order of preference at a place: a bracketed "at"
#: or "dot"; a spelled "dot" between words or numbers; a run of at least two spelled
#: digits, or one that touches digits; "plus" before digits. Blanks before a bracket are tried
#: from where their run begins or not at all, so a long run is read once.
_REWRITES = re.compile(
    r"(?P<at>(?:(?<!\s)\s*|(?<=\s))[\[({<]\s*(?:at|@|arroba|arobase)\s*[\])}>]\s*)"
    r"|(?P<dot>(?:(?<!\s)\s*|(?<=\s))[\[({<]\s*(?:dot|\.|punkt|point|punto)\s*[\])}>]\s*)"
    r"|(?P<wordat>(?<=[a-z0-9])\s+at\s+(?=[a-z0-9-]+(?:\s*[\[({<]\s*dot\s*[\])}>]\s*|\s+dot\s+)[a-z0-9]))"
    r"|(?P<worddot>(?<=[a-z0-9])\s+(?:dot|punkt|punto)\s+(?=[a-z0-9]))"
    rf"|(?P<plus>\bplus[\s-]+(?=(?:{_DIGIT}|[0-9])\b))"
    rf"|(?P<digits>(?<![^\W_])(?:{_DIGIT})(?:[\s,-]{{1,2}}(?:{_DIGIT}))+(?![^\W_]))"
    rf"|(?P<digit>(?<=[0-9][\s.-])(?:{_DIGIT})(?![^\W_])|(?<![^\W_])(?:{_DIGIT})(?=[\s.-][0-9]))",
    re.IGNORECASE,
)
#: Signs of a rewrite, cheap to look for: spelled signs, and what may stand around them.
_SIGN_MARKS = ("(at", "[at", "{at", "<at", "( at", "[ at", "{ at", "< at", "(@", "[@", "{@", "<@", "arroba", "arobase", "dot", "(.", "[.", "{.", "<.", "punkt", "point", "punto", "plus")
_SIGN_MARK = re.compile(r"[\[({<]\s*(?:at|@|dot|arroba|arobase|\.|punkt|point|punto)\s*[\])}>]|\s(?:dot|punkt|punto)\s|\bplus\b")
_DIGIT_SET = frozenset(_DIGIT_WORDS)
_AROUND = "!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"
_DIGIT_FORMS = _DIGIT_SET | {before + w + after for w in _DIGIT_WORDS for before in ("", *"([{<\"'") for after in ("", *")]}>\"':;!?")}


def _spelled(low: str) -> bool:
    """Whether a digit word stands beside another or beside a digit."""
    words = low.replace(",", " ").replace(".", " ").replace("-", " ").split()
    if _DIGIT_FORMS.isdisjoint(words):
        return False
    words = [w.strip(_AROUND) for w in words]
    last_word = last_digit = False
    for w in words:
        word, digit = w in _DIGIT_SET, w[-1:].isdigit() or w[:1].isdigit()
        if word and (last_word or last_digit) or digit and last_word:
            return True
        last_word, last_digit = word, digit
    return False


def _marked(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in _SIGN_MARKS) and _SIGN_MARK.search(low) is not None or _spelled(low)


_ONE_DIGIT = re.compile(_DIGIT, re.IGNORECASE)


def rewrite(text: str) -> tuple[str, list[int], list[int]] | None:
    """The normalised text with each character's source start and end; None where nothing changes."""
    folded, starts = text, None
    if _BEYOND_LATIN.search(text) and not _FOLDED.isdisjoint(text):
        folded = text.translate(_FOLDS)
        if any(c in folded for c in _WIDTHLESS):
            kept = [k for k, c in enumerate(folded) if c not in _WIDTHLESS]
            folded, starts = "".join([folded[k] for k in kept]), kept
    if not _marked(folded):
        if folded == text:
            return None
        begin = starts if starts is not None else list(range(len(folded)))
        return folded, begin, [k + 1 for k in begin]
    begin = starts if starts is not None else list(range(len(folded)))
    out: list[str] = []
    at: list[int] = []
    to: list[int] = []
    last = 0
    for m in _REWRITES.finditer(folded):
        a, b = m.span()
        out.append(folded[last:a])
        at += begin[last:a]
        to += [k + 1 for k in begin[last:a]]
        if m.lastgroup == "digits":
            for d in _ONE_DIGIT.finditer(folded, a, b):
                out.append(_DIGIT_WORDS[d[0].lower()])
                at.append(begin[d.start()])
                to.append(begin[d.end() - 1] + 1)
        else:
            new = {"at": "@", "wordat": "@", "dot": ".", "worddot": ".", "plus": "+"}.get(m.lastgroup or "") or _DIGIT_WORDS[m[0].lower()]
            out.append(new)
            at.append(begin[a])
            to.append(begin[b - 1] + 1)
        last = b
    out.append(folded[last:])
    at += begin[last:]
    to += [k + 1 for k in begin[last:]]
    return "".join(out), at, to


def disguised(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only the rewritten text shows, in source offsets."""
    if (got := rewrite(text)) is None:
        return []
    new, at, to = got
    starts = {kind: [a for a, _, k in base if k == kind] for kind in KINDS}  # in order; plain spans of a kind don't overlap
    ends = {kind: [b for _, b, k in base if k == kind] for kind in KINDS}
    more = []
    for a, b, kind in plain(new):
        span = (at[a], to[b - 1])
        before = bisect_left(starts[kind], span[1])  # of the spans that begin before this one ends, the last reaches farthest
        if not before or ends[kind][before - 1] <= span[0]:
            more.append((*span, kind))
    return more


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join([f"{kind}:{a}:{b}" for a, b, kind in spans])


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of plain identifiers, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = plain(text or "")
                more = disguised(text or "", base)
                n = [sum(s[2] == kind for s in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(_ordered(base + more)), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with every span, plain or disguised, replaced by its kind in brackets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = plain(text)
                parts, last = [], 0
                for a, b, kind in _ordered(base + disguised(text, base)):
                    if a >= last:
                        parts += [text[last:a], f"[{kind}]"]
                    last = max(last, b)
                out.append("".join([*parts, text[last:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return text_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, text string")
