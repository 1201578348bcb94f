"""Personal data in texts, disguised or plain, with offsets into the source.

Plain identifiers are found by fixed patterns.  For disguised ones, a transducer rewrites
the whole text: look-alike letters and digits become ASCII, spelled digits become digits,
words and brackets for @, dot and + become those signs.  Most of a text passes unchanged;
the rewritten text is kept as runs that each remember the source characters they came
from, so an identifier found in it is mapped back, whatever its length.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# The base forms of the contract, in linear-time equivalents.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, led by the @ signs: a match starts where the
    run of local characters before its @ starts, or where the last match ended."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers in their base forms, by start and then kind."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


# Look-alikes of ASCII letters and digits that compatibility
# decomposition does not resolve (Cyrillic and Greek), pairs of look-alike and letter.
_PAIRS = "аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS οo νv ιi κk αa ρp υu ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
_LOOKS = {p[0]: p[1] for p in _PAIRS.split(" ")}
# Spelled digits and disguises of signs.
_DIGITS = {w: str(i) for i, words in enumerate(
    ("zero oh null cero zéro", "one eins uno un", "two zwei dos deux", "three drei tres trois", "four vier cuatro quatre",
     "five fünf cinco cinq", "six sechs seis", "seven sieben siete sept", "eight acht ocho huit", "nine neun nueve neuf")
) for w in words.split()}
_AT_WORDS = "at|arroba|arobase|klammeraffe"
_DOT_WORDS = "dot|punkt|punto|point"
_DASH_WORDS = "dash|hyphen|minus"
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
# Endings that make a name spelled with bare words ("x at y dot com") an address.
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co me tv ai app dev eu uk de fr es it nl be ch at pl pt se no fi dk cz ru ua jp cn in br mx ar cl ca au nz us test example".split())
_SPELLED = "|".join(sorted(_DIGITS, key=len, reverse=True))
#: What is rewritten, by kind.  Words count where no letter or digit touches them.
_TOKEN = re.compile(
    rf"{_OPEN}\s*+(?:(?P<at>{_AT_WORDS}|@)|(?P<dot>{_DOT_WORDS}|\.)|(?P<dash>{_DASH_WORDS}|-))\s*+{_CLOSE}"
    rf"|(?<![^\W_])(?:(?P<digit>{_SPELLED})|(?P<at_word>{_AT_WORDS})|(?P<dot_word>{_DOT_WORDS})|(?P<dash_word>{_DASH_WORDS})|(?P<plus>plus))(?![^\W_])"
    r"|(?P<skip>[\u200b-\u200d\u2060\ufeff\u00ad]+)",
    re.I,
)
_BLANK = re.compile(r"\s*+")
_BETWEEN = re.compile(r"[\s,]*+")
_NEXT_DIGIT = re.compile(rf"[0-9]|(?:{_SPELLED})(?![^\W_])", re.I)
_DOT = rf"(?:\.|\s++(?:{_DOT_WORDS})\s++|\s*+{_OPEN}\s*+(?:{_DOT_WORDS}|\.)\s*+{_CLOSE}\s*+)"
#: A dotted name after a bare word for @, that no @ follows.
_HOST = re.compile(rf"\s++([\w-]++(?:{_DOT}[\w-]++)+)(?!\s*+(?:@|{_OPEN}\s*+(?:{_AT_WORDS}|@)))", re.I)
_LAST_LABEL = re.compile(r"[\w-]+\Z")
_BARE = re.compile(rf"\s(?:{_AT_WORDS}|{_DOT_WORDS})\s", re.I)
_MARKED, _OPENED = re.compile(r"[0-9._+-]"), re.compile(_OPEN)
_DASHES, _DOTS = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "\u2024\u3002\uff0e"


@lru_cache(maxsize=1)
def _look_table() -> dict[int, str]:
    """ASCII forms of single characters: the fixed look-alikes, and every character whose
    compatibility decomposition is one ASCII character (full-width, mathematical, circled
    and raised letters and digits)."""
    table = {i: plain for i in range(0x80, sys.maxunicode + 1) if len(plain := unicodedata.normalize("NFKC", chr(i))) == 1 and plain.isascii()}
    table |= {ord(c): a for c, a in _LOOKS.items()}
    return table | {ord(c): "-" for c in _DASHES} | {ord(c): "." for c in _DOTS}


class _Rewritten:
    """A text in runs: each is copied from the source character by character, or stands
    for a source span as a whole."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, bool]] = []
        self.size = 0

    def add(self, shown: str, a: int, b: int, copied: bool) -> None:
        if shown:
            self.parts.append(shown)
            self.starts.append(self.size)
            self.spans.append((a, b, copied))
            self.size += len(shown)

    def last(self) -> str:
        return self.parts[-1][-1] if self.parts else ""

    def cut(self, drop: str) -> None:
        """Removes characters of `drop` from the end."""
        while self.parts:
            kept = self.parts[-1].rstrip(drop) if self.spans[-1][2] else self.parts[-1]
            gone = len(self.parts[-1]) - len(kept)
            if not gone:
                return
            self.size -= gone
            if kept:
                a, b, _ = self.spans[-1]
                self.parts[-1], self.spans[-1] = kept, (a, b - gone, True)
                return
            self.parts.pop(), self.starts.pop(), self.spans.pop()

    def source(self, i: int, j: int) -> tuple[int, int]:
        """The source span of characters i to j of the rewritten text."""
        at, to = bisect.bisect_right(self.starts, i) - 1, bisect.bisect_right(self.starts, j - 1) - 1
        a, _, copied = self.spans[at]
        c, d, plain = self.spans[to]
        return a + (i - self.starts[at]) * copied, c + (j - self.starts[to]) if plain else d


_WHITE = " \t\n\r\x0b\x0c"


def _word_before(text: str, end: int) -> str:
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:end]


def rewrite(text: str) -> _Rewritten | None:
    """The normal form of a text; None if it is the text itself."""
    flat = text if text.isascii() else text.translate(_look_table())
    out, done = _Rewritten(), 0
    for m in _TOKEN.finditer(flat):
        a, b = m.span()
        if a < done:
            continue
        kind = m.lastgroup
        shown, drop, after = "", "", b
        if kind == "digit":
            shown = _DIGITS[m["digit"].lower()]
            gap = _BETWEEN.match(flat, b).end()
            if gap > b and _NEXT_DIGIT.match(flat, gap):
                after = gap
            if done < a and flat[a - 1] in " ," and flat[done:a].rstrip(_WHITE + ",")[-1:].isdigit():
                drop = _WHITE + ","  # a numeral before a spelled digit
        elif kind in ("at", "dot", "dash"):
            shown, drop, after = {"at": "@", "dot": ".", "dash": "-"}[kind], _WHITE, _BLANK.match(flat, b).end()
        elif kind in ("dot_word", "dash_word"):
            blank = _BLANK.match(flat, b).end()
            if blank > b and flat[a - 1 : a].isspace():
                shown, drop, after = "." if kind == "dot_word" else "-", _WHITE, blank
        elif kind == "plus":
            gap = _BLANK.match(flat, b).end()
            if gap > b and _NEXT_DIGIT.match(flat, gap):
                shown, after = "+", gap
        elif kind == "at_word":
            host = _HOST.match(flat, b) if flat[a - 1 : a].isspace() else None
            if host and _LAST_LABEL.search(host[1])[0].lower() in _ENDINGS:
                # In "see us at example.com" a bare word is no sign: a plain name needs another.
                if _BARE.search(host[0]) or _OPENED.search(host[0]) or _MARKED.search(_word_before(flat, a)):
                    shown, drop, after = "@", _WHITE, host.start(1)
        if not shown and kind != "skip":
            continue
        out.add(flat[done:a], done, a, True)
        if drop:
            out.cut(drop)
            if kind != "digit" and not (out.last() in _LOCAL or ord(out.last() or " ") > 127):
                out.add(flat[a:after], a, after, True)
                done = after
                continue
        out.add(shown, a, b, False)
        done = after
    if not out.parts and flat == text:
        return None
    out.add(flat[done:], done, len(flat), True)
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    return a, b


def disguised_spans(text: str) -> list[Span]:
    """Identifiers that only the rewritten text shows, as spans of the source."""
    form = rewrite(text)
    if form is None:
        return []
    shown = "".join(form.parts)
    out: list[Span] = []
    for kind, i, j in plain_spans(shown):
        a, b = _trim(text, *form.source(i, j))
        source = text[a:b]
        if shown[i:j] != source and (kind != "email" or not _BARE.search(source) or shown[i:j].rpartition(".")[2].lower() in _ENDINGS):
            out.append((kind, a, b))
    return out


def find_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): base ones stay; a disguised one joins unless one of its
    kind covers it already."""
    base = plain_spans(text)
    found = disguised_spans(text)
    if not found:
        return base, base
    held = {kind: [(a, b) for k, a, b in base if k == kind] for kind in KINDS}  # by start, disjoint
    every, done = list(base), dict.fromkeys(KINDS, -1)
    for kind, a, b in found:
        at = bisect.bisect_right(held[kind], (a, sys.maxsize)) - 1
        if a >= done[kind] and not (at >= 0 and b <= held[kind][at][1]):
            every.append((kind, a, b))
            done[kind] = b
    return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind (n_email, n_ip, n_card, n_phone),
    base_sha256, spans (all, as kind:start:end in code points, end exclusive) and
    n_disguised, over every whole text.

    Null texts count as empty: no spans.  Rows repeating a doc_id are scanned each;
    other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_disguised", pa.int64())])

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in source:
            base, every = find_spans(text or "")
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            yield doc_id, *counts, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(every), len(every) - len(base)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_rows(
        picked, rows, ["doc_id", "text"], schema,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long",
    )


def mask(text: str) -> str:
    """The text with every identifier replaced by its kind in angle brackets."""
    _, spans = find_spans(text)
    if not spans:
        return text
    out, done = [], 0
    for kind, a, b in spans:
        if a < done:  # overlaps an earlier one of another kind
            done = max(done, b)
            continue
        out += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*out, text[done:]])


def mask_documents(docs: DataFrame) -> DataFrame:
    """docs with identifiers in `text` masked and n_chars, where present, made to match.

    Null texts stay null and empty ones empty; all rows, repeated ones too, and all
    columns stay as they are otherwise.  An empty table gives an empty result.
    """
    at = docs.columns.index("text")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            new = (None if (t := x.as_py()) is None else mask(t) for x in column)
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, column.type))

    out = docs.mapInArrow(masked, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
