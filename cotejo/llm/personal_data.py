"""Operator 11: personal data, also where it is disguised, at its place in the source text.

Each text is searched twice: as it is (base spans) and after a chain of transducers that undo
disguises.  A transducer rewrites pieces of a text and keeps, for every character it gives out,
the source characters that it came from; transducers compose, so a span that is found in
the last text leads back to the first source character of its first character and the last
one of its last.

* ``fold``: look-alike letters, full-width and other compatible forms and decimal digits of any
  script to ASCII; invisible characters go.  One character for one, or none.
* ``spell``: zero to nine in four languages to digits, where two follow each other or one stands by a digit
  or a spoken dot; blanks, commas and hyphens between two of them go.  "plus" before a digit is a plus sign.
* ``bracket``: (at), [dot], {@}, <.> and the like, with blanks around, to the sign they stand for.
* ``speak``: name at place dot com, with a well-known last part, to an address; dots spoken between digits.

A disguised span counts if its source differs from what was found and no base span
of its kind covers it.  Base spans always stay.

Rows: one for each input row.  Null texts are empty, empty texts have no spans, repeated rows
have equal results, doc_id is carried along and may be null or repeated.  Every step is linear in the
length of the text, which is read whole; a row's memory follows its text.  Other columns of
the input are not read by ``find`` and kept by ``redacted``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import documents

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind: string, start: int, end: int, disguised: boolean>"

# Fixed patterns and bounds of the four kinds.  An address is found from its sign outwards; a run of
# digits that begins no address is taken whole, as none begins further right in it.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    last, sign = 0, text.find("@")
    while sign >= 0:
        start = len(text[last:sign].rstrip(_LOCAL)) + last
        found = _DOMAIN.match(text, sign + 1) if start < sign else None
        if found:
            yield start, found.end()
        last = found.end() if found else sign + 1
        sign = text.find("@", last)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if not m[1]:
            continue
        parts = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m.group())) <= 15:
            yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))


# Fixed look-alikes of ASCII letters in other scripts; other forms follow from Unicode's own tables.
_LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ", "ABESIJKMHOPCTYXaesijopcyxhdqw"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορυν", "ABEZHIKMNOPTYXopuv"),
    "signs": ("‐‑‒–—−。․∙·", "------...."),
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Folded(dict):
    """ASCII for a code point: looked up once in each task."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c) if code > 127 else c
        digit = unicodedata.decimal(c, None) if code > 127 else None
        self[code] = str(digit) if digit is not None else plain if len(plain) == 1 and " " <= plain < "\x7f" else c
        return self[code]


_FOLDED = _Folded({ord(a): b for odd, plain in _LOOKALIKES.values() for a, b in zip(odd, plain, strict=True)} | {ord(c): "" for c in _INVISIBLE})


@dataclass
class Traced:
    """A text and, for each of its characters, where it begins and ends in the source."""

    text: str
    start: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, text: str) -> Traced:
        at = np.arange(len(text))
        return cls(text, at, at + 1)

    def rewritten(self, pieces: list[tuple[int, int, str]]) -> Traced:
        """With pieces (from, to, new text), in order, replaced; a piece's characters all come from the whole piece."""
        if not pieces:
            return self
        text, start, end, last = [], [], [], 0
        for a, b, new in pieces:
            text += [self.text[last:a], new]
            start += [self.start[last:a], np.full(len(new), self.start[a])]
            end += [self.end[last:a], np.full(len(new), self.end[b - 1])]
            last = b
        text.append(self.text[last:])
        return Traced("".join(text), np.concatenate((*start, self.start[last:])), np.concatenate((*end, self.end[last:])))


def fold(t: Traced) -> Traced:
    odd = [c for c in set(t.text) if c > "\x7f" and _FOLDED[ord(c)] != c]
    if not odd:
        return t
    stays = np.ones(len(t.text), bool)
    if any(not _FOLDED[ord(c)] for c in odd):
        stays = ~np.isin(np.frombuffer(t.text.encode("utf-32-le", "surrogatepass"), np.uint32), [ord(c) for c in _INVISIBLE])
    return Traced(t.text.translate({ord(c): _FOLDED[ord(c)] for c in odd}), t.start[stays], t.end[stays])


# Fixed number words, by language, in the order of the digits.
_NUMBERS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "null eins zwei drei vier fünf sechs sieben acht neun",
)
_SPELLED = {word: str(i) for line in _NUMBERS for i, word in enumerate(line.split())}
_ANY = "|".join(sorted(_SPELLED, key=len, reverse=True))
_SIGN = "dot|punkt|punto|point"
_NUMBER = re.compile(rf"(?i){_ANY}")
_NUMBER_RUN = re.compile(
    rf"(?i)(?<![^\W_])(?:(?:{_ANY})(?:[\x20,-]{{1,3}}(?:{_ANY}))+(?![^\W_])"
    rf"|(?:{_ANY})(?=[\x20-][0-9]|[\x20\t]{{1,3}}(?:{_SIGN})\b)"
    rf"|(?:(?<=[0-9][\x20-])|(?<=dot\x20)|(?<=punkt\x20)|(?<=punto\x20)|(?<=point\x20))(?:{_ANY})(?![^\W_]))"
)
_PLUS = re.compile(r"(?i)(?<![^\W_])plus[\x20-]?(?=[0-9])")


def spell(t: Traced) -> Traced:
    pieces = []
    for run in _NUMBER_RUN.finditer(t.text):
        last = run.start()
        for m in _NUMBER.finditer(t.text, run.start(), run.end()):
            if m.start() > last:
                pieces.append((last, m.start(), ""))
            pieces.append((*m.span(), _SPELLED[m.group().lower()]))
            last = m.end()
    out = t.rewritten(pieces)
    return out.rewritten([(*m.span(), "+") for m in _PLUS.finditer(out.text)])


_BRACKETED = re.compile(r"(?i)[\x20\t]{0,3}[(\[{<][\x20\t]{0,3}(?:(at|@|arroba)|dot|punkt|punto|point|\.)[\x20\t]{0,3}[)\]}>][\x20\t]{0,3}")  # the signs of _SIGN


def bracket(t: Traced) -> Traced:
    return t.rewritten([(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(t.text)])


# Fixed last parts of addresses that are taken for spoken ones.
_LAST = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|me|us|uk|de|fr|es|eu|ch|it|nl|pt|test|example|invalid"
_AT = r"[\x20\t]{1,3}(?:at|arroba)[\x20\t]{1,3}"
_DOT = rf"[\x20\t]{{1,3}}(?:{_SIGN})[\x20\t]{{1,3}}"
_SPOKEN = re.compile(
    rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_DOT}[A-Za-z0-9_%+-]++){{0,4}}(?:{_AT}|@)[A-Za-z0-9-]++(?:(?:{_DOT}|\.)[A-Za-z0-9-]++){{0,4}}{_DOT}(?:{_LAST})\b"
    rf"|(?<![0-9.])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"
)
_SPOKEN_SIGN = re.compile(rf"(?i)({_AT})|{_DOT}")


def speak(t: Traced) -> Traced:
    pieces = []
    for m in _SPOKEN.finditer(t.text):
        pieces += [(s.start(), s.end(), "@" if s[1] else ".") for s in _SPOKEN_SIGN.finditer(t.text, m.start(), m.end())]
    return t.rewritten(pieces)


TRANSDUCERS = (fold, spell, bracket, speak)
_BRACKET = re.compile(r"[(\[{<][\x20\t]{0,3}(?:at|@|arroba|dot|punkt|punto|point|\.)[\x20\t)\]}>]")
_TWO_NUMBERS = re.compile(rf"[\x20,-](?:{_ANY})[\x20,-]{{1,3}}(?:{_ANY})")


def disguised(text: str) -> bool:
    """Whether a transducer might find work in a text; numbers spelled out count from three in a row on."""
    low = text.lower()
    if any(f" {w} " in low or f"\t{w}" in low for w in _SIGN.split("|")) or _BRACKET.search(low) or _TWO_NUMBERS.search(low):
        return True
    return not text.isascii() and any(c > "\x7f" and _FOLDED[ord(c)] != c for c in set(text))


def plain(text: str) -> Traced:
    """The text without disguises, traced to the source."""
    t = Traced.of(text)
    for transducer in TRANSDUCERS:
        t = transducer(t)
    return t


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, disguised) of a text, by kind, then start, end; code points, end exclusive."""
    base = {kind: list(found(text)) for kind, found in DETECTORS.items()}
    out = [(kind, a, b, False) for kind in KINDS for a, b in base[kind]]
    if not disguised(text):
        return out
    t = plain(text)
    if t.text == text:
        return out
    for kind, found in DETECTORS.items():
        ends = sorted(base[kind])
        starts = [a for a, _ in ends]
        for i, j in found(t.text):
            a, b = int(t.start[i]), int(t.end[j - 1])
            k = int(np.searchsorted(starts, a, "right")) - 1
            covered = k >= 0 and b <= ends[k][1]
            if not covered and text[a:b] != t.text[i:j]:
                out.append((kind, a, b, True))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), *s[1:]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of ``docs`` (doc_id, text); spans sorted by kind, start and end."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])
        for batch in it:
            found = [[dict(zip(("kind", "start", "end", "disguised"), s)) for s in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kinds))], names=["doc_id", "spans"])

    schema = StructType([docs.schema["doc_id"], StructField("spans", DataType.fromDDL(f"array<{SPAN}>"))])
    return docs.select("doc_id", "text").mapInArrow(batches, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by its first kind in brackets; all rows and columns stay."""

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for kind, a, b, _ in sorted(spans(text), key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
            if a >= last:
                out += [text[last:a], f"[{kind.upper()}]"]
            last = max(last, b)
        return "".join((*out, text[last:]))

    @F.pandas_udf("string")
    def cleaned(texts):
        return texts.map(clean, na_action="ignore")

    return docs.withColumn("text", cleaned("text"))


def told(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of base spans, all spans, and the number of disguised ones."""
    base = F.filter("spans", lambda s: ~s["disguised"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & ~s["disguised"])).cast("long").alias(f"n_{kind}")

    disguised = F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised")
    return found.select("doc_id", *map(count, KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), disguised)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(documents(spark, sf_dir)))
