"""Personal data, also where it is disguised, with offsets in the source text.

Plain identifiers are matched in the text itself. A text with disguises goes through transducers, which
replace homoglyphs, spelled digits and at / dot disguises and carry for each character of their output the
source span it came from; identifiers found in the output are mapped back by those spans. Offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import text_blocks

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, number of kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the characters before it that a local part may have, and a domain behind it.

    The same matches as the pattern's, but in linear time for any text.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of the parts of each chain of numbers and dots."""
    for chain in _DOTTED.finditer(text):
        if "." in chain[0]:
            parts = list(_PART.finditer(text, chain.start(), chain.end()))
            for k in range(0, len(parts) - 3, 4):
                if all(len(p[0].lstrip("0")) <= 3 and int(p[0][-3:]) <= 255 for p in parts[k : k + 4]):
                    yield parts[k].start(), parts[k + 3].end()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGIT.sub("", found[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in found[0]) <= 15:
            yield found.span()


def plain_spans(text: str) -> list[Span]:
    """Spans of undisguised identifiers, by start and kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _PART.search(text):
        out += [(a, 1, b) for a, b in addresses(text)]
        out += [(a, 2, b) for a, b in cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in phones(text)]
    return sorted(out)


#: letters and signs that look like ASCII ones
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Ζ": "Z",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
#: spelled digits in English, German, French and Spanish
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORD = "|".join(sorted(DIGIT_WORDS, key=lambda w: (-len(w), w)))
_DOT_WORD = r"[\x20]+(?:dot|point|punkt|punto)[\x20]+"
#: three or more spelled digits and numbers in a row, joined by blanks, hyphens, dots or spelled dots
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\x20-]+)?(?:(?:{_WORD}|[0-9]+)(?:{_DOT_WORD}|[\x20.-]{{1,3}})){{2,}}(?:{_WORD}|[0-9]+)(?!\w)", re.I)
_SPELLED_TOKEN = re.compile(rf"(?P<plus>plus[\x20-]+)|(?P<word>{_WORD})|(?P<number>[0-9]+)|(?P<dot>{_DOT_WORD})|(?P<gap>[\x20.-]{{1,3}})", re.I)
#: without one of these no run has anything spelled
_SPELLED_HINT = re.compile(rf"(?<!\w)(?:{_WORD})(?:{_DOT_WORD}|[\x20.-]{{1,3}})(?:{_WORD}|[0-9])|[0-9](?:{_DOT_WORD}(?:{_WORD}|[0-9])|[\x20-]{{1,3}}(?:{_WORD})(?!\w))", re.I)
_BRACKET_AT = re.compile(r"\s?[\[({<]\s?(?:at|@|ät)\s?[\])}>]\s?", re.I)
_BRACKET_DOT = re.compile(r"\s?[\[({<]\s?(?:dot|\.|punkt|point|punto)\s?[\])}>]\s?", re.I)
_WORDY = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\x20+at\x20+)[A-Za-z0-9-]+(?:(?:\x20+dot\x20+|\.)[A-Za-z0-9-]+)+(?![A-Za-z0-9-])", re.I)
_WORDY_DOT = re.compile(r"\x20+dot\x20+", re.I)


class Transduced:
    """A text with, for each character, the source span it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.new = text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Transduced:
        """Replace the spans of ``edits``, which are in order and don't overlap."""
        if not edits:
            return self
        out = Transduced("")
        parts, done = [], 0
        for start, end, put in [*edits, (len(self.text), len(self.text), "")]:
            parts.append(self.text[done:start])
            out.starts += self.starts[done:start]
            out.ends += self.ends[done:start]
            out.new += self.new[done:start]
            if end > start:
                parts.append(put)
                out.starts += [self.starts[start]] * len(put)
                out.ends += [self.ends[end - 1]] * len(put)
                out.new += b"\1" * len(put)
            done = end
        out.text = "".join(parts)
        return out


def _lookalike(c: str) -> str:
    """The ASCII sign that ``c`` looks like, or nothing; signs with accents look like themselves."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    put = unicodedata.normalize("NFKC", c)
    return put if len(put) == 1 and put.isascii() else ""


def homoglyphs(t: Transduced) -> Transduced:
    return t if t.text.isascii() else t.rewrite([(k, k + 1, put) for k, c in enumerate(t.text) if c > "\x7f" and (put := _lookalike(c))])


def spelled_digits(t: Transduced) -> Transduced:
    """Digit words as digits, side by side where nothing but a blank or hyphen stood between them, and spelled dots between numbers as dots.

    What of it is an identifier is left to the detectors.
    """
    edits = []
    for run in _SPELLED.finditer(t.text) if _SPELLED_HINT.search(t.text) else ():
        tokens = list(_SPELLED_TOKEN.finditer(t.text, run.start(), run.end()))
        for k, token in enumerate(tokens):
            kind = token.lastgroup
            if kind == "plus":
                edits.append((*token.span(), "+"))
            elif kind == "word":
                edits.append((*token.span(), DIGIT_WORDS[token[0].lower()]))
            elif kind == "dot":
                edits.append((*token.span(), "."))
            elif kind == "gap" and "." not in token[0] and tokens[k - 1].lastgroup == tokens[k + 1].lastgroup == "word":
                edits.append((*token.span(), ""))
    return t.rewrite(edits)


def at_and_dot(t: Transduced) -> Transduced:
    low = t.text.lower()
    if "at" in low or "ät" in low or "@" in low:
        t = t.rewrite([(*m.span(), "@") for m in _BRACKET_AT.finditer(t.text)])
    t = t.rewrite([(*m.span(), ".") for m in _BRACKET_DOT.finditer(t.text)])
    edits = []
    if " dot " in low:
        for m in _WORDY.finditer(t.text):
            if " dot " not in m[0].lower():
                continue  # with a plain domain behind it, "at" is rather a place than a sign: "see you at example.com"
            edits.append((*m.span("at"), "@"))
            edits += [(*d.span(), ".") for d in _WORDY_DOT.finditer(t.text, m.end("at"), m.end())]
    return t.rewrite(edits)


#: a character or word without which no transducer changes anything
_DISGUISE = re.compile(r"[\[({<]\s?(?:at|@|ät|dot|\.|punkt|point|punto)\s?[\])}>]|\x20dot\x20", re.I)
_ODD = re.compile(r"[^\x00-\x7f¡-©«-±¶-¸»-ɏḀ-ỿ]")


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Further spans that show once the disguises are undone, each with at least one rewritten sign."""
    odd = not text.isascii() and _ODD.search(text)
    if not (odd or _DISGUISE.search(text) or _SPELLED_HINT.search(text)):
        return []
    t = at_and_dot(spelled_digits(homoglyphs(Transduced(text))))
    found = set(plain_spans(t.text))
    for run in re.finditer(r"[0-9](?:[\x20.-]{0,3}[0-9]){9,}", t.text):  # spelled numbers without a plus sign
        if sum(t.new[run.start() : run.end()]) >= 7 and 10 <= len(_NOT_DIGIT.sub("", run[0])) <= 15 and not t.text[: run.start()].endswith("+"):
            found.add((run.start(), 3, run.end()))
    known = set(plain)
    mapped = {(t.starts[a], k, t.ends[b - 1]) for a, k, b in found if any(t.new[a:b])}
    return sorted(mapped - known)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _arrow_spans(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in r] for r in rows], pa.list_(_SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``added``: arrays of struct<kind, start, end> by start, then kind.

    ``base`` has the plain matches of each whole text and ``added`` what the transducers add. Null counts as empty and has
    no spans. Repeated rows stay, with equal spans.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for _, _, data, offsets in text_blocks(batch.column(1)):
                cuts = offsets.tolist()
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    text = data[a:b].tobytes().decode()
                    base.append(plain_spans(text))
                    added.append(disguised_spans(text, base[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), _arrow_spans(base), _arrow_spans(added)], ["id", "base", "added"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, base {spans}, added {spans}").withColumnRenamed("id", id_col)


def mask(text: str) -> str:
    """The text with each identifier replaced by its kind in brackets; of overlapping ones the first stands for all."""
    plain = plain_spans(text)
    out, done, reach = [], 0, 0
    for start, kind, end in sorted([*plain, *disguised_spans(text, plain)], key=lambda s: (s[0], -s[2], s[1])):
        if start >= reach:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = reach = max(reach, end)
    return "".join([*out, text[done:]]) if out else text


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its texts masked; a null text stays null, all else stays as it is."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = pa.array([None if (t := v.as_py()) is None else mask(t) for v in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(masked, docs.schema)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
