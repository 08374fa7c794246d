"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length.

Folding lower-cases, drops invisible characters, maps homoglyphs and digits that stand for letters to those letters
(l, i and 1 to one), and turns all that is no letter into a space; entries without accents are matched
in the text without its accents, too. Lexicon entries (whole words, or stems at a word's start) and their
weights are learned from labelled texts; entries inside an exception phrase don't count. What a text's
entries weigh, over the logarithm of its length, gives the score by a fitted logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import first_by_hash, sigmoid, text_sample
from .textbuf import ragged, text_blocks

#: bounds of the learning sample
MAX_ROWS, MAX_BYTES = 6000, 16 << 20
#: a stem has at least and at most so many letters; an entry at least so many different surroundings; and so large a share of them in toxic texts
MIN_STEM, MAX_STEM, MIN_SUPPORT, MIN_SHARE = 4, 40, 5, 0.9
_BLOCK = 1 << 18

#: letters of other scripts that look like Latin ones
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ʟ": "l", "ո": "n", "օ": "o", "ѵ": "v", "ԛ": "q", "ԝ": "w",
}
#: digits and signs that stand for letters; l, i and 1 stand for one another, so all are folded to i
SUBSTITUTES = {"0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
_PLANES = 0x20000


def _folded_char(c: int) -> str:
    """What a character folds to: letters and digits, nothing for marks and format characters, a space for all else."""
    if 0xD800 <= c < 0xE000:
        return " "
    out = []
    for char in unicodedata.normalize("NFKC", chr(c)).lower():
        if unicodedata.category(char) in ("Cf", "Mn", "Me"):
            continue
        char = HOMOGLYPHS.get(char, char)
        char = SUBSTITUTES.get(char, char)
        if char == "i" and chr(c) in "!|":
            char = "\x01"  # a letter only inside a word
        out.append(char if char.isalnum() or char == "\x01" or unicodedata.category(char) == "Mc" else " ")
    return "".join(out)


@cache
def fold_table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each code point below 0x20000: how many it folds to, where these are in the third array, that array; and each letter without its accent."""
    parts = [_folded_char(c) for c in range(_PLANES)]
    size = np.array([len(p) for p in parts], np.int64)
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    bare = np.arange(_PLANES, dtype=np.uint32)
    for c in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(c))[:1]
        if base.isalpha():
            bare[c] = ord(SUBSTITUTES.get(base, base))
    return size, np.cumsum(size) - size, flat, bare


#: marks that compose with the letter before them
_MARKS = re.compile("[\u0300-\u036f]")


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def fold(texts: list[str]) -> tuple[str, str, np.ndarray, np.ndarray]:
    """The folded texts, each between spaces, as one string; the same without accents; where each text begins; and how many words each has."""
    texts = [unicodedata.normalize("NFC", t) if not t.isascii() and _MARKS.search(t) else t for t in texts]
    raw = np.frombuffer((" ".join(texts).join("  ")).encode("utf-32-le"), "<u4")
    size, at, flat, bare = fold_table()
    known = np.minimum(raw, _PLANES - 1)
    n = np.where(raw < _PLANES, size[known], 1)
    wide = flat[ragged(at[known], n).clip(0, len(flat) - 1)]
    ends = np.cumsum(n)
    far = np.flatnonzero(raw >= _PLANES)
    wide[ends[far] - 1] = raw[far]
    starts = ends[np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])]  # of the folded text
    wide[starts - 1] = 32
    sign = np.flatnonzero(wide == 1)  # a sign for i counts where a letter follows
    after = wide[np.minimum(sign + 1, len(wide) - 1)]
    wide[sign] = np.where((after != 32) & (after != 1), ord("i"), 32)
    solid = np.concatenate([[0], np.cumsum((wide[1:] != 32) & (wide[:-1] == 32))])
    kept = _text(wide)
    plain = kept if kept.isascii() else _text(np.where(wide < _PLANES, bare[np.minimum(wide, _PLANES - 1)], wide))
    return kept, plain, starts, np.diff(solid[starts - 1])


def fold_entry(entry: str) -> str:
    """An entry or phrase as it stands in folded text; spaces at its ends stay."""
    return (" " if entry.startswith(" ") else "") + " ".join(fold([entry])[0].split()) + (" " if entry.endswith(" ") else "")


@dataclass
class Lexicon:
    entries: dict[str, float]  # " word " or " stem" -> weight
    exceptions: list[str] = field(default_factory=list)  # " word word "
    slope: float = 1.0
    bias: float = -2.0

    def automata(self) -> list:
        """Of what has accents, for the folded text, and of all else, for the text without accents; None where there is nothing."""
        import ahocorasick

        found: list = [ahocorasick.Automaton(), ahocorasick.Automaton()]
        weights: dict[str, float] = {}
        for entry, weight in self.entries.items():  # forms that fold alike are one, with the greatest weight
            form = fold_entry(entry)
            weights[form] = max(weight, weights.get(form, weight))
        for form in {fold_entry(p) for p in self.exceptions} | weights.keys():
            found[form.isascii()].add_word(form, (len(form), weights.get(form)))
        for k, automaton in enumerate(found):
            if len(automaton):
                automaton.make_automaton()
            else:
                found[k] = None
        return found

    def weights(self, automata: list, kept: str, plain: str, starts: np.ndarray) -> np.ndarray:
        """Summed weight of the entries in each of the texts that ``fold`` joined."""
        out = np.zeros(len(starts) - 1)
        hits, shields = [], []
        for automaton, text in zip(automata, (kept, plain), strict=True):
            for end, (size, weight) in automaton.iter(text) if automaton is not None else ():
                (shields if weight is None else hits).append((end + 1 - size, end + 1, weight))
        if shields:
            shields.sort()
            begins = np.array([s[0] for s in shields])
            reach = np.maximum.accumulate([s[1] for s in shields])
            hits = [h for h in hits if (k := int(np.searchsorted(begins, h[0], "right")) - 1) < 0 or reach[k] < h[1]]
        if hits:
            row = np.searchsorted(starts, [h[0] + 1 for h in hits], "right") - 1
            np.add.at(out, row, [h[2] for h in hits])
        return out

    def scores(self, weights: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * weights / (1 + np.log1p(n_words)) + self.bias)


def _folded(texts: list[str]) -> Iterator[tuple[range, str, np.ndarray]]:
    """Some rows at a time: their numbers, folded text and starts."""
    for at in range(0, len(texts), 64):
        text, _, starts, _ = fold(texts[at : at + 64])
        yield range(at, min(at + 64, len(texts))), text, starts


def learn(texts: list[str], labels: np.ndarray) -> Lexicon:
    """Entries, exceptions, and the logistic curve.

    A word counts once for each distinct pair of neighbours, so copies of a text count once.
    """
    numbers: dict[str, int] = {}
    seen = [np.zeros(0, np.uint64)]
    for part, text, starts in _folded(texts):
        for k in range(len(part)):
            row = np.array([0, *(numbers.setdefault(w, len(numbers) + 1) for w in text[starts[k] : starts[k + 1]].split()), 0], np.uint64)
            around = (row[:-2] * np.uint64(0x9E3779B97F4A7C15) + row[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(33)
            # word, label and neighbours in one number
            seen.append(np.unique((row[1:-1] << np.uint64(32)) | (around & np.uint64(0x7FFFFFFF)) << np.uint64(1) | np.uint64(labels[part.start + k])))
    places = np.unique(np.concatenate(seen))
    del seen
    word, label = (places >> np.uint64(32)).astype(np.int64), (places & np.uint64(1)).astype(np.int64)
    counts = np.bincount(word * 2 + label, minlength=2 * len(numbers) + 2).reshape(-1, 2)
    clean, toxic = max(1, int(counts[:, 0].sum())), max(1, int(counts[:, 1].sum()))
    whole = {w: tuple(counts[k].tolist()) for w, k in numbers.items() if counts[k, 1]}
    stems = {w[:n]: [0, 0, 0] for w, (good, bad) in whole.items() if bad >= MIN_SHARE * (good + bad) for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}
    for w, k in numbers.items():
        for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1):
            if (count := stems.get(w[:n])) is not None:
                count[0] += int(counts[k, 0])
                count[1] += int(counts[k, 1])
                count[2] += 1

    def weight(good: int, bad: int) -> float | None:
        """Log odds against chance, where there is enough to go by."""
        odds = ((bad + 0.5) / toxic) / ((good + 0.5) / clean)
        return float(np.log(odds)) if bad >= MIN_SUPPORT and bad >= MIN_SHARE * (good + bad) else None

    entries: dict[str, float] = {}
    for word, (good, bad) in sorted(whole.items()):
        if len(word) >= 3 and (w := weight(good, bad)):
            entries[f" {word} "] = w
    for stem, (good, bad, forms) in sorted(stems.items(), key=lambda x: (len(x[0]), x[0])):
        # a stem covers several forms; one inside a longer stem would count twice
        if forms > 1 and (w := weight(good, bad)) and not any(f" {stem[:n]}" in entries for n in range(MIN_STEM, len(stem))):
            entries[f" {stem}"] = w
    entries = {e: w for e, w in entries.items() if e.endswith(" ") is False or not any(e[: n + 1] in entries for n in range(MIN_STEM, min(len(e) - 2, MAX_STEM) + 1))}

    # phrases with an entry that stand in clean texts only, in several surroundings
    phrases: dict[str, list[set]] = defaultdict(lambda: [set(), set()])
    listed = {w for w in numbers if f" {w} " in entries or any(f" {w[:n]}" in entries for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1))}
    for part, text, starts in _folded(texts):
        for k in range(len(part)):
            row = ["", *text[starts[k] : starts[k + 1]].split(), ""]
            for at in range(1, len(row) - 1):
                if row[at] in listed:
                    phrases[f" {row[at - 1]} {row[at]} "][int(labels[part.start + k])].add(row[at + 1])
                    phrases[f" {row[at]} {row[at + 1]} "][int(labels[part.start + k])].add(row[at - 1])
    exceptions = sorted(p for p, (good, bad) in phrases.items() if len(good) >= 3 and not bad and "  " not in p)
    lexicon = Lexicon(entries, exceptions)
    automata = lexicon.automata()
    x, y = [np.zeros(0)], labels.astype(float)
    for at in range(0, len(texts), 64):
        kept, plain, starts, n = fold(texts[at : at + 64])
        x.append(lexicon.weights(automata, kept, plain, starts) / (1 + np.log1p(n)))
    design = np.stack([np.concatenate(x), np.ones(len(y))], 1)
    beta = np.array([1.0, -2.0])
    for _ in range(50 if len(y) else 0):  # Newton steps; the small penalty keeps separable data finite
        p = sigmoid(design @ beta)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2), design.T @ (y - p) - 0.01 * beta)
        beta = beta + np.clip(step, -2, 2)
    if len(y):
        lexicon.slope, lexicon.bias = float(max(beta[0], 0)), float(beta[1])
    return lexicon


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> Lexicon:
    """Learn from at most ``max_rows`` labels, half of them toxic where there are as many, and ``max_bytes`` of text.

    Rows with a null id or label are left out, repeated ones count once. Without labelled texts the lexicon is empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    rows = first_by_hash(known, max_rows // 2, "label")
    sample = text_sample(docs, rows, max_bytes, id_col, text_col)
    return learn(sample.column("text").to_pylist(), np.array(sample.column("label").to_pylist(), np.int64))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score``, the probability of label 1, for each whole text; a null text counts as empty.

    A text without any entry has the curve's value at zero. Repeated rows are scored alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        automata = lexicon.automata()
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column(1), _BLOCK):
                raw = data.tobytes()
                cuts = offsets.tolist()
                kept, plain, starts, n = fold([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                parts.append(lexicon.scores(lexicon.weights(automata, kept, plain, starts), n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
