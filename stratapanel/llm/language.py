"""Language identification by a byte convolutional network.

A text's bytes are folded to 143 codes (letters without case, each byte of UTF-8 characters, one code for all else) and cut
into windows of fixed length. Filters of several widths run over the codes' embeddings; their maxima over
a window go through a softmax layer. A text's languages are the windows' probabilities, weighted by
their letters. Training is plain numpy. As a convolution is linear in the embedding, scoring looks up
products of embedding and filter by code, or by pairs of codes, rather than multiplying.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import Adam, first_by_hash, text_sample
from .textbuf import ragged, text_blocks

#: bounds of the learning sample: documents of a language (fewer where languages are many) and of all, bytes, and windows of a document
MAX_PER_LANGUAGE, MAX_DOCUMENTS, MAX_BYTES, MAX_WINDOWS = 300, 30_000, 24 << 20, 16
WINDOW, WIDTHS, FILTERS, EMBED, CODES = 128, (2, 3, 4), 8, 8, 143
_BLOCK = 1 << 18
UNKNOWN = "und"

#: 0 padding, 1 all that isn't a letter, 2-27 a-z, 28-91 the bytes that continue a character, 92-142 those that begin one
_CODE = np.ones(256, np.uint8)
_CODE[97:123] = np.arange(2, 28)
_CODE[128:192] = 28 + np.arange(64)
_CODE[0xC2:0xF5] = 92 + np.arange(0xF5 - 0xC2)


def codes(data: np.ndarray) -> np.ndarray:
    """Code of each byte; capitals of ASCII and of Latin-1 count as small letters."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    capital = np.zeros(len(data), bool)
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data[capital] |= 0x20
    return _CODE[data]


def windows(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows that cover each row, the last padded with zeros, and each row's first window."""
    sizes = np.diff(offsets)
    n = -(-sizes // length)
    code = np.concatenate([codes(data), np.zeros(length, np.uint8)])
    row = np.repeat(np.arange(len(sizes)), n)
    begins = offsets[row] + length * ragged(np.zeros(len(n), np.int64), n)
    out = code[begins[:, None] + np.arange(length)]
    short = np.flatnonzero(begins + length > offsets[row + 1])
    out[short] *= (begins[short, None] + np.arange(length)) < offsets[row[short] + 1, None]
    return out, np.concatenate([[0], np.cumsum(n)])


@dataclass
class LanguageModel:
    languages: list[str]
    embedding: np.ndarray  # codes x EMBED
    filters: list[np.ndarray]  # for each width: width x EMBED x FILTERS
    biases: list[np.ndarray]
    top: np.ndarray
    top_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embedding @ w).astype(np.float32) for w in f] for f in self.filters]

    def pooled(self, x: np.ndarray, with_places: bool = False):
        """Filters' maxima over each window (and where they are)."""
        outs, places = [], []
        pairs = x[:, :-1].astype(np.int32) * CODES + x[:, 1:]
        for t, bias in zip(self._pairs(), self.biases, strict=True):
            width = sum(2 if len(k) > CODES else 1 for k in t)
            span, h, at = x.shape[1] - width + 1, None, 0
            for k in t:
                part = k[pairs[:, at : at + span]] if len(k) > CODES else k[x[:, at : at + span]]
                h = part if h is None else np.add(h, part, out=h)
                at += 2 if len(k) > CODES else 1
            outs.append(np.maximum(h.max(1) + bias, 0))
            if with_places:
                places.append(h.argmax(1))
        out = np.concatenate(outs, 1)
        return (out, places) if with_places else out

    def _pairs(self) -> list[list[np.ndarray]]:
        """The tables, neighbours joined in twos."""
        if getattr(self, "_cache", None) is None:
            self._cache = [
                [(t[k][:, None] + t[k + 1][None]).reshape(-1, t[k].shape[1]) if k + 1 < len(t) else t[k] for k in range(0, len(t), 2)] for t in self.tables()
            ]
        return self._cache

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.top + self.top_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 8, seed: int = 11) -> LanguageModel:
    """Fit on windows of codes and the numbers of their languages."""
    rng = np.random.default_rng(seed)
    n, wide = len(languages), FILTERS * len(WIDTHS)
    model = LanguageModel(
        languages,
        rng.normal(0, 0.5, (CODES, EMBED)),
        [rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, wide**-0.5, (wide, n)),
        np.zeros(n),
    )
    optimiser = Adam([model.embedding, *model.filters, *model.biases, model.top, model.top_bias])
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            at = order[lo : lo + 128]
            xb = x[at].copy()
            cut = rng.integers(12, WINDOW * 3, len(at))  # a third of the windows are made short, as short texts are
            xb[np.arange(WINDOW)[None] >= cut[:, None]] = 0
            model._cache = None
            pooled, places = model.pooled(xb, True)
            z = pooled @ model.top + model.top_bias
            g = np.exp(z - z.max(1, keepdims=True))
            g /= g.sum(1, keepdims=True)
            g[np.arange(len(at)), y[at]] -= 1
            g /= len(at)
            back = (g @ model.top.T) * (pooled > 0)
            d_embed, d_filters, d_bias = np.zeros_like(model.embedding), [], []
            for k, (w, f) in enumerate(zip(WIDTHS, model.filters, strict=True)):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                d = np.zeros_like(f)
                for step in range(w):
                    seen = xb[np.arange(len(at))[:, None], places[k] + step]
                    table = np.stack([np.bincount(seen[:, j], own[:, j], CODES) for j in range(FILTERS)], 1)
                    d_embed += table @ f[step].T
                    d[step] = model.embedding.T @ table
                d_filters.append(d)
                d_bias.append(own.sum(0))
            optimiser.step([d_embed, *d_filters, *d_bias, pooled.T @ g, g.sum(0)])
    model._cache = None
    return model


def fit_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = MAX_PER_LANGUAGE, max_bytes: int = MAX_BYTES
) -> LanguageModel:
    """Learn every language that occurs, from at most ``per_language`` documents of each (fewer, but one at least, where that makes more
    than MAX_DOCUMENTS) and ``max_bytes`` of text, with up to MAX_WINDOWS windows evenly from the whole of each text.

    Rows with a null language or text are left out, copies of an id count once, and ties of an id's texts go as ``text_sample`` says.
    """
    known = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label")).where("id is not null and label is not null")
    languages = known.select("label").distinct().count()
    rows = first_by_hash(known, max(1, min(per_language, MAX_DOCUMENTS // max(languages, 1))), "label")
    sample = text_sample(docs, rows, max_bytes, id_col, text_col)
    names = sorted(set(sample.column("label").to_pylist()))
    labels = np.array([names.index(x) for x in sample.column("label").to_pylist()], np.int64)
    xs, ys = [np.zeros((0, WINDOW), np.uint8)], [np.zeros(0, np.int64)]
    for lo, hi, data, offsets in text_blocks(sample.column("text").combine_chunks() if len(sample) else pa.array([], pa.string()), _BLOCK):
        x, rows_at = windows(data, offsets)
        for k in range(hi - lo):
            n = rows_at[k + 1] - rows_at[k]
            at = rows_at[k] + np.unique(np.linspace(0, max(n - 1, 0), min(n, MAX_WINDOWS)).astype(np.int64))
            at = at[(x[at] > 1).sum(1) >= 4] if n else at[:0]
            xs.append(x[at])
            ys.append(np.full(len(at), labels[lo + k]))
    return train(np.concatenate(xs), np.concatenate(ys), names or [UNKNOWN])


def score_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` (its probability) for each whole text.

    A null text, or one without any letter, is ``und`` with score 0. Repeated rows are scored alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            names, scores = [], []
            for _, _, data, offsets in text_blocks(batch.column(1), _BLOCK):
                x, rows = windows(data, offsets)
                total = np.zeros((len(offsets) - 1, len(model.languages)))
                letters = (x > 1).sum(1).astype(float)
                step = 512
                for lo in range(0, len(x), step):
                    p = model.probabilities(x[lo : lo + step]) * letters[lo : lo + step, None]
                    np.add.at(total, np.searchsorted(rows, np.arange(lo, min(lo + step, len(x))), "right") - 1, p)
                ascii_letter = np.concatenate([[0], np.cumsum((data | 32) - np.uint8(97) < 26)])
                plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
                best = total.argmax(1)
                weight = total.sum(1)
                for k in range(len(best)):
                    known = weight[k] > 0 and (plain[k] or any(c.isalpha() for c in data[offsets[k] : offsets[k + 1]].tobytes().decode()))
                    names.append(model.languages[best[k]] if known else UNKNOWN)
                    scores.append(total[k, best[k]] / weight[k] if known else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)
