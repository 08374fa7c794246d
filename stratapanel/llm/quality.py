"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word of the learning sample has a sparse random index vector; its context vector is the sum of
the index vectors of the words around it. Words too rare to have a vector of their own share that of
their shape (case, digits, letters beyond ASCII, length). A document is pooled as mean and standard
deviation of its words' vectors, with the share of words that stand in their own context and the
logarithm of its length. A network with one hidden layer, trained in numpy, gives a logit; a temperature
found on rows that the network didn't see turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .learning import Adam, first_by_hash, hash_of, sigmoid, text_sample
from .textbuf import span_hashes, text_blocks

#: bounds of the learning sample
MAX_ROWS, MAX_BYTES = 4000, 24 << 20
DIM, VOCABULARY, HIDDEN, SLOTS = 32, 4096, 24, 1 << 16
N_SHAPES = 240
_BLOCK = 1 << 18

_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 word, 2 other marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LENGTH = np.digitize(np.arange(65), [2, 4, 7, 11])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token (a run of word bytes or of marks), and each row's first token."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    edge[0] = edge[-1] = True
    cuts = np.flatnonzero(edge)
    solid = kind[cuts[:-1]] > 0
    starts, lengths = cuts[:-1][solid], np.diff(cuts)[solid]
    ends = starts + lengths

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return total[ends] - total[starts]

    upper = count(_UPPER[data])
    case = np.where(upper == 0, 0, np.where(upper == lengths, 2, np.where(_UPPER[data[starts]] & (upper == 1), 1, 3)))
    shape = ((case * 2 + (count(_DIGIT[data]) > 0)) * 2 + (count(data >= 128) > 0)) * 5 + _LENGTH[np.minimum(lengths, 64)]
    shape = np.where(kind[starts] == 2, 80 + np.minimum(lengths, 9), shape)
    return span_hashes(data, starts, lengths), shape, np.searchsorted(starts, offsets)


@dataclass
class QualityModel:
    slots: np.ndarray  # hash table: number of a word of the vocabulary, or -1
    hashes: np.ndarray
    vectors: np.ndarray  # words, then shapes; each row holds the vector and its squares
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def keys(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        return np.where((at >= 0) & (self.hashes[at] == hashes), at, len(self.hashes) + shapes)

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Features of the rows of a block; a row without tokens has zeros."""
        hashes, shapes, rows = tokens(data, offsets)
        n = np.diff(rows)
        out = np.zeros((len(n), 2 * DIM + 3), np.float32)
        full = np.flatnonzero(n)
        if not len(full):
            return out
        keys = self.keys(hashes, shapes)
        sums = np.zeros((len(n), 2 * DIM))
        step = 1 << 15  # tokens at a time, so that the gathered vectors stay small
        for lo in range(0, len(keys), step):
            part = rows.clip(lo, min(lo + step, len(keys))) - lo
            have = np.flatnonzero(np.diff(part))
            sums[have] += np.add.reduceat(self.vectors[keys[lo : lo + step]], part[have], 0)
        sums = sums[full] / n[full, None]
        out[full, :DIM] = sums[:, :DIM]
        out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(sums[:, DIM:] - sums[:, :DIM] ** 2, 0))
        for lag in (1, 2):
            own = np.zeros(len(hashes) + 1, np.int64)
            own[lag + 1 :] = np.cumsum(hashes[lag:] == hashes[:-lag])
            # pairs whose first token belongs to an earlier row are left out
            first = np.minimum(rows[:-1] + lag, rows[1:])
            out[full, 2 * DIM + lag - 1] = ((own[rows[1:]] - own[first]) / np.maximum(n, 1))[full]
        out[full, 2 * DIM + 2] = np.log1p(n[full])
        return out

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh(((features - self.mean) / self.scale) @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features) / self.temperature)


def random_indexing(blocks: list[tuple[np.ndarray, np.ndarray]], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary (hash table and hashes) and vectors of words and shapes from blocks of text."""
    rng = np.random.default_rng(seed)
    streams = [tokens(*b) for b in blocks]
    every, counts = np.unique(np.concatenate([s[0] for s in streams]) if streams else np.zeros(0, np.uint64), return_counts=True)
    top = np.argsort(-counts, kind="stable")[:VOCABULARY]
    chosen = every[top[counts[top] >= 5]]
    slots = np.full(SLOTS, -1, np.int64)
    place = (chosen & np.uint64(SLOTS - 1)).astype(np.int64)
    slots[place[::-1]] = np.arange(len(chosen))[::-1]  # the more frequent word wins a slot
    size = len(chosen) + N_SHAPES
    index = np.zeros((size, DIM), np.float32)
    for _ in range(4):
        index[np.arange(size), rng.integers(0, DIM, size)] += rng.choice([-1, 1], size)
    vectors = np.zeros((size, DIM), np.float32)
    model = QualityModel(slots, chosen if len(chosen) else np.zeros(1, np.uint64), vectors, vectors, vectors, [])
    for hashes, shapes, rows in streams:
        keys = model.keys(hashes, shapes)
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        for lag in (1, 2):
            same = row[lag:] == row[:-lag]
            a, b = keys[:-lag][same], keys[lag:][same]
            pairs, n = np.unique(np.concatenate([a * size + b, b * size + a]), return_counts=True)
            at = np.flatnonzero(np.diff(pairs // size, prepend=-1))
            if len(at):
                vectors[pairs[at] // size] += np.add.reduceat(index[pairs % size] * n[:, None].astype(np.float32), at, 0)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = vectors / np.maximum(norm, 1) + 0.5 * index / np.linalg.norm(index, axis=1, keepdims=True).clip(1)
    return slots, model.hashes, np.concatenate([vectors, vectors**2], 1).astype(np.float32)


def train(texts: pa.Array, labels: np.ndarray, apart: np.ndarray, seed: int = 7) -> QualityModel:
    """Fit on texts with labels 0 / 1; rows marked ``apart`` only set the temperature."""
    blocks = [b[2:] for b in text_blocks(texts, _BLOCK)]
    model = QualityModel(*random_indexing(blocks, seed), np.zeros(1), np.ones(1), [])
    features = np.concatenate([model.pool(*b) for b in blocks]) if blocks else np.zeros((0, 2 * DIM + 3), np.float32)
    x, y = features[~apart], labels[~apart].astype(float)
    if len(x):
        model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    rng = np.random.default_rng(seed)
    width = 2 * DIM + 3
    layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    model.layers = layers
    optimiser = Adam(layers)
    x = (x - model.mean) / model.scale
    for _ in range(60 if len(x) else 0):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            at = order[lo : lo + 128]
            hidden = np.tanh(x[at] @ layers[0] + layers[1])
            g = (sigmoid((hidden @ layers[2] + layers[3])[:, 0]) - y[at])[:, None] / len(at)
            back = (g @ layers[2].T) * (1 - hidden**2)
            grads = [x[at].T @ back, back.sum(0), hidden.T @ g, g.sum(0)]
            optimiser.step([d + 1e-4 * p for d, p in zip(grads, layers, strict=True)])
    if apart.any():
        z, t = model.logits(features[apart]), labels[apart].astype(float)
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 41))
        loss = [-np.mean(np.where(t > 0, np.log(sigmoid(z / k)), np.log(1 - sigmoid(z / k)))) for k in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> QualityModel:
    """Learn from at most ``max_rows`` rows of ``labels`` (``id_col``, ``label_col``) and ``max_bytes`` of text.

    Rows with a null id or label are left out. Without any labelled text all scores are 0.5.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    sample = text_sample(docs, first_by_hash(known, max_rows), max_bytes, id_col, text_col)
    y = np.array(sample.column("label").to_pylist(), np.int64)
    apart = np.array([hash_of(x) % 5 == 0 for x in sample.column("id").to_pylist()], bool)
    if not len(y):
        model = train(pa.array([], pa.string()), y, apart)
        model.layers[2][:] = 0
        return model
    return train(sample.column("text").combine_chunks(), y, apart)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and ``score``: the probability of label 1 for each whole text.

    A null text counts as empty; a text without any token scores 0. Repeated rows are scored alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for _, _, data, offsets in text_blocks(batch.column(1), _BLOCK):
                features = sent.value.pool(data, offsets)
                parts.append(np.where(features[:, -1] > 0, sent.value.scores(features), 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts), pa.float64())], ["key", "score"])

    rows = docs.select(F.struct(F.col(id_col), *keep).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, f"key {rows.schema['key'].dataType.simpleString()}, score double").select("key.*", "score")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns; texts without a token go."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for lo, hi, data, offsets in text_blocks(batch.column(at), _BLOCK):
                features = sent.value.pool(data, offsets)
                good = (features[:, -1] > 0) & (sent.value.scores(features) >= threshold)
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(kept, docs.schema)
