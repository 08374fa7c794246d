"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: each row holds one segment of about a megabyte of text with
the words' postings, sorted by term and position. A search looks up a test phrase's terms in each
segment, starts from the term with the shortest list there, and intersects the others' lists
shifted by their offsets. Neither step shuffles, and what is sent to the executors is the test set,
in blocks of a checked size.

Terms are 64-bit hashes of words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z); words are told apart by them alone, so a
window of ten could match wrongly only where hashes of different words collide, with a chance below 1e-19 a pair of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import ragged, text_blocks, words

WINDOW = 10
#: bytes of test text that one search pass sends to the executors, as 4 bytes a word and 8 a distinct word
BLOCK_TEXT_BYTES = 8 << 20
#: windows searched at a time
WINDOWS = 1 << 15


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings of every word of every document, a row for each segment.

    Columns: ``segment`` (its number), ``ids`` (the segment's documents in order), ``firsts`` (index of each document's first word
    and, last, the number of words), ``terms`` (sorted distinct word hashes), ``lists`` (where each term's
    list starts) and ``positions`` (the lists, one after the other); the last four are packed
    little-endian arrays of u4, u8, u4 and u4. Null or empty texts have no words; repeated rows are
    documents of their own. An index is to be stored before it is searched, as several passes may go over it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                packed = _postings(data, offsets)
                ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(0).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([x.tobytes()], pa.binary()) for x in packed)], ["ids", "firsts", "terms", "lists", "positions"]
                )

    segments = rows.mapInArrow(index, f"ids array<{kind}>, firsts binary, terms binary, lists binary, positions binary")
    return segments.select(F.monotonically_increasing_id().alias("segment"), "*")


def _postings(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """``firsts``, ``terms``, ``lists`` and ``positions`` of a block of texts."""
    hashes, firsts = words(data, offsets)
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(ranked)])
    return [firsts.astype("<u4"), ranked[starts].astype("<u8"), np.append(starts, len(ranked)).astype("<u4"), order.astype("<u4")]


class Segment:
    """A row of the index."""

    def __init__(self, firsts: bytes, terms: bytes, lists: bytes, positions: bytes):
        self.firsts = np.frombuffer(firsts, "<u4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<u8")
        self.lists = np.frombuffer(lists, "<u4").astype(np.int64)
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        self.n = len(self.positions)
        # sorted, so a shifted list is intersected by binary search
        self.keys = np.repeat(np.arange(len(self.terms)), np.diff(self.lists)) * (self.n + 1) + self.positions

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term in this segment, -1 where it has no list."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def sizes(self, terms: np.ndarray) -> np.ndarray:
        return np.where(terms >= 0, (self.lists[1:] - self.lists[:-1])[terms], 0) if len(self.terms) else np.zeros(terms.shape, np.int64)

    def has(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        wanted = terms * (self.n + 1) + positions
        at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
        return self.keys[at] == wanted

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, positions, "right") - 1


def phrase_matches(segment: Segment, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases (rows of numbers of ``segment``'s terms) that occur within one document: phrase, position."""
    length = phrases.shape[1]
    sizes = segment.sizes(phrases)
    order = np.argsort(sizes, axis=1, kind="stable")
    live = np.flatnonzero(sizes.min(1) > 0)
    if not len(live):
        return live, live
    rarest = order[live, 0]
    term = phrases[live, rarest]
    count = sizes[live, rarest]
    at = segment.positions[ragged(segment.lists[term], count)] - np.repeat(rarest, count)
    who = np.repeat(live, count)
    inside = (at >= 0) & (at + length <= segment.n)
    at, who = at[inside], who[inside]
    for k in range(1, length):
        step = order[who, k]
        kept = segment.has(phrases[who, step], at + step)
        at, who = at[kept], who[kept]
        if not len(at):
            break
    same = segment.documents(at) == segment.documents(at + length - 1)
    return who[same], at[same]


class TestSet:
    """Test items as numbers of terms; their windows (``window`` consecutive words, or the whole of a shorter item) are places in them."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW):
        self.ids, self.window = ids, window
        parts, firsts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for _, _, data, offsets in text_blocks(texts):
            hashes, first = words(data, offsets)
            parts.append(hashes)
            firsts.append(first[1:] + firsts[-1][-1])
        hashes = np.concatenate(parts)
        self.firsts = np.concatenate(firsts)  # where each item's words begin
        self.terms, number = np.unique(hashes, return_inverse=True)
        self.words = number.astype(np.uint32)

    @cached_property
    def starts(self) -> np.ndarray:
        """Where windows begin; made where they are searched, not sent."""
        size = np.diff(self.firsts)
        item = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(self.words)) - self.firsts[item]
        return np.flatnonzero((place + self.window <= size[item]) | (place == 0))

    def item_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, places, "right") - 1

    def search(self, segment: Segment) -> tuple[np.ndarray, np.ndarray]:
        """Which words of the segment are hit, and the distinct (document, item) pairs."""
        known = segment.find(self.terms)
        marks = np.zeros(segment.n + 1, np.int64)
        found = [np.zeros((0, 2), np.int64)]
        absent = np.concatenate([[0], np.cumsum(known[self.words] < 0)])
        starts = self.starts
        item = self.item_of(starts)
        ends = np.minimum(starts + self.window, self.firsts[item + 1])
        live = np.flatnonzero(absent[ends] == absent[starts])  # all of a window's words occur in the segment
        for size in np.unique(ends[live] - starts[live]):
            some = live[ends[live] - starts[live] == size]
            for lo in range(0, len(some), WINDOWS):
                part = some[lo : lo + WINDOWS]
                who, at = phrase_matches(segment, known[self.words[starts[part][:, None] + np.arange(size)]])
                np.add.at(marks, at, 1)
                np.add.at(marks, at + size, -1)
                found.append(np.unique(np.stack([segment.documents(at), item[part[who]]], 1), axis=0))
        return np.cumsum(marks)[: segment.n] > 0, np.unique(np.concatenate(found), axis=0)


def _sent(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> list[Broadcast]:
    """The test items as broadcasts of bounded size. Each block is read, built and sent before the next one is read, so the driver holds one.

    A block's number is a hash of the item's id and text; an item of its own size is never cut.
    """
    context = items.sparkSession.sparkContext
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // BLOCK_TEXT_BYTES
    out = []
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toArrow()
        out.append(context.broadcast(TestSet(block.column("id").to_pylist(), block.column("text").combine_chunks(), window)))
        del block
    return out


def search_phrases(
    index: DataFrame, items: DataFrame, window: int = WINDOW, item_id_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Every indexed document with the words that an occurrence of an item's window covers.

    Returns ``id_col``, ``n_words``, ``spans`` (array of struct<start, end>: maximal runs of hit words, as
    word numbers, end exclusive) and ``item_ids`` (sorted strings, without repeats). Items without words or
    with a null id never match; an empty test set hits nothing. Of an empty index nothing is returned.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shape = f"segment bigint, place int, id {kind}, n_words bigint, spans array<struct<start:int,end:int>>, item_ids array<string>"
    span_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def searcher(sent):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    segment = Segment(*(batch.column(k)[row].as_buffer() for k in range(2, 6)))
                    hit, pairs = tests.search(segment)
                    n = len(segment.firsts) - 1
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    cuts = segment.firsts[1:-1]
                    cuts = cuts[(cuts > 0) & (cuts < segment.n)]
                    cuts = cuts[hit[cuts] & hit[cuts - 1]]  # a run never crosses documents
                    begins = np.sort(np.concatenate([edges[::2], cuts]))
                    ends = np.sort(np.concatenate([edges[1::2], cuts]))
                    owner = segment.documents(begins)
                    base = segment.firsts[owner]
                    values = pa.StructArray.from_arrays([pa.array(begins - base, pa.int32()), pa.array(ends - base, pa.int32())], ["start", "end"])
                    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)
                    names: list[list[str]] = [[] for _ in range(n)]
                    for doc, item in pairs.tolist():
                        names[doc].append(tests.ids[item])
                    names = [sorted(set(x)) for x in names]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[row].as_py()), pa.int64()), pa.array(np.arange(n), pa.int32()), batch.column(1)[row].values, pa.array(np.diff(segment.firsts), pa.int64()), spans.cast(span_kind), pa.array(names, pa.list_(pa.string()))],
                        ["segment", "place", "id", "n_words", "spans", "item_ids"],
                    )

        return search

    parts = [index.mapInArrow(searcher(sent), shape) for sent in _sent(items, item_id_col, item_text_col, window)]
    found = parts[0]
    if len(parts) > 1:  # one row for each document and block meets here, told apart by its place in the index
        for p in parts[1:]:
            found = found.unionByName(p)
        found = found.groupBy("segment", "place").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), _merged(F.array_sort(F.flatten(F.collect_list("spans")))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
        )
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "item_ids")


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping and touching ones joined."""
    pair = "array<struct<start:int,end:int>>"

    def step(done, x):
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= x["start"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(spans, F.array().cast(pair), step)


def search_near(
    index: DataFrame, items: DataFrame, reach: int = 20, item_id_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Proximity matches: ``id_col``, ``item_id`` and ``position`` (a word number) of each place where an
    item's rarest term stands in a document with all its other terms within ``reach`` words."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    parts = []
    for sent in _sent(items, item_id_col, item_text_col):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = sent.value
            for batch in batches:
                for row in range(batch.num_rows):
                    segment = Segment(*(batch.column(k)[row].as_buffer() for k in range(2, 6)))
                    out: list[tuple[int, str, int]] = []
                    known = segment.find(tests.terms)
                    for k, name in enumerate(tests.ids):
                        terms = known[np.unique(tests.words[tests.firsts[k] : tests.firsts[k + 1]])]
                        if not len(terms) or (terms < 0).any():
                            continue
                        terms = terms[np.argsort(segment.sizes(terms), kind="stable")]
                        at = segment.positions[segment.lists[terms[0]] : segment.lists[terms[0] + 1]]
                        doc = segment.documents(at)
                        low = np.maximum(segment.firsts[doc], at - reach)
                        high = np.minimum(segment.firsts[doc + 1], at + reach + 1)
                        kept = np.ones(len(at), bool)
                        for term in terms[1:]:
                            places = segment.positions[segment.lists[term] : segment.lists[term + 1]]
                            kept &= np.searchsorted(places, low) < np.searchsorted(places, high)
                        out += [(d, name, p) for d, p in zip(doc[kept].tolist(), (at - segment.firsts[doc])[kept].tolist(), strict=True)]
                    docs = batch.column(1)[row].values.take(pa.array([x[0] for x in out], pa.int64()))
                    yield pa.RecordBatch.from_arrays([docs, pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], ["id", "item_id", "position"])

        parts.append(index.mapInArrow(search, f"id {kind}, item_id string, position bigint"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs, all other rows and all columns as they are.

    Each block of texts is indexed and searched where it is read; nothing is stored or shuffled.
    """
    for sent in _sent(items, item_id_col, item_text_col, window):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text_col)
                for lo, hi, data, offsets in text_blocks(batch.column(at)):
                    _, pairs = sent.value.search(Segment(*_postings(data, offsets)))
                    keep = np.ones(hi - lo, bool)
                    keep[pairs[:, 0]] = False
                    yield batch.slice(lo, hi - lo).filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
