"""Tokenised documents packed into sequences of bounded length, by bin completion.

Texts are tokenised word by word: a text's bytes are cut where the tokenizer's own rules always cut,
each distinct piece of a block is encoded once, and the ids are gathered by numpy. Documents longer than a
sequence are cut; what fills a sequence exactly stays alone. The rest is dealt by hash into groups of
about ``GROUP_PIECES``, a number of groups that grows with the input, and each group is packed on
its own: best fit decreasing gives a first solution, then a branch-and-bound puts the largest remaining
piece into a new bin, enumerates the undominated fillings around it and prunes by the waste that a better
solution could still afford. Fillings of any number of pieces are found one by one, fullest first, by the sums that the pieces
left can make. A group wastes less than one sequence more than a joint packing of its lengths.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise
from .textbuf import ragged, span_hashes, text_blocks

SEQUENCE, END_ID = 4096, 1
GROUP_PIECES = 20_000
#: steps that one group's search may take: so many, and so many more for each piece
STEPS, STEPS_PER_PIECE = 200_000, 100
#: views of the sums of what is left that a search keeps (1 MB or 2 each)
VIEWS = 24
#: distinct word pieces whose ids a worker keeps
CACHE_PIECES = 600_000
#: words of Latin letters that the tokenizer is given at a time
WORDS = 1000

# 0 white space, 1 letters, 2 ASCII marks, 3 all else
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 2
_KIND[39] = 3  # an apostrophe may begin a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: one word to the tokenizer, whatever stands around it: no mark, no digit, nothing that folding or composing changes to one
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class Encoder:
    """Ids of texts, equal to the tokenizer's own for each whole text.

    The tokenizer folds case, never joins across white space, and splits letters from marks. A text of ASCII and Latin-1 letters is
    cut at all three; one with other characters, or with the opening of a special token, only at white space.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end a word
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.old, self.new = empty, empty  # sorted hashes, with start and length of their ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _lookup(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        missing = np.ones(len(hashes), bool)
        for known, at, n in (self.old, self.new):
            if len(known):
                k = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[k] == hashes
                starts[hit], lengths[hit] = at[k[hit]], n[k[hit]]
                missing &= ~hit
        return np.flatnonzero(missing)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Store the ids of new pieces; where they start and how many there are.

        Words of Latin letters are encoded many at a time, with spaces between, and told apart by the ids that end a word: half the work of one by one.
        """
        n = np.zeros(len(pieces), np.int64)
        alone = np.fromiter((_WORD(p) is None for p in pieces), bool, len(pieces))
        words = [p for p, one in zip(pieces, alone, strict=True) if not one]
        flat = self._ids([" ".join(words[k : k + WORDS]) for k in range(0, len(words), WORDS)])[0]
        ends = np.flatnonzero(self.last[flat])
        if len(ends) == len(words):
            n[~alone] = np.diff(ends, prepend=-1)
        else:  # the vocabulary doesn't mark the ends of words
            alone[:], flat = True, flat[:0]
        rest, n[alone] = self._ids([p for p, one in zip(pieces, alone, strict=True) if one])
        total = len(flat) + len(rest)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.ids[self.used + len(flat) : self.used + total] = rest
        at = np.zeros(len(pieces), np.int64)
        for those, start in ((~alone, self.used), (alone, self.used + len(flat))):
            at[those] = start + np.cumsum(n[those]) - n[those]
        self.used += total
        return at, n

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(n.sum())), n

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a block, one after the other, and how many each row has."""
        if len(self.old[0]) + len(self.new[0]) > CACHE_PIECES:
            self.old = self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.used = 0
        n_rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n_rows, np.int64)
        latin = data == 0xC3
        after = np.zeros(len(data), bool)
        after[1:] = latin[:-1]
        sign = after & ((data == 0x97) | (data == 0xB7))  # multiplication and division signs
        odd = (data >= 0x80) & ~latin & ~after & (data != 0xC2)
        odd[1:] &= data[:-1] != 0xC2
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        odd_rows = np.diff(np.concatenate([[0], np.cumsum(odd)])[offsets]) > 0
        simple = np.repeat(~odd_rows, np.diff(offsets))
        kind = _KIND[data]
        kind[(latin | after) & ~sign] = 1
        kind[:-1][sign[1:]] = 3
        kind[~simple & (kind > 0)] = 3
        data = np.where(simple, _LOWER[data], data)
        edge = np.zeros(len(data) + 1, bool)
        a, b = kind[:-1], kind[1:]
        edge[1:-1] = (a != b) & ((a == 0) | (b == 0) | ((a + b == 3) & (a > 0) & (b > 0)))
        edge[offsets] = True
        edge[0] = edge[-1] = True
        cuts = np.flatnonzero(edge)
        solid = kind[cuts[:-1]] > 0
        starts, lengths = cuts[:-1][solid], np.diff(cuts)[solid]
        hashes, first, which = np.unique(span_hashes(data, starts, lengths), return_index=True, return_inverse=True)
        at, n = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        missing = self._lookup(hashes, at, n)
        if len(missing):
            raw = data.tobytes()
            begin, size = starts[first[missing]].tolist(), lengths[first[missing]].tolist()
            at[missing], n[missing] = self._encode([raw[s : s + k].decode() for s, k in zip(begin, size, strict=True)])
            joined = [np.concatenate([x, y]) for x, y in zip(self.new, (hashes[missing], at[missing], n[missing]), strict=True)]
            order = np.argsort(joined[0])
            self.new = tuple(x[order] for x in joined)
            if len(self.new[0]) > 1 << 16:
                joined = [np.concatenate([x, y]) for x, y in zip(self.old, self.new, strict=True)]
                order = np.argsort(joined[0], kind="stable")
                self.old, self.new = tuple(x[order] for x in joined), tuple(x[:0] for x in joined)
        count = n[which]
        rows = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(count)])
        return self.ids[ragged(at[which], count)], np.diff(total[rows])


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length`` and ``ids`` (packed little-endian u4) of each document's pieces.

    A document is its ids and ``end_id``; only a longer one than ``size`` is cut, into pieces of ``size`` and a last one that
    may be shorter. A null or empty text is ``end_id`` alone. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                ids, n = encoder.encode_rows(data, offsets)
                ends = np.cumsum(n + 1)
                flat = np.full(int(ends[-1]), end_id, "<u4")
                flat[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), n)] = ids
                pieces = -(-(n + 1) // size)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = ragged(np.zeros(hi - lo, np.int64), pieces)
                length = np.minimum(size, n[row] + 1 - piece * size)
                bounds = np.concatenate([[0], np.cumsum(length)]) * 4
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lo + row)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(length, pa.int64()), packed],
                    ["id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids binary").withColumnRenamed("id", id_col)


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes: each item, longest first, goes where the least room is left."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # a bit for each room that some bin has
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(k)
        else:
            room, at = size, len(bins)
            bins.append([k])
        if room > n:
            by_room.setdefault(room - n, []).append(at)
            rooms |= 1 << (room - n)
    return bins


def fits_into(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Can the items of ``small`` be dealt to the items of ``large`` as if these were bins."""
    if not small:
        return True
    for k, room in enumerate(large):
        if small[0] <= room and (k == 0 or large[k - 1] != room) and fits_into(small[1:], tuple(sorted((*large[:k], room - small[0], *large[k + 1 :]), reverse=True))):
            return True
    return False


class Stock:
    """The lengths left, and which sums they can make."""

    def __init__(self, lengths: list[int], size: int):
        self.size = size
        self.lengths = sorted(set(lengths), reverse=True)
        self.negated = [-n for n in self.lengths]
        number = {n: k for k, n in enumerate(self.lengths)}
        self.counts = [0] * len(self.lengths)
        for n in lengths:
            self.counts[number[n]] += 1
        self.left, self.steps, self.seen = len(lengths), 0, 0
        self.sums: list[int] = []
        self.views: list[tuple[int, int, list[int]]] = []

    def look(self, depth: int, again: bool = False) -> None:
        """Set ``sums``: for each length the sums, as bits, that it and shorter ones can make.

        While pieces are only taken away old sums stay an upper bound, so it suffices to look again from time to time; what was
        seen deeper in the search than ``depth`` is forgotten, as those pieces are back.
        """
        while self.views and self.views[-1][0] > depth:
            self.views.pop()
        if self.views and not again and self.left > self.views[-1][1] * 7 // 8:
            self.sums = self.views[-1][2]
            return
        every, sums = (1 << (self.size + 1)) - 1, 1
        out = [1] * (len(self.lengths) + 1)
        for k in range(len(self.lengths) - 1, -1, -1):
            count, times = self.counts[k], 1
            while count > 0:  # a length taken up to 1, 2, 4, ... times more
                many = min(times, count)
                sums |= sums << (many * self.lengths[k]) & every
                count, times = count - many, times * 2
            out[k] = sums
        self.sums, self.seen = out, self.steps
        self.views.append((depth, self.left, out))
        if len(self.views) > VIEWS:
            del self.views[1::2]

    def subsets(self, target: int, at: int, chosen: list[int]) -> Iterator[tuple[int, ...]]:
        """All sets of lengths, from number ``at`` on, that make ``target``, longest first; a set's pieces are taken while it is looked at."""
        if not target:
            yield tuple(chosen)
            return
        k = max(at, bisect_left(self.negated, -target))
        while k < len(self.lengths) and self.sums[k] >> target & 1:
            self.steps += 1
            n = self.lengths[k]
            if self.counts[k] and self.sums[k] >> (target - n) & 1:
                self.counts[k] -= 1
                self.left -= 1
                chosen.append(n)
                yield from self.subsets(target - n, k, chosen)
                chosen.pop()
                self.counts[k] += 1
                self.left += 1
            k += 1

    def fillings(self, room: int, waste: int, depth: int, at: int) -> Iterator[tuple[int, ...]]:
        """Undominated sets of lengths, from number ``at`` on, that leave no more than ``waste`` of ``room``, fullest first, each with its pieces taken.

        A set is dominated if its lengths can be dealt to those of another as to bins, which leaves the better rest to the other; that one
        is fuller, or as full with longer pieces, and so was given before.
        """
        kept: list[tuple[int, ...]] = []
        target = room
        while (open_ := self.sums[0] & ((1 << (target + 1)) - 1)) and (target := open_.bit_length() - 1) >= room - waste:
            for found in self.subsets(target, at, []):
                if not any(len(k) <= len(found) <= 6 and fits_into(found, k) for k in kept):
                    kept.append(found)
                    yield found
            if self.steps - self.seen > len(self.lengths):  # sums that can't be made any more cost more than another look
                self.look(depth, True)
            target -= 1


def lower_bound(lengths: list[int], size: int) -> int:
    """No packing has fewer bins: by volume, and by the items over half a bin."""
    best = -(-sum(lengths) // size)
    large = sorted((n for n in lengths if n > size // 2), reverse=True)
    arr = np.sort(np.array(lengths))
    total = np.concatenate([[0], np.cumsum(arr)])
    for k in sorted({*(n for n in lengths if n <= size // 2), 0}):
        # items over size - k share a bin with none of k or more
        top = len(arr) - int(np.searchsorted(arr, size - k, "right"))
        a, b = int(np.searchsorted(arr, size // 2, "right")), int(np.searchsorted(arr, size - k, "right"))
        middle = b - a
        small = int(total[a] - total[np.searchsorted(arr, k, "left")])
        spare = middle * size - int(total[b] - total[a])
        best = max(best, top + middle + max(0, -(-(small - spare) // size)))
    return max(best, len(large))


def pack(lengths: list[int], size: int = SEQUENCE, steps: float | None = None) -> tuple[list[list[int]], int]:
    """Bins of indexes into ``lengths``, none over ``size``, as few as a search of ``steps`` steps finds; and the nodes that it opened.

    By default the steps grow with the pieces; with ``math.inf`` the result is an optimum.
    """
    incumbent = best_fit(lengths, size)
    bound = lower_bound(lengths, size) if lengths else 0
    if len(incumbent) <= bound:
        return incumbent, 0
    best, nodes = _complete(lengths, size, bound, len(incumbent), STEPS + STEPS_PER_PIECE * len(lengths) if steps is None else steps)
    if best is None:
        return incumbent, nodes
    pools: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        pools.setdefault(n, []).append(k)
    return [[pools[n].pop() for n in b] for b in best], nodes


def _complete(lengths: list[int], size: int, bound: int, upper: int, steps: float) -> tuple[list[tuple[int, ...]] | None, int]:
    """Bin completion, depth first with an explicit stack: a better solution than ``upper`` bins or None, and the nodes opened."""
    stock = Stock(lengths, size)
    total, best, nodes = sum(lengths), None, 1
    spare = (upper - 1) * size - total  # waste that a better solution can afford
    if spare < 0:
        return None, nodes
    path: list[tuple[int, ...]] = []
    #: for each bin begun: number of its longest piece, waste before it, and the fillings not yet tried
    stack: list[tuple[int, int, Iterator[tuple[int, ...]]]] = []
    wasted, unfilled = 0, 0

    def begin(at: int) -> None:
        """A bin around the longest piece left, whose number is ``at`` at least."""
        while not stock.counts[at]:
            at += 1
        stock.counts[at] -= 1
        stock.left -= 1
        stock.look(len(stack))
        stack.append((at, wasted, stock.fillings(size - stock.lengths[at], spare - wasted, len(stack), at)))

    begin(0)
    while stack and stock.steps + nodes < steps:
        at, before, options = stack[-1]
        if len(path) == len(stack):
            path.pop()
        # the filling tried last gives its pieces back, the next one takes its own
        stock.look(len(stack) - 1)
        filling = next(options, None)
        top = stock.lengths[at]
        lost = size - top - sum(filling) if filling is not None else 0
        if filling is None or before + lost > spare:  # all that follow leave no less
            options.close()
            if filling is not None:
                for n in filling:
                    stock.counts[bisect_left(stock.negated, -n)] += 1
                stock.left += len(filling)
            stock.counts[at] += 1
            stock.left += 1
            stack.pop()
            continue
        path.append((top, *filling))
        wasted = before + lost
        nodes += 1
        if not stock.left:
            best, upper = list(path), len(path)
            spare = (upper - 1) * size - total
            if upper <= bound:
                break
            continue
        unfilled -= 1
        if unfilled < 0:  # the rest by best fit: often already better
            rest = [n for n, c in zip(stock.lengths, stock.counts, strict=True) for _ in range(c)]
            filled = best_fit(rest, size)
            unfilled = max(100, len(rest) // 20)
            if len(path) + len(filled) < upper:
                best, upper = [*path, *(tuple(rest[k] for k in b) for b in filled)], len(path) + len(filled)
                spare = (upper - 1) * size - total
                if upper <= bound:
                    break
        begin(at)
    return best, nodes


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, steps: float | None = None, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` (a stored table, as it is evaluated more than once) with ``sequence_id``, ``offset`` and ``search_nodes``, that its group's search opened.

    A piece of full ``size`` is a sequence of its own. Sequence numbers are unique, not consecutive. Equal lengths are
    exchangeable; repeated rows are placed each for itself. An empty input gives an empty result.
    """
    full = pieces.where(F.col("length") >= size)
    rest = pieces.where(F.col("length") < size)
    groups = 1 + rest.count() // group_pieces
    shape = pieces.drop("search_nodes").schema.add("sequence_id", "long").add("offset", "long").add("search_nodes", "long")
    names = [f.name for f in shape]

    def place(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        lengths = rows["length"].tolist()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        bins, nodes = pack(lengths, size, steps)
        for number, members in enumerate(bins):
            at = 0
            for k in members:
                sequence[k], offset[k] = number, at
                at += lengths[k]
        return rows.assign(sequence_id=sequence + (int(group[0]) << 32), offset=offset, search_nodes=nodes)[names]

    # by the place of a row in its stored file, so that rows that repeat one another are spread, too
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    placed = dealt.groupBy("_group").applyInPandas(place, shape)
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumns({"offset": F.lit(0).cast("bigint"), "search_nodes": F.lit(0).cast("bigint")})
    return placed.unionByName(alone)


def count_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces without their ids, which are summed up as ``ids_crc32``, written once for the packing to read."""
    pieces = token_pieces(docs, tokenizer, id_col=id_col, text_col=text_col)
    return materialise(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
