"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; documents of equal sets are one node. Of each set a hash chooses
about ``BRANCH`` shingles a run, the same ones in similar sets; sets that share a chosen shingle share a bucket. What
stands in no other set makes no bucket. A bucket of at most ``PART`` sets is compared whole, in one task. A
larger one is dealt by hash into parts of that size, each compared whole. A set with enough of its chosen shingles in buckets
compared whole is settled: the chance that a link of its was in none of them is below the target. What a large bucket still
has to compare are pairs of sets neither of which is settled and that nothing ties together yet: the sets outside its largest tied
share meet that share and each other, block by block, if they are ``PART`` at most; if more, its unsettled sets go on to the next
level, where further chosen shingles split the bucket, and after the last level all that is open is compared block by block.

Two sets are compared by parity sketches, whose differing bits never exceed the sets' symmetric difference: between sets of
under 1024 shingles no link is missed, longer sets are thinned first. Ties join sets into candidate groups; within each, exact
similarities are computed from the sets, in blocks, counting links without ever listing the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, roots
from .storage import materialise
from .textbuf import mix, text_blocks, words

SHINGLE, SIMILARITY = 5, (4, 5)  # words; similarity as a fraction
#: chosen shingles a run; levels; chosen shingles below a large bucket, out of a pool; target
BRANCH, LEVELS, DEEPER, POOL, RECALL = 4, 3, 2, 24, 0.9999
#: sets in a bucket whose pairs are compared all at once; sets in a bucket or part that one task compares
LIMIT, PART = 100, 2000
#: sets, and shingles, in a block of exact comparison
BLOCK, BLOCK_SHINGLES = 2000, 2 << 20
#: bits of a sketch, and the largest set that isn't thinned for it
BITS, UNTHINNED = 1024, 1023
#: standard deviations of a thinned sketch that a link may be off
SLACK = 4.5
_SHINGLE_BITS = np.uint64(46)
_MASK = np.uint64((1 << 46) - 1)
_SHINGLE_FACTORS = np.random.default_rng(20).integers(1 << 60, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_CHOICE, _SPARE, _SKETCH = (np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def _share() -> float:
    return SIMILARITY[0] / SIMILARITY[1]


def runs_for(recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has met with probability ``recall`` at the worst, all buckets being split to the last level.

    A pair shares about similarity * BRANCH chosen shingles a run (Poisson), and similarity * DEEPER in each level below a shared one.
    """
    dies = 0.0
    for _ in range(LEVELS - 1):
        dies = math.exp(-_share() * DEEPER * (1 - dies))
    return max(1, math.ceil(-math.log(max(1 - recall, 1e-300)) / (_share() * BRANCH * (1 - dies))))


def enough_whole(chosen: int, miss: float) -> int:
    """Of ``chosen`` shingles, how many must be in buckets compared whole for a set to be settled.

    A linked set lacks each of them with probability 1 - similarity at most; the link is missed only if it lacks all that are
    compared whole. If no number is enough, ``chosen`` + 1.
    """
    p = 1 - _share()
    tail = 0.0
    for lacking in range(chosen, -1, -1):
        tail += math.comb(chosen, lacking) * p**lacking * (1 - p) ** (chosen - lacking)
        if tail > miss:
            return lacking + 1
    return 0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (46-bit hashes, sorted) of each row of a block, and where each row's begin.

    A row with fewer words than ``size``, but not none, has one shingle of all its words.
    """
    hashes, rows = words(data, offsets)
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - rows[:-1][row]
    total = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        at = np.arange(len(hashes)) + k
        inside = place + k < n[row]
        total[inside] += hashes[at[inside]] * _SHINGLE_FACTORS[k]
    start = (place + size <= n[row]) | (place == 0)
    value = mix(total[start]) & _MASK
    if len(n) >= 1 << 18:  # more rows than a number has room for beside a shingle
        order = np.lexsort([value, row[start]])
        value, owner = value[order], row[start][order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])[: len(value)]
        return value[new], np.searchsorted(owner[new], np.arange(len(n) + 1))
    key = (row[start].astype(np.uint64) << _SHINGLE_BITS) | value
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
    return key & _MASK, np.searchsorted(key >> _SHINGLE_BITS, np.arange(len(n) + 1).astype(np.uint64))


def set_numbers(elements: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 63-bit number for each set, equal for equal sets; 0 for the empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements + np.uint64(1)))])
    size = np.diff(starts)
    return np.where(size > 0, mix((total[starts[1:]] - total[starts[:-1]]) ^ size.astype(np.uint64)) >> np.uint64(1) | np.uint64(1), np.uint64(0)).astype(np.int64)


def thinning(size: np.ndarray) -> np.ndarray:
    """How often a set of ``size`` is halved for its sketch."""
    return np.maximum(np.frexp(np.maximum(size, 1))[1] - (UNTHINNED + 1).bit_length() + 1, 0)


def sketches(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BITS bits for each set, as bytes: bit b tells if an odd number of (kept) shingles fall to b.

    Of a set halved k times the shingles with a hash below 2**(32 - k) are kept, and fall to the bits in the hash's order.
    """
    size = np.diff(starts)
    wide = BITS.bit_length() - 1
    out = np.zeros((len(size), BITS // 8), np.uint8)
    spread = low * _SKETCH
    for lo in range(0, len(size), 512):
        hi = min(lo + 512, len(size))
        halved = np.repeat(thinning(size[lo:hi]), size[lo:hi]).astype(np.uint64)
        part = spread[starts[lo] : starts[hi]].astype(np.uint64)
        row = np.repeat(np.arange(hi - lo), size[lo:hi])
        kept = (part >> (np.uint64(32) - halved)) == 0
        bit = (part[kept] >> (np.uint64(32 - wide) - halved[kept])).astype(np.int64)
        odd = np.bincount(row[kept] * BITS + bit, minlength=(hi - lo) * BITS) & 1
        out[lo:hi] = np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1, bitorder="little")
    return out


class Sketches:
    """The sketches of some sets and their sizes, to compare."""

    def __init__(self, size: np.ndarray, packed: np.ndarray):
        self.size, self.bits, self.halved = size.astype(np.int64), np.ascontiguousarray(packed).view(np.uint64), thinning(size)
        self.mixed = bool(len(size)) and self.halved.min() != self.halved.max()

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """May the sets ``a`` and ``b`` (numbers) be linked."""
        size_a, size_b = self.size[a], self.size[b]
        out = np.minimum(size_a, size_b) * SIMILARITY[1] >= np.maximum(size_a, size_b) * SIMILARITY[0]
        at = np.flatnonzero(out)
        a, b = np.broadcast_to(a, out.shape)[at], np.broadcast_to(b, out.shape)[at]
        halved = np.maximum(self.halved[a], self.halved[b])
        unlike = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(1, dtype=np.int64)
        bits = np.full(len(at), BITS)
        if self.mixed and len(odd := np.flatnonzero(self.halved[a] != self.halved[b])):
            swap = self.halved[a[odd]] > self.halved[b[odd]]
            fine, coarse = np.where(swap, b[odd], a[odd]), np.where(swap, a[odd], b[odd])
            # the first half of the finer sketch has what the coarser one has, two bits in one
            first = self.bits[fine, : BITS // 128]
            pairs = np.unpackbits(self.bits[coarse].view(np.uint8), axis=1, bitorder="little").reshape(len(odd), -1, 2)
            folded = np.packbits(pairs[:, :, 0] ^ pairs[:, :, 1], axis=1, bitorder="little").view(np.uint64)
            unlike[odd] = np.bitwise_count(first ^ folded).sum(1, dtype=np.int64)
            bits[odd] = BITS // 2
        # the symmetric difference of linked sets is at most (1 - s) / (1 + s) of both sizes
        total = self.size[a] + self.size[b]
        most = total * (SIMILARITY[1] - SIMILARITY[0]) // (SIMILARITY[1] + SIMILARITY[0])
        if halved.any():
            share = 0.5 * (1 - np.exp(-2 * (most / 2.0**halved) / bits))
            most = np.where(halved > 0, bits * share + SLACK * np.sqrt(bits * share * (1 - share)), most)
        out[at] = unlike <= most
        return out


def _chosen(low: np.ndarray, size: np.ndarray, owner: np.ndarray, factor: np.uint32, many: int) -> np.ndarray:
    """Which elements are chosen: about ``many`` of each set, all of a smaller one."""
    bar = np.minimum(many / size[owner] * 2.0**32, 2.0**32 - 1).astype(np.uint32)
    return np.flatnonzero(low * factor <= bar)


def describe(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``node`` (its set's number), ``n`` (of shingles), ``sketch``, ``chosen`` shingles and the ``pool`` for deeper levels, of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                elements, starts = shingle_sets(data, offsets)
                size = np.diff(starts)
                low = (mix(elements) >> np.uint64(32)).astype(np.uint32)
                owner = np.repeat(np.arange(hi - lo), size)
                lists = []
                for factor, many in ((_CHOICE, runs * BRANCH), (_SPARE, POOL)):
                    at = _chosen(low, np.maximum(size, 1), owner, factor, many)
                    bounds = pa.array(np.searchsorted(owner[at], np.arange(hi - lo + 1)), pa.int32())
                    lists.append(pa.ListArray.from_arrays(bounds, pa.array(elements[at].view(np.int64))))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(set_numbers(elements, starts)), pa.array(size, pa.int32()), _packed(sketches(low, starts)), *lists],
                    ["id", "node", "n", "sketch", "chosen", "pool"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, node bigint, n int, sketch binary, chosen array<bigint>, pool array<bigint>")


def _packed(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    width = rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, n, sketch, paths), a path being (path, count): a row for each path, of a large one with the number of the set's part."""
    for batch in batches:
        paths = batch.column(batch.schema.get_field_index("paths"))
        bounds = paths.offsets.to_numpy().astype(np.int64)
        flat = paths.values.slice(bounds[0], bounds[-1] - bounds[0])
        path, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("path", "count"))
        row = pa.array(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)))
        node, n, sketch = (batch.column(batch.schema.get_field_index(c)).take(row) for c in ("node", "n", "sketch"))
        parts = (-(-count // PART)).astype(np.uint64)
        part = mix(node.to_numpy().view(np.uint64) ^ path.view(np.uint64)) % parts
        key = np.where(parts > 1, mix(path.view(np.uint64) + part) | np.uint64(1 << 63), path.view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node, n, sketch], ["path", "node", "n", "sketch"])


def _ties(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])


def _compare_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, node, n, sketch) sorted by path: ties that join the near sets of each path, as few as will do."""
    held: tuple[np.ndarray, ...] | None = None

    def finish(path, node, n, packed):
        compare = Sketches(n, packed)
        cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        count = np.diff(np.append(cuts, len(path)))
        for size in np.unique(count[(count > 1) & (count <= LIMIT)]):
            a, b = np.triu_indices(size, 1)
            firsts = cuts[count == size]
            step = max(1, 20_000 // len(a))
            for lo in range(0, len(firsts), step):
                first = firsts[lo : lo + step, None]
                x, y = (first + a).ravel(), (first + b).ravel()
                near = compare.near(x, y) & (node[x] != node[y])
                members, which = np.unique(np.concatenate([x[near], y[near]]), return_inverse=True)
                if len(members):
                    root = roots(len(members), *which.reshape(2, -1))
                    at = np.flatnonzero(root != np.arange(len(members)))
                    yield _ties(node, members[at], members[root[at]])
        for k in np.flatnonzero(count > LIMIT):
            rows = np.arange(cuts[k], cuts[k] + count[k])
            yield _ties(node, *_tie(compare, np.arange(len(node)), rows, rows))

    for batch in batches:
        now = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)), _unpacked(batch.column(3)))
        if held is not None:
            now = tuple(np.concatenate([x, y]) for x, y in zip(held, now, strict=True))
        if not len(now[0]):
            continue
        open_at = int(np.searchsorted(now[0], now[0][-1]))  # the last path may go on
        held = tuple(x[open_at:] for x in now)
        if open_at:
            yield from finish(*(x[:open_at] for x in now))
    if held is not None and len(held[0]):
        yield from finish(*held)


def _tie(compare: Sketches, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties that join all near pairs of ``left`` and ``right`` not yet of one label; ``label`` is brought up to date."""
    own = left is right
    if len(left) > len(right):
        left, right = right, left
    right = right[np.argsort(compare.size[right], kind="stable")]
    left = right if own else left
    size = compare.size[right]
    a, b = [], []
    for place, k in enumerate(left):
        # of sizes that a linked set can have
        lo = place + 1 if own else int(np.searchsorted(size, -(-compare.size[k] * SIMILARITY[0] // SIMILARITY[1])))
        rest = right[lo : int(np.searchsorted(size, compare.size[k] * SIMILARITY[1] // SIMILARITY[0], "right"))]
        rest = rest[label[rest] != label[k]]
        if not len(rest):
            continue
        near = rest[compare.near(np.int64(k), rest)]
        met, first = np.unique(label[near], return_index=True)
        if len(met):
            label[np.isin(label, met)] = label[k]
            a.append(np.full(len(met), k))
            b.append(near[first])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _cross(key: tuple, rows: pa.Table) -> pa.Table:
    """Ties of a pair of blocks of a large bucket, between sets not yet tied together."""
    node, block, tied, n = (rows.column(c).to_numpy() for c in ("node", "block", "tied", "n"))
    compare = Sketches(n, _unpacked(rows.column("sketch")))
    left = np.flatnonzero(block == key[1].as_py())
    right = left if key[1] == key[2] else np.flatnonzero(block == key[2].as_py())
    return pa.Table.from_batches([_ties(node, *_tie(compare, tied.copy(), left, right))])


def candidate_groups(nodes: DataFrame, runs: int, recall: float = RECALL) -> DataFrame:
    """``node`` and ``component`` of all nodes that may be linked to others; ``nodes`` has node, n, sketch, chosen and pool."""
    slim = nodes.select("node", "n", "sketch")
    most = 4 * runs * BRANCH
    enough = F.array(*[F.lit(enough_whole(k, (1 - recall) / 4)) for k in range(most + 1)])
    rows = nodes.select("node", F.explode("chosen").alias("path"))
    groups = None
    for level in range(LEVELS):
        counts = rows.groupBy("path").count().where("count > 1")
        lists = rows.join(counts, "path").groupBy("node").agg(F.collect_list(F.struct("path", "count")).alias("paths"))
        shared = materialise(nodes.select("node", "n", "sketch", F.size("chosen").alias("total")).join(lists, "node"), "shared-paths")
        dealt = shared.select("node", "n", "sketch", "paths").mapInArrow(_deal, "path bigint, node bigint, n int, sketch binary")
        ties = materialise(dealt.repartition("path").sortWithinPartitions("path").mapInArrow(_compare_buckets, "a bigint, b bigint"), "ties")
        groups = _joined(groups, ties)
        large = F.filter("paths", lambda p: p["count"] > PART)
        unsettled = F.size(large) > 0
        if level == 0:
            whole = F.col("total") - F.size(large)
            unsettled &= (F.col("total") > most) | (whole < F.element_at(enough, F.least("total", F.lit(most)) + 1))
        loose = materialise(shared.where(unsettled).select("node", F.explode(F.transform(large, lambda p: p["path"])).alias("path")), "unsettled")
        if loose.isEmpty():
            break
        loose = materialise(loose.join(groups.withColumnRenamed("component", "tied"), "node", "left").withColumn("tied", F.coalesce("tied", "node")), "unsettled-ties")
        shares = loose.groupBy("path", "tied").count().groupBy("path").agg(F.max_by("tied", F.struct("count", "tied")).alias("most"), F.max("count").alias("same"), F.sum("count").alias("count"))
        shares = materialise(shares.withColumn("others", F.col("count") - F.col("same")).where("others > 0"), "shares-of-buckets")
        last = level + 1 == LEVELS
        if shares.isEmpty():
            break
        crossed = _cross_ties(loose, shares if last else shares.where(F.col("others") <= PART), slim)
        if not crossed.isEmpty():
            groups = _joined(groups, crossed)
        deeper = loose.join(shares.where(F.col("others") > PART).select("path"), "path", "left_semi").select("node", "path")
        if last or deeper.isEmpty():
            break
        rows = _next_paths(deeper.join(nodes.select("node", "n", "pool"), "node"), level)
        rows = materialise(rows, "next-paths")
    return groups


def _joined(groups: DataFrame | None, ties: DataFrame) -> DataFrame:
    """Components of what is grouped already and further ties."""
    return components(ties if groups is None else ties.unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))


def _next_paths(rows: DataFrame, level: int) -> DataFrame:
    """Of each row (node, n, path, pool) the paths that go on from ``path``: about DEEPER chosen shingles of the pool, by a hash of path and shingle."""
    share = F.lit(DEEPER * 2.0**20) / F.least("n", F.lit(POOL))
    chosen = F.filter("pool", lambda s: F.pmod(F.xxhash64("path", s, F.lit(level)), F.lit(1 << 20)) < share)
    return rows.withColumn("next", F.explode(chosen)).select("node", F.xxhash64("path", "next").alias("path"))


def _cross_ties(loose: DataFrame, shares: DataFrame, slim: DataFrame) -> DataFrame:
    """Ties of all pairs in the buckets of ``shares`` but those within the largest tied share: blocks of others meet all blocks."""
    own, others = F.ceil(F.col("same") / PART), F.ceil(F.col("others") / PART)
    rows = loose.join(shares, "path").withColumns({"own": own, "all": own + others, "other": F.col("tied") != F.col("most")})
    block = F.when(F.col("other"), F.col("own") + F.pmod(F.xxhash64("node", "path"), F.col("all") - F.col("own"))).otherwise(F.pmod(F.xxhash64("node", "path"), F.col("own")))
    rows = rows.select("node", "path", "tied", "other", "own", "all", block.alias("block")).join(slim, "node")
    dealt = rows.withColumn("meets", F.explode(F.sequence(F.when(F.col("other"), F.lit(0)).otherwise(F.col("own")), F.col("all") - 1)))
    dealt = dealt.select("path", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "node", "n", "tied", "block", "sketch")
    return materialise(dealt.groupBy("path", "low", "high").applyInArrow(_cross, "a bigint, b bigint"), "ties-of-blocks")


_EXACT = "node bigint, links bigint, root bigint, whole boolean"


def _exact(key: tuple, rows: pa.Table) -> pa.Table:
    """Links of a block pair: each node's number of linked documents, and a spanning forest of its links."""
    own, other = key[1].as_py(), key[2].as_py()
    node, first = np.unique(rows.column("node").to_numpy(), return_index=True)
    rows = rows.take(pa.array(first))
    copies, left = rows.column("copies").to_numpy(), np.flatnonzero(rows.column("block").to_numpy() == own)
    right = left if own == other else np.flatnonzero(rows.column("block").to_numpy() == other)
    sets = [np.frombuffer(x, "<u8") for x in rows.column("elements").to_pylist()]
    m, size = len(sets), np.array([len(s) for s in sets])
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set alone is in no intersection
    column, seen = np.cumsum(shared) - 1, shared[inverse]
    where, which = np.repeat(np.arange(m), size)[seen], column[inverse[seen]]
    order = np.argsort(which, kind="stable")
    where, which = where[order], which[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int(shared.sum()), 1024):
        a, b = np.searchsorted(which, [lo, lo + 1024])
        part = np.zeros((m, min(1024, int(shared.sum()) - lo)), np.float32)
        part[where[a:b], which[a:b] - lo] = 1
        inter += part[left] @ part[right].T
    # inter / (sizes - inter) >= p / q without division
    linked = inter * (SIMILARITY[0] + SIMILARITY[1]) >= SIMILARITY[0] * (size[left][:, None] + size[right][None]).astype(np.float32)
    if own == other:
        np.fill_diagonal(linked, False)
    links = np.zeros(m, np.int64)
    links[left] = linked @ copies[right]
    if own != other:
        links[right] = linked.T @ copies[left]
    root = np.arange(m)
    while True:  # the smallest number that links lead to
        least = root.copy()
        least[left] = np.minimum(least[left], np.where(linked, root[right][None], m).min(1, initial=m))
        if own != other:
            least[right] = np.minimum(least[right], np.where(linked, root[left][:, None], m).min(0, initial=m))
        np.minimum.at(least, root, least)
        least = least[least]
        if (least == root).all():
            break
        root = least
    return pa.table({"node": node, "links": links, "root": node[root], "whole": pa.array(rows.column("blocks").to_numpy() == 1)})


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``id_col``, ``class_id`` and ``n_links`` of each document.

    Two documents are linked where the Jaccard similarity of their sets is 0.8 or more; documents of equal sets
    always are. ``n_links`` counts the other documents a document is linked to, copies among them; ``class_id``
    is the smallest id that links lead to. A text with fewer than five words is one shingle; one without words, or null, is
    linked to none. A document with a null id has no class and no links. Repeated rows are copies. Every link shown is
    exact; a pair at the threshold is missed with probability below 1 - ``recall``.
    """
    runs = runs_for(recall)
    described = materialise(describe(docs, runs, id_col, text_col), "sets")
    grouped = described.where("n > 0 and id is not null").groupBy("node").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "sketch", "chosen", "pool")]
    )
    nodes = materialise(grouped, "nodes")
    groups = candidate_groups(nodes, runs, recall).join(nodes.select("node", "rep", "copies", "n"), "node")
    sizes = groups.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    member = groups.drop("n").join(sizes, "component")
    member = materialise(member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(0)):
                found, starts = shingle_sets(data, offsets)
                right = set_numbers(found, starts) == batch.column(1).slice(lo, hi - lo).to_numpy()
                packed = [found[a:b].astype("<u8").tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                part = batch.slice(lo, hi - lo).drop_columns(["text"]).append_column("elements", pa.array(packed, pa.binary()))
                yield part.filter(pa.array(right))

    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(member.hint("merge"), "rep")
    sets = texts.select("text", "node", "component", "copies", "block", "blocks").mapInArrow(
        elements, "node bigint, component bigint, copies bigint, block int, blocks int, elements binary"
    )
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    exact = dealt.select("component", "low", "high", "node", "copies", "block", "blocks", "elements").groupBy("component", "low", "high").applyInArrow(_exact, _EXACT)
    exact = materialise(exact, "links")
    links = exact.groupBy("node").agg(F.sum("links").alias("links"))
    spread = components(exact.where("not whole and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = exact.where("whole").select("node", F.col("root").alias("component"))
    roots = whole.unionByName(spread)
    named = nodes.select("node", "rep", "copies").join(roots, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = named.join(least, "component").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    own = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("node"))
    return (
        described.select("id", own.alias("node"))
        .join(classes, "node", "left")
        .select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
    )


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id; documents in no class stay.

    Of rows with equal id and text one stays; rows that share an id but not the text stand or fall together.
    Rows with a null id stay.
    """
    joined = jaccard_join(docs, id_col, text_col)
    firsts = joined.where(F.col("class_id") == F.col(id_col)).select(id_col)
    kept = docs.join(firsts, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return kept.select(docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
