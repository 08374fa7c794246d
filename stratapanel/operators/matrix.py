"""Correlation in long form, silhouettes, and the numpy kernels of one clustering period."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.cache import checkpointed
from .correlation import Correlations

#: rows in a block of pairwise distances, and entities in one of pairs that are summed up
NEAR, BLOCK = 2000, 10_000
#: entities in a block whose pairs are the result, and pairs in a strip of it
PAIRS, STRIP = 1000, 200_000
#: distances that k-means holds at once
PIECE = 1 << 18

# ---- long form: nothing is pivoted, so the number of entities is not a number of columns


def pair_correlations(rows: DataFrame, entity: str, time: str, x: str, least: int, by: list[str] | None = None) -> DataFrame:
    """``a``, ``b`` (a < b), ``n`` and ``corr`` over the times that both have; null where one doesn't vary.

    Entities with fewer than ``least`` values are left out; an entity has one value at a time. With ``by``, pairs are made within its groups only. The pairs of
    entities are the result itself: a correlation matrix is quadratic in the entities, not in the rows. Products by time are never rows: an
    entity's series is one row, a pair of blocks of entities is a task's matrices, and finished pairs leave them strip by strip.
    """
    by = by or []
    dealt = _dealt(_series(rows, entity, time, x, least, by), by, PAIRS)
    shape = dealt.select(*by, F.col("e").alias("a"), F.col("e").alias("b")).schema.add("n", "long").add("corr", "double")
    names = shape.names

    def strips(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(batches)
        part = part.take(pc.sort_indices(part, [("e", "ascending")]))  # so that a pair's smaller entity is that of the smaller place
        who, (wide, seen) = part["e"].combine_chunks(), _wide(part)
        block = part["block"].to_numpy()
        left, right = np.flatnonzero(block == key[-2].as_py()), np.flatnonzero(block == key[-1].as_py())
        step = max(1, STRIP // max(1, len(right)))
        for lo in range(0, len(left), step):
            i = left[lo : lo + step]
            corr, n = cross_correlations(wide[:, i], wide[:, right], seen[:, i], seen[:, right], counts=True)
            keep = n > 0
            if key[-2] == key[-1]:
                keep &= i[:, None] < right
            p, q = np.nonzero(keep)
            a, b = np.minimum(i[p], right[q]), np.maximum(i[p], right[q])
            corr = corr[p, q]
            groups = [pa.repeat(k, len(p)) for k in key[: len(by)]]
            yield pa.RecordBatch.from_arrays([*groups, who.take(pa.array(a)), who.take(pa.array(b)), pa.array(n[p, q].astype("int64")), pa.array(corr, mask=np.isnan(corr))], names)

    return dealt.groupBy(*by, "low", "high").applyInArrow(strips, shape)


def mean_correlations(rows: DataFrame, entity: str, time: str, x: str, least: int, by: list[str], members: DataFrame | None = None) -> DataFrame:
    """``by`` and ``corr``: the mean correlation of the pairs of each group's entities, over the times that both have; pairs where one doesn't
    vary don't count, nor entities with fewer than ``least`` values. A group without a pair has a null.

    An entity's series is one row; a pair of blocks of entities is a task, and only its sum and count are shuffled. They come from sums by pattern of
    missing values, so the work is quadratic only in entities whose pattern few others have. With ``members``, ``by`` and the entity once for each
    group that it is in, series are made once an entity, however many groups that is, from ``rows`` without ``by``.
    """
    series = checkpointed(_series(rows, entity, time, x, least, by if members is None else []))
    if members is not None:
        series = members.select(*by, F.col(entity).alias("e")).join(series, "e")
    dealt = _dealt(series, by, BLOCK)

    def sums(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        wide, seen = _wide(part)
        left = part["block"].to_numpy() == key[-2].as_py()
        total, count = Correlations(np.where(seen, wide, np.nan)).pairs(None if key[-2] == key[-1] else left)
        return pa.table([*[pa.repeat(k, 1) for k in key[: len(by)]], pa.array([total]), pa.array([count])], [*by, "s", "n"])

    shape = dealt.select(*by).schema.add("s", "double").add("n", "long")
    parts = dealt.groupBy(*by, "low", "high").applyInArrow(sums, shape)
    return parts.groupBy(*by).agg((F.sum("s") / F.nullif(F.sum("n"), F.lit(0))).alias("corr"))


def _series(rows: DataFrame, entity: str, time: str, x: str, least: int, by: list[str]) -> DataFrame:
    """``by``, ``e`` and its times ``t`` and values ``v``: one row for each entity with ``least`` values."""
    known = rows.where(F.col(x).isNotNull() & F.col(entity).isNotNull()).select(*by, F.col(entity).alias("e"), F.col(time).alias("t"), F.col(x).cast("double").alias("v"))
    series = known.groupBy(*by, "e").agg(F.collect_list(F.struct("t", "v")).alias("s")).where(F.size("s") >= least)
    series = series.withColumn("s", F.filter("s", lambda p: p["t"].isNotNull()))
    return series.select(*by, "e", F.transform("s", lambda p: p["t"]).alias("t"), F.transform("s", lambda p: p["v"]).alias("v"))


def _dealt(series: DataFrame, by: list[str], size: int) -> DataFrame:
    """Each entity in its ``block`` of about ``size``, once for each pair (``low``, ``high``) of blocks of its group that it belongs to."""
    sizes = series.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("blocks"))
    own = (series.join(sizes, by) if by else series.crossJoin(F.broadcast(sizes))).withColumn("block", F.pmod(F.xxhash64("e"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    return own.withColumn("other", other).select(*by, "e", "t", "v", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))


def _wide(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Times x entities of a table of series, and where there are values."""
    when = part["t"].combine_chunks().flatten().dictionary_encode()
    column = np.repeat(np.arange(len(part)), pc.list_value_length(part["t"]).to_numpy().astype(int))
    row = when.indices.to_numpy(zero_copy_only=False)
    wide, seen = np.zeros((len(when.dictionary), len(part))), np.zeros((len(when.dictionary), len(part)), bool)
    wide[row, column], seen[row, column] = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), True
    return wide, seen


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))


def silhouettes(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key`` and ``silhouette`` (Euclidean, exact) of each row; 0 for one alone in its cluster, null where there is one cluster. Keys are unique.

    Exact silhouettes need the distances of all pairs of rows: they are summed up by blocks of rows in numpy, a pair of blocks in a task,
    and only sums by row and cluster are shuffled. The work is quadratic by definition.
    """
    slim = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("c"))
    blocks = 1 + slim.count() // NEAR
    own = slim.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def sums(pair: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, c, k = np.stack(part["v"].to_numpy()), part["c"].to_numpy(), part["k"].to_numpy()
        left = part["block"].to_numpy() == pair[0]
        right = left if pair[0] == pair[1] else ~left
        out = []
        for a, b in ((left, right),) if pair[0] == pair[1] else ((left, right), (right, left)):
            away = distances(x[a], x[b])
            if a is b:
                np.fill_diagonal(away, 0)
            for other in np.unique(c[b]):
                of = c[b] == other
                n = of.sum() - ((c[a] == other) if a is b else 0)  # not with itself
                out.append(pd.DataFrame({"k": k[a], "c": c[a], "c2": other, "d": away[:, of].sum(1), "n": n}))
        return pd.concat(out)

    kind = rows.schema[key].dataType.simpleString()
    parts = dealt.select("k", "v", "c", "block", "low", "high").groupBy("low", "high").applyInPandas(sums, f"k {kind}, c string, c2 string, d double, n bigint")
    means = parts.groupBy("k", "c", "c2").agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("d"))
    ab = means.groupBy("k").agg(F.max(F.when(F.col("c") == F.col("c2"), F.col("d"))).alias("a"), F.min(F.when(F.col("c") != F.col("c2"), F.col("d"))).alias("b"))
    width = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(F.col("k").alias(key), F.when(F.col("a").isNull() | F.col("b").isNotNull(), width).alias("silhouette"))


def nearest_centre(rows: DataFrame, vector: str, centres: list[list[float]]) -> DataFrame:
    """``cluster`` (from 1) of the nearest of a few literal centres, the first of ties."""
    away = [distance(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in c])) for c in centres]
    return rows.withColumn("cluster", F.array_position(F.array(*away), F.array_min(F.array(*away))).cast("int"))


def standardise(train: DataFrame, other: DataFrame, columns: list[str]) -> DataFrame:
    """``other`` with its columns centred and scaled by the mean and deviation of ``train``."""
    stats = train.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns])
    joined = other.join(F.broadcast(stats))
    return joined.withColumns({c: F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in columns}).select(other.columns)


# ---- numpy kernels for one period's few hundred entities


def cross_correlations(x: np.ndarray, y: np.ndarray, seen_x: np.ndarray | None = None, seen_y: np.ndarray | None = None, counts: bool = False):
    """Pairwise-complete correlations of the columns of ``x`` with those of ``y``; NaN where one doesn't vary over the rows that both have.

    What isn't ``seen`` is missing, by default what is NaN. With ``counts`` the numbers of rows that both have come, too.
    """
    seen_x, seen_y = (~np.isnan(z) if s is None else s for z, s in ((x, seen_x), (y, seen_y)))
    with np.errstate(invalid="ignore"):  # a column with an infinite value has no correlations
        own_x, own_y = (np.where(s, z - np.where(s, z, 0).sum(0) / np.maximum(s.sum(0), 1), 0) for z, s in ((x, seen_x), (y, seen_y)))
    seen_x, seen_y = seen_x.astype(float), seen_y.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        n, sx, sy = seen_x.T @ seen_y, own_x.T @ seen_y, seen_x.T @ own_y
        sxx, syy, sxy = (own_x**2).T @ seen_y, seen_x.T @ own_y**2, own_x.T @ own_y
        vx, vy = sxx - sx**2 / n, syy - sy**2 / n
        out = np.clip((sxy - sx * sy / n) / np.sqrt(vx * vy), -1, 1)
    out[(n < 2) | ~(vx > 1e-12 * sxx) | ~(vy > 1e-12 * syy)] = np.nan
    return (out, n) if counts else out


def correlation_matrix(x: np.ndarray) -> np.ndarray:
    """Pairwise-complete correlations of the columns of ``x``; 0 where undefined, on the diagonal too."""
    return np.nan_to_num(cross_correlations(x, x))


def principal_components(x: np.ndarray, k: int) -> np.ndarray:
    """Scores on the first ``k`` components of the centred columns; each component's largest loading is positive."""
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    sign = np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])
    return (u * s * sign)[:, :k]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = 2 * x @ y.T
    np.subtract((x**2).sum(1)[:, None], out, out=out)
    out += (y**2).sum(1)
    return np.sqrt(np.maximum(out, 0, out=out), out=out)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start its points' nearest centres, the first of ties, and the squared distances; ``centres`` is starts x k x columns."""
    cost = (centres**2).sum(2)[:, :, None] - 2 * (centres @ x.T)
    best, label = cost[:, 0].copy(), np.zeros((len(centres), len(x)), np.int32)
    for c in range(1, centres.shape[1]):
        closer = cost[:, c] < best
        np.copyto(best, cost[:, c], where=closer)
        np.copyto(label, c, where=closer)
    return label, np.maximum(best + (x**2).sum(1), 0)


def kmeans(x: np.ndarray, k: int, starts: int = 25, rounds: int = 100, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Labels (from 0), centres and within sum of squares of the best of several k-means++ starts: few points' starts are run side by side, many points' one by one,
    of which only the best so far is held."""
    rng = np.random.default_rng(seed)
    first = rng.integers(len(x), size=(starts, 1))
    draws = [rng.random((starts, 1)) for _ in range(1, k)]
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    side = starts if len(x) * starts <= PIECE else 1
    for at in range(0, starts, side):
        own = slice(at, at + side)
        centres = _spread(x, first[own], [d[own] for d in draws])
        for label, centre in _side_by_side(x, centres, rounds) if side > 1 else [_bounded(x, centres[0], rounds)]:
            within = sum(float(((x[lo : lo + PIECE] - centre[label[lo : lo + PIECE]]) ** 2).sum()) for lo in range(0, len(x), PIECE))
            if best is None or within < best[2] - 1e-12:
                best = label, centre, within
    return best[0].astype(int), best[1], best[2]


def _spread(x: np.ndarray, first: np.ndarray, draws: list[np.ndarray]) -> np.ndarray:
    """The centres that k-means++ begins with, starts x k x columns, from each start's first point and its draws."""
    centres = x[first]
    gap = np.full((len(first), len(x)), np.inf)
    for draw in draws:
        np.minimum(gap, _nearest(x, centres[:, -1:])[1], out=gap)
        total = gap.sum(1, keepdims=True)
        share = np.cumsum(np.where(total > 0, gap, 1) / np.where(total > 0, total, len(x)), 1)
        picked = np.minimum((share < draw).sum(1), len(x) - 1)
        centres = np.concatenate([centres, x[picked][:, None]], 1)
    return centres


def _side_by_side(x: np.ndarray, centres: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Labels and centres of each start, over the points piece by piece."""
    starts, k, _ = centres.shape
    gap = np.empty((starts, len(x)))
    labels = np.full((starts, len(x)), -1, np.int32)
    live = np.arange(starts)
    for _ in range(rounds):
        moved = np.zeros(len(live), bool)
        sums, count, away = np.zeros((len(live), k, x.shape[1])), np.zeros((len(live), k), int), gap[: len(live)]
        step = max(1, PIECE // (len(live) * k))
        for lo in range(0, len(x), step):
            part = slice(lo, lo + step)
            new, away[:, part] = _nearest(x[part], centres[live])
            moved |= (new != labels[live, part]).any(1)
            labels[live, part] = new
            member = new[:, None] == np.arange(k, dtype=np.int32)[None, :, None]
            count += member.sum(2)
            sums += member.astype(float) @ x[part]
        for n in np.flatnonzero((count == 0).any(1)):
            _refill(x, labels[live[n]], away[n], count[n], sums[n])
            moved[n] = True
        centres[live[moved]] = sums[moved] / np.maximum(count[moved], 1)[:, :, None]
        live = live[moved]
        if not len(live):
            break
    return list(zip(labels, centres, strict=True))


def _refill(x: np.ndarray, label: np.ndarray, away: np.ndarray, count: np.ndarray, sums: np.ndarray) -> None:
    """An empty cluster takes the point farthest from its centre."""
    for c in np.flatnonzero(count == 0):
        far = away.argmax()
        label[far], away[far] = c, 0
    for c in range(len(count)):
        count[c], sums[c] = (label == c).sum(), x[label == c].sum(0)


def _bounded(x: np.ndarray, centres: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and centres of one start. A point is left out of a round while bounds show that no other centre has come nearer than its own (Hamerly);
    sums are corrected by the points that change."""
    k, n = len(centres), len(x)
    label, over, under = np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros(n)
    count, sums = np.zeros(k, int), np.zeros((k, x.shape[1]))
    lengths = (x**2).sum(1)
    slack = 1e-7 * np.sqrt(lengths.max(initial=0))  # more than rounding can do to a distance
    step = max(1, PIECE // (2 * k))
    for _ in range(rounds):
        moved, due = False, np.flatnonzero(over + slack >= under)
        for lo in range(0, len(due), step):
            at = due[lo : lo + step]
            own = x[at]
            cost = (centres**2).sum(1)[:, None] - 2 * (centres @ own.T)
            new = cost.argmin(0).astype(np.int32)
            line = np.arange(len(at))
            over[at] = np.sqrt(np.maximum(cost[new, line] + lengths[at], 0))
            cost[new, line] = np.inf
            under[at] = np.sqrt(np.maximum(cost.min(0) + lengths[at], 0))
            changed = np.flatnonzero(new != label[at])
            if len(changed):
                moved, own, old, to = True, own[changed], label[at[changed]], new[changed]
                gain = (to == np.arange(k)[:, None]).astype(float) - (old == np.arange(k)[:, None])
                count += gain.sum(1).astype(int)
                sums += gain @ own
                label[at[changed]] = to
        if (count == 0).any():
            away = np.concatenate([_nearest(x[lo : lo + step], centres[None])[1][0] for lo in range(0, n, step)])
            _refill(x, label, away, count, sums)
            moved, over[:] = True, np.inf
        if not moved:
            break
        fresh = sums / np.maximum(count, 1)[:, None]
        shift = np.sqrt(((fresh - centres) ** 2).sum(1))
        centres = fresh
        if k > 1:
            far, next_far = np.partition(shift, k - 2)[[k - 1, k - 2]]
            over += shift[label]
            under -= np.where(shift == far, next_far, far)[label]
    return label, centres


def mean_silhouette(x: np.ndarray, label: np.ndarray, away: np.ndarray | None = None) -> float:
    """Of the points ``x``, whose distances may be at hand."""
    away, count = distances(x, x) if away is None else away, np.bincount(label)
    sums = np.stack([away[:, label == c].sum(1) for c in range(len(count))], 1)
    own = count[label] - 1
    a = sums[np.arange(len(x)), label] / np.maximum(own, 1)
    means = sums / np.maximum(count, 1)
    means[:, count == 0] = np.inf
    means[np.arange(len(x)), label] = np.inf
    b = means.min(1)
    with np.errstate(invalid="ignore"):
        width = np.where(own > 0, (b - a) / np.maximum(a, b), 0.0)
    return float(np.nan_to_num(width).mean())
