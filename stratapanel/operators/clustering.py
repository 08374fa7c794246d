"""Clusters of entities by co-movement, refitted every year, with labels that stay put."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..sources.cache import checkpointed
from .correlation import Correlations
from .elastic_net import no_rows
from .matrix import correlation_matrix, distances, kmeans, principal_components

MIN_MONTHS, MIN_ENTITIES, MAX_COMPONENTS = 36, 5, 10
#: entities up to which a period's correlation matrix is built, and points whose silhouettes one task takes
DENSE, ROWS = 2000, 8000
FIT_SCHEMA = "refit_date date, permno bigint, cluster_id int, k int, silhouette double"


def months(batches: Iterable[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Entities in order, and their times x entities, NaN where missing, from batches of one row an entity: ``permno``, its times ``t`` and values ``v``.

    A batch is held as flat arrays, and no longer than it takes to put it in its place.
    """
    parts = [(b["permno"].to_numpy(), pc.list_value_length(b["t"]).to_numpy(zero_copy_only=False), *(b[c].flatten().to_numpy() for c in ("t", "v"))) for b in batches]
    who = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
    place = np.empty(len(who), np.int64)
    place[np.argsort(who, kind="stable")] = np.arange(len(who))
    when = np.unique(np.concatenate([np.unique(p[2]) for p in parts])) if parts else np.zeros(0, np.int64)
    wide, at = np.full((len(when), len(who)), np.nan), 0
    parts.reverse()
    while parts:
        own, size, t, v = parts.pop()
        wide[np.searchsorted(when, t), np.repeat(place[at : at + len(own)], size)] = v
        at += len(own)
    return np.sort(who), wide


def embed(batches: pd.DataFrame | Iterable[pa.RecordBatch]) -> pd.DataFrame:
    """permno and x, the principal components of the correlation matrix, from one row an entity with its times and values; no rows if there is too little to go by."""
    if isinstance(batches, pd.DataFrame):
        batches = [pa.RecordBatch.from_pandas(batches[["permno", "t", "v"]], preserve_index=False)]
    who, wide = months(batches)
    if len(who) < MIN_ENTITIES:
        return no_rows("permno", "x")
    k = min(MAX_COMPONENTS, len(who) - 1)
    if len(who) <= DENSE:
        x = principal_components(correlation_matrix(wide), k)
    else:
        found = Correlations(wide)
        del wide
        pa.default_memory_pool().release_unused()  # what the batches took
        x = found.components(k)
    return pd.DataFrame({"permno": who, "x": list(x)})


def entities(batches: Iterable[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    """``permno``, in order, and the columns ``names`` of batches of one row an entity, arrays of one length as a matrix: flat numbers, no object for a row."""

    def plain(column: pa.Array) -> np.ndarray:
        if pa.types.is_list(column.type):
            return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return column.to_numpy(zero_copy_only=False)

    parts = [[plain(b[c]) for c in ("permno", *names)] for b in batches if len(b)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    del parts
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def slices(columns: dict[str, np.ndarray | pa.Scalar]) -> Iterator[pa.RecordBatch]:
    """Batches of ``ROWS`` rows; a scalar is every row's value."""
    size = next(len(c) for c in columns.values() if isinstance(c, np.ndarray))
    for lo in range(0, size, ROWS):
        n = min(ROWS, size - lo)
        yield pa.RecordBatch.from_arrays([pa.repeat(c, n) if isinstance(c, pa.Scalar) else pa.array(c[lo : lo + n]) for c in columns.values()], list(columns))


def silhouette_sums(x: np.ndarray, labels: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum of the silhouettes of the rows ``own`` among the points ``x``, for each column of ``labels``; distances are taken tile by tile."""
    sizes = labels.max(0) + 1
    first = np.cumsum(sizes) - sizes
    member = np.zeros((len(x), sizes.sum()))
    for f, label in zip(first, labels.T, strict=True):
        member[np.arange(len(x)), f + label] = 1
    count, out = member.sum(0), np.zeros(labels.shape[1])
    for lo in range(0, len(own), 256):
        rows = own[lo : lo + 256]
        sums = np.zeros((len(rows), member.shape[1]))
        for at in range(0, len(x), 2048):
            away = distances(x[rows], x[at : at + 2048])
            mine = (rows >= at) & (rows < at + 2048)
            away[np.flatnonzero(mine), rows[mine] - at] = 0
            sums += away @ member[at : at + 2048]
        for c, (f, k) in enumerate(zip(first, sizes, strict=True)):
            label, n, each = labels[rows, c], count[f : f + k], sums[:, f : f + k]
            line = np.arange(len(rows))
            a = each[line, label] / np.maximum(n[label] - 1, 1)
            means = np.where(n > 0, each / np.maximum(n, 1), np.inf)
            means[line, label] = np.inf
            b = means.min(1)
            with np.errstate(invalid="ignore"):
                out[c] += np.nan_to_num(np.where(n[label] > 1, (b - a) / np.maximum(a, b), 0.0)).sum()
    return out


def assignment(gain: np.ndarray) -> list[int]:
    """Column of each row of a square matrix in an assignment of maximal sum (Hungarian algorithm with potentials)."""
    n = len(gain)
    cost = gain.max(initial=0) - gain
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[at] = True
            row, step, to = owner[at], np.inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    slack = cost[row - 1, j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if least[j] < step:
                        step, to = least[j], j
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def match_counts(counts: dict[tuple[int, int], int], labels: list[int]) -> dict[int, int | None]:
    """A name for each of the new ``labels``, from the number of common entities of each (new label, old name).

    New clusters keep the old name they overlap most with (Jaccard over common entities). One beyond the old ones gets a fresh number;
    one without any common entity gets None. If nothing is common, labels stay.
    """
    if not counts:
        return {c: c for c in labels}
    new, old = sorted({a for a, _ in counts}), sorted({b for _, b in counts})
    table = np.array([[counts.get((a, b), 0) for b in old] for a in new], float)
    gain = np.zeros((max(table.shape),) * 2)
    gain[: len(new), : len(old)] = table / (table.sum(1, keepdims=True) + table.sum(0) - table)
    chosen = assignment(gain)
    names: dict[int, int | None] = {}
    for place, label in enumerate(new):
        known = chosen[place] < len(old)
        names[label] = old[chosen[place]] if known else max([*old, *names]) + place + 1
    return {c: names.get(c) for c in labels}


def match_labels(before: dict[int, int], after: dict[int, int]) -> dict[int, int | None]:
    """New assignments by entity, relabelled by ``match_counts``."""
    counts: dict[tuple[int, int], int] = {}
    for e in before.keys() & after.keys():
        counts[after[e], before[e]] = counts.get((after[e], before[e]), 0) + 1
    names = match_counts(counts, sorted(set(after.values())))
    return {e: names[c] for e, c in after.items()}


def relabelled(before: DataFrame, after: DataFrame, entity: str = "permno", label: str = "cluster_id") -> DataFrame:
    """``after`` with the labels that ``match_counts`` gives it; only the counts of label pairs come to the driver."""
    pairs = after.select(entity, F.col(label).alias("a")).join(before.select(entity, F.col(label).alias("b")).where("b is not null"), entity)
    counts = {(r.a, r.b): r["count"] for r in pairs.groupBy("a", "b").count().collect()}
    return _named(after, match_counts(counts, sorted(r[0] for r in after.select(label).distinct().collect())), label)


def _named(rows: DataFrame, names: dict, label: str) -> DataFrame:
    known = F.create_map(*[F.lit(x).cast("int") for pair in names.items() for x in pair]) if names else F.create_map().cast("map<int,int>")
    return rows.withColumn(label, F.element_at(known, F.col(label).cast("int")))


def refit_dates(config: EngineConfig) -> list[date]:
    """The last day of each year before an evaluated one."""
    return [date(y, 12, 31) for y in range(config.train_start.year - 1, config.end_date.year)]


def fit_refits(panel: DataFrame, config: EngineConfig, grid: tuple[int, ...] = tuple(range(2, 11)), force: int | None = None, starts: int = 25) -> DataFrame:
    """One clustering for each refit date over the months up to it, all in parallel, labels not yet matched: the k of ``grid`` with the greatest mean silhouette
    (the first of ties), or ``force``.

    An entity's window is one row, read batch by batch. The task of a refit holds its entities x months and their components; no matrix of entities x entities is held, but blocks of it.
    Each k is a task, and so is each block of rows whose silhouettes are taken; only k's silhouettes come to the driver.
    """
    spark = panel.sparkSession
    dates = spark.createDataFrame([(d, n + 1) for n, d in enumerate(refit_dates(config))], "refit_date date, number int")
    first = F.last_day(F.add_months("refit_date", 1 - config.refit_window_months))
    known = panel.select(F.col("permno").cast("bigint").alias("permno"), F.unix_date("date_eom").alias("t"), "date_eom", F.col("ret_excess").cast("double").alias("v")).where("permno is not null and v is not null and not isnan(v)")
    own = known.groupBy("permno").agg(F.array_sort(F.collect_list(F.struct("t", "date_eom", "v"))).alias("s")).crossJoin(F.broadcast(dates))
    own = own.withColumn("s", F.filter("s", lambda p: (p["date_eom"] <= F.col("refit_date")) & (p["date_eom"] >= first))).where(F.size("s") >= MIN_MONTHS)
    series = own.select("refit_date", "number", "permno", F.transform("s", lambda p: p["t"]).alias("t"), F.transform("s", lambda p: p["v"]).alias("v"))

    shape = "refit_date date, number int, permno bigint, x array<double>"

    def place(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = embed(batches)
        for lo in range(0, len(found), ROWS):
            part = found.iloc[lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([*[pa.repeat(x, len(part)) for x in key], pa.array(part["permno"]), pa.array(part["x"].to_list(), pa.list_(pa.float64()))], ["refit_date", "number", "permno", "x"])

    points = checkpointed(series.groupBy("refit_date", "number").applyInArrow(place, shape))

    def attempt(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (who, x), (number, k) = entities(batches, "x"), (v.as_py() for v in key[1:])
        if k <= len(who):
            label, _, _ = kmeans(x, k, starts, 100, config.seed + number)
            yield from slices({"refit_date": key[0], "permno": who, "k": key[2], "label": label.astype(np.int32)})

    tried = points.withColumn("k", F.explode(F.array(*[F.lit(k) for k in grid if k >= 2]).cast("array<int>")))
    tried = tried.groupBy("refit_date", "number", "k").applyInArrow(attempt, "refit_date date, permno bigint, k int, label int")
    labels = tried.groupBy("refit_date", "permno").agg(F.array_sort(F.collect_list(F.struct("k", "label"))).alias("l"))
    labels = labels.select("refit_date", "permno", F.transform("l", lambda p: p["k"]).alias("ks"), F.transform("l", lambda p: p["label"]).alias("labels"))
    labelled = checkpointed(points.join(labels, ["refit_date", "permno"]))
    sizes = labelled.groupBy("refit_date").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    dealt = labelled.join(F.broadcast(sizes), "refit_date").withColumn("own", F.pmod(F.xxhash64("permno"), F.col("parts")))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))

    def widths(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, x, ks, label, own = entities(batches, "x", "ks", "labels", "own")
        fit = ks[0] < len(x)
        sums = silhouette_sums(x, label[:, fit], np.flatnonzero(own == key[1].as_py()))
        yield from slices({"refit_date": key[0], "part": key[1], "k": ks[0][fit], "s": sums, "n": pa.scalar(len(who))})

    found = dealt.select("refit_date", "part", "permno", "x", "ks", "labels", "own").groupBy("refit_date", "part").applyInArrow(widths, "refit_date date, part bigint, k int, s double, n bigint").collect()
    scores: dict[date, dict[int, float]] = {}
    for r in sorted(found):
        of = scores.setdefault(r.refit_date, {})
        of[r.k] = of.get(r.k, 0.0) + r.s / r.n
    chosen = []
    for day, of in scores.items():
        best = max((k for k in grid if k in of), key=of.__getitem__, default=None)
        if best is not None or force is not None:
            chosen.append((day, best if force is None else force, None if best is None else of[best]))

    def final(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (who, x), (number, k) = entities(batches, "x"), (v.as_py() for v in key[1:3])
        label, _, _ = kmeans(x, k, 2 * starts, 200, config.seed + number)
        yield from slices({"refit_date": key[0], "permno": who, "cluster_id": (label + 1).astype(np.int32), "k": key[2], "silhouette": key[3]})

    picked = points.join(F.broadcast(spark.createDataFrame(chosen, "refit_date date, k int, silhouette double")), "refit_date")
    return picked.groupBy("refit_date", "number", "k", "silhouette").applyInArrow(final, FIT_SCHEMA)


def clusters_annual(panel: DataFrame, config: EngineConfig, grid: tuple[int, ...] = tuple(range(2, 11)), force: int | None = None, starts: int = 25) -> tuple[DataFrame, DataFrame]:
    """Assignments for the months of the year after each refit (date_eom, permno, cluster_id), and a diagnosis of each refit.

    Matching labels is sequential by nature, from one refit to the next, but needs only the counts of common entities of each pair of labels of neighbouring
    refits: these come to the driver, k x k numbers a refit; assignments never do.
    """
    spark = panel.sparkSession
    fits = checkpointed(fit_refits(panel, config, grid, force, starts))
    diagnosis = fits.groupBy("refit_date").agg(F.first("k").alias("k"), F.first("silhouette").alias("silhouette"), F.count("*").cast("int").alias("n_stocks"))
    labels: dict[date, list[int]] = {}
    for r in fits.select("refit_date", "cluster_id").distinct().orderBy("refit_date", "cluster_id").collect():
        labels.setdefault(r.refit_date, []).append(r.cluster_id)
    days = list(labels)
    follows = spark.createDataFrame(list(zip(days[1:], days[:-1], strict=True)), "refit_date date, before date")
    old = fits.select(F.col("refit_date").alias("before"), "permno", F.col("cluster_id").alias("old"))
    pairs = fits.join(F.broadcast(follows), "refit_date").join(old, ["before", "permno"]).groupBy("refit_date", "cluster_id", "old").count().collect()
    names: dict[date, dict[int, int | None]] = {}
    for n, day in enumerate(days):
        last = names[days[n - 1]] if n else {}
        counts: dict[tuple[int, int], int] = {}
        for r in pairs:
            if r.refit_date == day and last.get(r.old) is not None:
                counts[r.cluster_id, last[r.old]] = counts.get((r.cluster_id, last[r.old]), 0) + r["count"]
        names[day] = match_counts(counts, labels[day])
    rows = [(day, c, name) for day in days for c, name in names[day].items()]
    table = spark.createDataFrame(rows, "refit_date date, cluster_id int, name int")
    matched = fits.join(F.broadcast(table), ["refit_date", "cluster_id"]).select("refit_date", "permno", F.col("name").alias("cluster_id"))
    year = F.year("refit_date") + 1
    months = F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(1)), F.expr("interval 1 month"))
    applied = matched.select("permno", "cluster_id", F.explode(months).alias("m")).select(F.last_day("m").alias("date_eom"), "permno", "cluster_id")
    applied = applied.where(F.col("date_eom") <= F.last_day(F.lit(config.end_date)))
    return applied, diagnosis
