"""Isolation forests: random trees on single features, fitted on one part of a group's rows and scoring another."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crosssection import beside
from .elastic_net import no_rows

SCORES = "scheme string, grp string, permno bigint, date_eom date, iso_score double"
SAMPLE = 256
#: rows of a group that one task scores
PART = 50_000


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """All trees are grown together, level by level: node arrays hold every tree's nodes, the first ones being the roots."""

    def __init__(self, x: np.ndarray, trees: int = 200, sample: int = SAMPLE, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.count, self.size = trees, min(sample, len(x))
        self.depth = int(np.ceil(np.log2(max(self.size, 2))))
        rows = np.concatenate([rng.choice(len(x), self.size, replace=False) for _ in range(trees)])
        node, first = np.repeat(np.arange(trees), self.size), 0
        levels = []
        for depth in range(self.depth + 1):
            order = np.argsort(node, kind="stable")
            rows, node = rows[order], node[order]
            starts = np.flatnonzero(np.diff(node, prepend=-1))
            count = np.diff(np.append(starts, len(node)))
            points, m = x[rows], len(starts)
            low, high = np.minimum.reduceat(points, starts, 0), np.maximum.reduceat(points, starts, 0)
            vary = high > low
            split = vary.any(1) & (depth < self.depth)
            chosen = (np.cumsum(vary, 1) > np.floor(rng.random(m) * vary.sum(1))[:, None]).argmax(1)
            at = np.arange(m)
            bottom, top = low[at, chosen], high[at, chosen]
            cut = np.minimum(bottom + rng.random(m) * (top - bottom), np.nextafter(top, -np.inf))  # never at the very top
            child = first + m + 2 * (np.cumsum(split) - 1)
            levels.append((np.where(split, chosen, -1), cut, np.where(split, child, -1), depth + average_path(count)))
            of = np.repeat(at, count)
            kept = np.flatnonzero(split[of])
            if not len(kept):
                break
            of = of[kept]
            node = child[of] + (points[kept, chosen[of]] > cut[of])
            rows, first = rows[kept], first + m
        self.feature, self.cut, self.left, self.value = (np.concatenate(c) for c in zip(*levels, strict=True))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean depth / average depth): near 1 is anomalous."""
        out = np.zeros(len(x))
        step = max(1, (1 << 20) // self.count)
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            at, row = np.tile(np.arange(self.count), (len(part), 1)), np.arange(len(part))[:, None]
            while (inner := self.feature[at] >= 0).any():
                right = part[row, np.maximum(self.feature[at], 0)] > self.cut[at]
                at = np.where(inner, self.left[at] + right, at)
            out[lo : lo + step] = self.value[at].mean(1)
        return 2 ** (-out / max(float(average_path(self.size)), 1e-9))


def _pool(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` rows of each (scheme, grp), or all of a smaller one, by a hash of the key, with the group's ``size``; no task sees more of a group."""
    sizes = rows.groupBy("scheme", "grp").agg(F.count("*").alias("size"))
    joined = rows.join(sizes, ["scheme", "grp"])
    place = F.pmod(F.xxhash64(F.lit(seed), "permno", "date_eom"), F.lit(1 << 40))
    return joined.where(place < F.lit(float(1 << 40)) * F.lit(float(n)) / F.col("size"))


def score_groups(rows: DataFrame, features: tuple[str, ...], trees: int = 200, min_train: int = 30, seed: int = 8675309, fit_is_score: bool = False) -> DataFrame:
    """Scores of the 'test' rows of each (scheme, grp) by a forest of its 'train' rows; groups with fewer than ``min_train`` of these have none.

    With ``fit_is_score`` the forest is fitted on the rows that it scores. A tree sees 256 rows by the method's definition; they are drawn from all
    of a group's rows, or from as many as all trees together could see. Forests are grown where their sample is, then meet their group's rows part by part.
    The seed of a group depends on its name only.
    """
    kept = rows.select("scheme", "grp", F.col("permno").cast("bigint").alias("permno"), "date_eom", "split", *features)
    train, test = (kept, kept) if fit_is_score else (kept.where("split = 'train'"), kept.where("split = 'test'"))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        if int(part["size"].iloc[0]) < min_train:
            return no_rows("scheme", "grp", "forest")
        x = part.sort_values(["permno", "date_eom"])[list(features)].to_numpy(float)
        forest = IsolationForest(x, trees, SAMPLE, seed + zlib.crc32(f"{key[0]}/{key[1]}".encode()))
        return pd.DataFrame({"scheme": [key[0]], "grp": [key[1]], "forest": [pickle.dumps(forest)]})

    def score(_: tuple, part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(found):
            return no_rows("scheme", "grp", "permno", "date_eom", "iso_score")
        forest = pickle.loads(found["forest"].iloc[0])
        return part[["scheme", "grp", "permno", "date_eom"]].assign(iso_score=forest.scores(part[list(features)].to_numpy(float)))

    forests = _pool(train, trees * SAMPLE, seed).groupBy("scheme", "grp").applyInPandas(grow, "scheme string, grp string, forest binary")
    parts = test.groupBy("scheme", "grp").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = test.join(parts, ["scheme", "grp"]).withColumn("part", F.pmod(F.xxhash64("permno", "date_eom"), F.col("parts"))).drop("parts")
    sent = forests.join(parts, ["scheme", "grp"]).select("scheme", "grp", "forest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    by = ("scheme", "grp", "part")
    return dealt.groupBy(*by).cogroup(sent.groupBy(*by)).applyInPandas(score, SCORES)


def mahalanobis_scores(rows: DataFrame, features: tuple[str, ...], by: list[str]) -> DataFrame:
    """``score``: squared distance from the group's mean with its variances only, the cheap scorer; constant features don't count. ``rows`` is evaluated twice."""
    stats = rows.groupBy(*by).agg(*[f(c).alias(f"_{k}_{c}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    terms = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(F.col(f"_s_{c}"), F.lit(0.0))), F.lit(0.0)) for c in features]
    return beside(rows, stats, by).select(*rows.columns, sum((t * t for t in terms), F.lit(0.0)).alias("score"))
