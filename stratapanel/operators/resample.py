"""Bootstrap intervals with a Poisson weight for each row and resample, drawn from a hash of the row's key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a Poisson(1) weight above this has probability below 1e-12
MAX_WEIGHT = 14
#: rows x resamples that are drawn at a time
DRAWS = 1 << 20
_BARS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MAX_WEIGHT)])


def poisson_weights(keys: np.ndarray, resamples: np.ndarray) -> np.ndarray:
    """For each 64-bit key and each resample 0, 1, 2, ... with the probabilities of a Poisson variable of mean 1, fixed by both (splitmix64)."""
    h = keys.view(np.uint64)[:, None] + (resamples.astype(np.uint64) + np.uint64(1))[None] * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return np.searchsorted(_BARS, (h >> np.uint64(11)) * 2.0**-53, "right")


def bootstrap_mean(rows: DataFrame, x: str, key: str, by: list[str], n_boot: int = 1000, seed: int = 8675309, level: float = 0.95) -> DataFrame:
    """Mean, and percentile interval of ``n_boot`` resampled means, of each group.

    Resamples are drawn and summed up where the rows are; a shuffle holds at most ``n_boot`` partial sums for each group and batch of rows. A row's
    weights depend on the seed and its key only, not on how rows are dealt.
    """
    known = rows.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("x"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"))
    shape = known.select(*by).schema.add("b", "integer").add("w", "double").add("wx", "double")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        resamples = np.arange(n_boot)
        for batch in batches:
            for _, part in batch.groupby(by, dropna=False, sort=False) if by else [((), batch)]:
                w, wx = np.zeros(n_boot), np.zeros(n_boot)
                h, values = part["h"].to_numpy(), part["x"].to_numpy()
                step = max(1, DRAWS // n_boot)
                for lo in range(0, len(h), step):
                    drawn = poisson_weights(h[lo : lo + step], resamples)
                    w += drawn.sum(0)
                    wx += values[lo : lo + step] @ drawn
                out = pd.DataFrame({"b": resamples.astype(np.int32), "w": w, "wx": wx})
                for place, c in enumerate(by):
                    out.insert(place, c, [part[c].iloc[0]] * n_boot)
                yield out

    means = known.mapInPandas(draw, shape).groupBy(*by, "b").agg((F.sum("wx") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    spread = means.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"))
    centre = known.groupBy(*by).agg(F.avg("x").alias("estimate"), F.count("*").alias("n"))
    return centre.join(spread, by) if by else centre.join(F.broadcast(spread))
