"""Statistics of a group's rows put beside each of them, without a window that holds a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import zscore
from ..sources.cache import checkpointed


def beside(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with their group's ``stats``, a null key being a group, too. The groups are few beside the rows; Spark broadcasts them where they are small."""
    named = stats.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(named, reduce(Column.__and__, same), "left").drop(*[f"_by_{c}" for c in by])


def with_zscores(rows: DataFrame, names: dict[str, str], *by: str) -> DataFrame:
    """{column: new column}: cross-sectional z-scores, from partial sums by group. ``rows`` is evaluated twice."""
    stats = rows.groupBy(*by).agg(*[f(c).alias(f"_{k}_{n}") for c, n in names.items() for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    joined = beside(rows, stats, list(by))
    return joined.select(*rows.columns, *[zscore(F.col(c), F.col(f"_m_{n}"), F.col(f"_s_{n}")).alias(n) for c, n in names.items()])


def quantiles(rows: DataFrame, x: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by`` and {name: share}: exact quantiles with linear interpolation of each group's non-null values.

    Rows are dealt by ranges of (group, value), so a large group is spread over many tasks. A value's rank is its place in its task's
    sorted rows and the number of its group's rows in the tasks before; only the ranks asked for are looked up. The sorted
    rows are written once.
    """
    known = rows.select(*by, F.col(x).cast("double").alias("_x")).where("_x is not null")
    order = [*by, "_x"]
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("_at"))
    placed = checkpointed(placed.withColumn("_task", F.shiftright("_at", 33)))
    parts = placed.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*by)
    parts = parts.withColumns({"_below": F.sum("_n").over(w.orderBy("_task")) - F.col("_n"), "_total": F.sum("_n").over(w)})
    for name, p in shares.items():
        parts = parts.withColumn(f"_h_{name}", (F.col("_total") - 1) * p)
    ranked = beside(placed, parts, [*by, "_task"]).withColumn("_rank", F.col("_below") + F.col("_at") - F.col("_first"))
    wanted = [(F.col("_rank") == F.floor(f"_h_{n}")) | (F.col("_rank") == F.ceil(f"_h_{n}")) for n in shares]
    found = ranked.where(reduce(Column.__or__, wanted))

    def value(n: str) -> Column:
        low, high = (F.max(F.when(F.col("_rank") == f(f"_h_{n}"), F.col("_x"))) for f in (F.floor, F.ceil))
        return low + (high - low) * F.max(F.col(f"_h_{n}") - F.floor(f"_h_{n}"))

    return found.groupBy(*by).agg(*[value(n).alias(n) for n in shares])


def winsorized(rows: DataFrame, x: str, name: str, p: float, *by: str) -> DataFrame:
    """``name``: x clamped at the p and 1 - p quantiles of its group; null stays null."""
    cuts = quantiles(rows, x, list(by), {"_low": p, "_high": 1 - p})
    value = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_low")), F.col("_high")))
    return beside(rows, cuts, list(by)).select(*rows.columns, value.alias(name))
